"""Queries over link pages written from the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import bindings as b
from quarry.plans.queries import query
from quarry.sources import files, pages, structure

# Fixed values of these queries: titles in turn, with the kind that each has.
OPEN_DATA = (("Precatórios expedidos para 20{y}", "expedition_file"), ("Série histórica de dados orçamentários", "budget_history"), ("Índice de correção monetária", "correction_index"), ("Outros dados de 20{y}", None))
DOCUMENTS = (("Acordo direto - precatórios 20{y}", "direct_agreement"), ("Lote preferencial de precatório 20{y}", "preferential_lot"), ("Alterações na lista de precatórios 20{y}", "change_notice"), ("Precatórios pagos 20{y}", "paid_or_payment_process"), ("Ordem cronológica 20{y}", "chronological_list"), ("Relatório de precatórios 20{y}", "other_precatorio_report"), ("Balanço 20{y}", None))
SECTIONED = (("Proposta de 20{y} - Art. 12", "federal_budget_proposal"), ("Mapa da situação da dívida - referência 20{y}", "federal_debt_map"), ("Proposta de 20{y}, art 85", "subnational_budget_proposal"), ("Mapa da situação da dívida de precatórios 20{y}", "subnational_debt_map"), ("Dívida consolidada até 20{y}", "subnational_consolidated_debt"), ("Contato", None))


def _kinds(table) -> str:
    return "[" + ", ".join("NULL" if kind is None else f"'{kind}'" for _, kind in table) + "]"


def _title(table):
    year = (F.lit(10) + F.col("debtor_id") % 20).cast("string")
    return F.replace(F.get(F.array(*(F.lit(t) for t, _ in table)), F.pmod("debtor_id", F.lit(len(table))).cast("int")), F.lit("{y}"), year)


def _page(spark: SparkSession, d: str, html) -> DataFrame:
    return files.spread(b.debtors(spark, d), "debtor_id").select(F.col("debtor_id").alias("page"), html.alias("html"))


@query(f"SELECT debtor_id AS page, {_kinds(OPEN_DATA)}[debtor_id % 4 + 1] AS kind, CASE WHEN debtor_id % 4 = 0 THEN 2010 + debtor_id % 20 END::INT AS year FROM debtors WHERE debtor_id % 4 IN (1, 2) OR (debtor_id % 4 = 0 AND debtor_id % 20 < 10)")
def open_data_links(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by title, of wanted years; kinds without a year stay."""
    html = F.concat(F.lit("<p><a class='x' href='f?id=1'><b>"), _title(OPEN_DATA), F.lit("</b> </a></p>"))
    found = pages.title_kinds(pages.with_context(_page(spark, d, html), "page", "html", 100), "open_data")
    return pages.selected(found, year=range(2010, 2020), undated_kinds=("budget_history", "correction_index")).select("page", "kind", "year")


@query("SELECT debtor_id AS page, CASE WHEN debtor_id % 2 = 0 THEN 'annual_debt_map' ELSE 'paid_precatorios' END AS kind, (2010 + debtor_id % 20)::INT AS year FROM debtors WHERE debtor_id % 3 > 0")
def debt_map_links(spark: SparkSession, d: str) -> DataFrame:
    """Only delimited files count."""
    year = (F.lit(2010) + F.col("debtor_id") % 20).cast("string")
    title = F.when(F.col("debtor_id") % 2 == 0, F.concat(F.lit("Mapa anual da dívida de "), year, F.lit(" em CSV"))).otherwise(F.concat(F.lit("Precatórios pagos na proposta de "), year, F.lit("-2040 em CSV")))
    html = F.concat(F.lit("<a href='x"), F.when(F.col("debtor_id") % 3 > 0, F.lit(".csv?v=1")).otherwise(F.lit(".pdf")), F.lit("'>"), title, F.lit("</a>"))
    return pages.title_kinds(pages.with_context(_page(spark, d, html), "page", "html", 100), "trf2").select("page", "kind", "year")


@query(f"""SELECT debtor_id AS page, CASE WHEN debtor_id % 2 = 0 THEN 'federal' ELSE 'subnational' END AS section, CASE WHEN debtor_id % 6 = 3 AND debtor_id % 2 = 0 THEN NULL ELSE {_kinds(SECTIONED)}[debtor_id % 6 + 1] END AS kind FROM debtors
WHERE debtor_id % 6 < 5 AND NOT (debtor_id % 6 = 1 AND debtor_id % 2 = 1) AND NOT (debtor_id % 6 = 3 AND debtor_id % 2 = 0)""")
def sectioned_links(spark: SparkSession, d: str) -> DataFrame:
    """The last heading above a link tells its section."""
    other = F.when(F.col("debtor_id") % 2 == 0, F.lit("<h2>Precatórios de entes subnacionais</h2><h2>Precatórios <i>Federais</i></h2>")).otherwise(F.lit("<h2>Precatórios federais</h2><h2>Precatórios de Entes Subnacionais</h2>"))
    html = F.concat(other, F.lit("<a href='x.pdf'>"), _title(SECTIONED), F.lit("</a>"))
    return pages.sectioned_kinds(pages.with_context(_page(spark, d, html), "page", "html", 2000)).select("page", "section", "kind")


@query("SELECT debtor_id AS page, ['csv', 'xlsx', 'pdf'][debtor_id % 3 + 1] AS format, (2010 + debtor_id % 20)::INT AS year, (debtor_id % 12 + 1)::INT AS month FROM debtors WHERE debtor_id % 5 > 0")
def monthly_report_links(spark: SparkSession, d: str) -> DataFrame:
    """The last year and month named before a link; a year too far above does not count."""
    k = F.col("debtor_id")
    months = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
    month = F.get(F.array(*map(F.lit, months)), F.pmod(k, F.lit(12)).cast("int"))
    gap = F.when(k % 5 == 0, F.repeat(F.lit("<i>x</i>"), 300)).otherwise(F.lit(""))
    html = F.concat(F.lit("<h2>2009</h2><b>Maio</b> <a href='/about'>about</a><h2>"), (F.lit(2010) + k % 20).cast("string"), F.lit("</h2>"), gap, F.lit("<b>"), month, F.lit("</b> <a href='f."), F.get(F.array(*map(F.lit, ("csv", "xlsx", "pdf"))), F.pmod(k, F.lit(3)).cast("int")), F.lit("'>Anexo II</a>"))
    return pages.monthly_reports(pages.with_context(_page(spark, d, html), "page", "html", 1500)).select("page", "format", "year", "month")


@query(f"SELECT debtor_id AS page, {_kinds(DOCUMENTS)}[debtor_id % 7 + 1] AS kind, (2010 + debtor_id % 20)::INT AS year, ['state', 'sao_luis', 'other_debtors', NULL][debtor_id % 4 + 1] AS debtor_group FROM debtors WHERE debtor_id % 7 < 6")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    category = F.concat(F.lit("/hotsite/prec/item/"), (F.lit(6848) + F.col("debtor_id") % 4).cast("string"))
    html = F.concat(F.lit("<a href='/x.html'>Precatório</a><a href='doc.pdf'>"), _title(DOCUMENTS), F.lit("</a>"))
    found = pages.documents(pages.with_context(_page(spark, d, html), "page", "html", 0))
    groups = b.debtors(spark, d).select(F.col("debtor_id").alias("page"), pages.category_group(category).alias("debtor_group"))
    return found.join(groups, "page").select("page", "kind", "year", "debtor_group")


@query("""
, t AS (SELECT s_suppkey AS key, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END AS court, ['primary', 'enrichment', 'other'][s_suppkey % 3 + 1] AS priority, s_suppkey % 5 > 0 AS active FROM supplier)
SELECT key, court, priority, '/files/' || key || '/abc-Lista_' || key || '_final.pdf' AS path FROM t WHERE active AND priority IN ('primary', 'other') ORDER BY CASE priority WHEN 'primary' THEN 1 WHEN 'enrichment' THEN 2 ELSE 3 END, court NULLS LAST, key LIMIT 30""")
def sync_targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(k.alias("key"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey")).alias("court"), F.get(F.array(*map(F.lit, ("primary", "enrichment", "other"))), F.pmod(k, F.lit(3)).cast("int")).alias("priority"), (k % 5 > 0).alias("is_active"))
    name = F.concat(F.lit("Lista "), F.col("key").cast("string"), F.lit(" final.pdf"))
    return pages.targets(rows, limit=30, priority=["primary", "other"], court=[]).select("key", "court", "priority", pages.content_path("/files", "key", F.lit("abc"), name).alias("path"))


# Fixed values of the queries below: what the three sections of a debtor's page hold.
@query("""
, o AS (SELECT debtor_id AS page, name, 2020 + debtor_id % 6 AS year FROM debtors)
SELECT page, 'annual_map' AS kind, 'MAPA ANUAL de ' || year AS title, 'https://www.trf.example/mapas/downloadMapas/' || page AS url, year::INT AS year, NULL AS debtor_name, page::VARCHAR AS path_id FROM o WHERE page % 4 = 0
UNION ALL SELECT page, 'paid_precatorios', 'Lista Precatórios "Pagos" ' || year, 'https://www.trf.example/mapas/downloadMapas/' || page, year::INT, NULL, page::VARCHAR FROM o WHERE page % 4 = 1
UNION ALL SELECT page, 'federal_debt', 'TRF5 dívida federal ' || year || ' - ' || name || ' & Cia', 'https://www.trf.example/x/downloadDividaFederal/' || page, year::INT, name || ' & Cia', page::VARCHAR FROM o
UNION ALL SELECT page, 'federal_debt', 'TRF5 dívida federal ' || (year - 1) || ' - INSS', 'https://www.trf.example/x/downloadDividaFederal/' || (page + 1), (year - 1)::INT, 'INSS', (page + 1)::VARCHAR FROM o
UNION ALL SELECT page, 'state_municipal_chronological_order', 'TRF5 ordem cronológica estadual/municipal ' || year || ' - ' || name, 'https://www.trf.example/x/downloadDividaEstOrdem/' || page, year::INT, name, page::VARCHAR FROM o WHERE page % 3 > 0
UNION ALL SELECT page, 'state_municipal_special_regime_ec94', 'TRF5 regime especial EC94 estadual/municipal ' || year || ' - ' || name, 'https://www.trf.example/x/downloadDividaEstEntespc/' || page, year::INT, name, page::VARCHAR FROM o WHERE page % 3 > 0
UNION ALL SELECT page, 'state_municipal_special_regime_ec136', 'TRF5 regime especial EC136 estadual/municipal ' || (year + 1) || ' - ' || name, 'https://www.trf.example/x/downloadDividaEstEnte/' || page, (year + 1)::INT, name, page::VARCHAR FROM o""")
def panel_option_links(spark: SparkSession, d: str) -> DataFrame:
    """Options in nested panels: year, section and kind stand in headings above, some of them in panels that have closed."""
    k, name = F.col("debtor_id").cast("string"), F.col("name")
    year = lambda step=0: (F.lit(2020 + step) + F.col("debtor_id") % 6).cast("string")
    panel = lambda y, *options: F.concat(F.lit('<div class="panel"><div class="panel-heading"> '), y, F.lit(' </div><div class="panel-body"><div><SELECT name="s"><option value="">Selecione</option>'), *options, F.lit("</select></div></div></div>"))
    option = lambda path, number, text: F.concat(F.lit(f'<option value="/x/{path}/'), number, F.lit('" >'), text, F.lit("</option>"))
    title = F.when(F.col("debtor_id") % 4 == 0, F.concat(F.lit("MAPA  ANUAL de "), year())).when(F.col("debtor_id") % 4 == 1, F.concat(F.lit("Lista Precatórios &quot;Pagos&quot;  "), year())).otherwise(F.lit("Outro"))
    federal = F.concat(panel(year(), option("downloadDividaFederal", k, F.concat(F.lit("<b>"), name, F.lit("</b> &amp;\n Cia"))), option("downloadMapas", k, name)), F.lit('<div class="panel-heading">sem ano</div>'), panel(year(-1), option("downloadDividaFederal", (F.col("debtor_id") + 1).cast("string"), F.lit("INSS"))), F.lit("<select>"), option("downloadDividaFederal", F.lit("9"), F.lit("sem painel")), F.lit("</select>"))
    chronological = F.when(F.col("debtor_id") % 3 > 0, F.concat(F.lit("<div><h4 class='t'> Ordem Cronológica <i>geral</i></h4>"), panel(year(), option("downloadDividaEstOrdem", k, name), option("downloadDividaFederal", F.lit("8"), F.lit("outro endpoint"))), F.lit("</div><h4>Ente Devedor - Regime Especial (EC94/2016)</h4>"), panel(year(), option("downloadDividaEstEntespc", k, name)))).otherwise(F.lit("<h4>Outra lista</h4>"))
    state = F.concat(chronological, F.lit('<h4>Ente Devedor - Regime Especial (EC136/2025)</h4><div class="panel-heading">'), year(1), F.lit("</div>"), panel(F.lit("2001"), option("downloadDividaEstEnte", k, name)))
    html = F.concat(F.lit('<div><a href="/mapas/downloadMapas/'), k, F.lit("\" title='"), title, F.lit("'> "), year(), F.lit(" </a><!-- <h3>Federais</h3> --><h3>Federais</h3>"), federal, F.lit("<h3>Estaduais e Municipais</h3>"), state, F.lit('<div class="row" id="footer"><h4>Ordem Cronológica</h4>'), panel(F.lit("2002"), option("downloadDividaEstOrdem", F.lit("7"), F.lit("no rodapé"))), F.lit("</div></div>"))
    rows = b.debtors(spark, d).select(F.col("debtor_id").alias("page"), html.alias("html"))
    return structure.panel_links(rows, "page", "html", "https://www.trf.example/lista/pagina").drop("n")


@query("""
SELECT court_id AS page, 'Comunicado ' || debtor_id || ' & outros' AS title, CASE WHEN debtor_id % 3 > 0 THEN 'Resumo de ' || name END AS summary,
  'https://www.tj.example/Precatorios/Comunicados/Comunicado?codigoComunicado=' || debtor_id || '&pagina=' || (debtor_id % 7) AS url,
  CASE WHEN debtor_id % 5 > 0 THEN make_date(2024, (debtor_id % 12 + 1)::INT, (debtor_id % 28 + 1)::INT) END AS published_at, debtor_id::VARCHAR AS code, (debtor_id % 7)::INT AS page_number
FROM debtors WHERE debtor_id % 11 > 0""")
def communication_list(spark: SparkSession, d: str) -> DataFrame:
    """A list page per court, an entry per debtor; entries without a title go, and what stands in the side column."""
    k = F.col("debtor_id")
    day = F.when(k % 5 > 0, F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/2024"))).otherwise(F.lit("ontem"))
    title = F.when(k % 11 > 0, F.concat(F.lit("Comunicado <b>"), k.cast("string"), F.lit("</b> &#38; &#x6F;utros"))).otherwise(F.lit(" "))
    summary = F.when(k % 3 > 0, F.concat(F.lit("<p>Resumo de\n "), "name", F.lit("</p><p>mais</p>"))).otherwise(F.lit(""))
    link = F.concat(F.lit('"/Precatorios/Comunicados/Comunicado?codigoComunicado='), k.cast("string"), F.lit("&amp;pagina="), (k % 7).cast("string"), F.lit('"'))
    entry = F.concat(F.lit('<div class="lista-comunicados"><div><time> '), day, F.lit(" </time><h3><a href="), link, F.lit(">"), title, F.lit("</a></h3>"), summary, F.lit("</div></div>"))
    lists = b.debtors(spark, d).groupBy(F.col("court_id").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("entries"))
    html = F.concat(F.lit("<section><h3><a href='/x'>Comunicados</a></h3>"), "entries", F.lit('<div class="col-md-3"><h3><a href="/Precatorios/Comunicados/Comunicado?codigoComunicado=0">Lateral</a></h3></div></section>'))
    found = structure.communication_links(lists.select(F.col("page").alias("court"), html.alias("html")), "court", "html", "https://www.tj.example/Precatorios/Comunicados")
    return found.select(F.col("court").alias("page"), "title", "summary", "url", "published_at", "code", F.col("page").alias("page_number"))


@query("""
SELECT debtor_id AS page, 'Comunicado ' || debtor_id AS title, 'Pagamento a ' || name || '.' AS summary, make_date(2024, (debtor_id % 12 + 1)::INT, 5) AS published_at,
  'Comunicado ' || debtor_id || ' Pagamento a ' || name || '. Lista Anexo' || CASE WHEN debtor_id % 2 = 0 THEN ' dentro' ELSE '' END AS text, n, format, url, code
FROM debtors, (VALUES (1, 'file_fetch', 'https://www.tj.example/FileFetch.ashx?codigo=', ''), (2, 'pdf', 'https://www.tj.example/a/lista-', '.pdf')) AS f(n, format, before, after), LATERAL (SELECT before || debtor_id || after AS url, CASE WHEN n = 1 THEN debtor_id::VARCHAR END AS code)""")
def communication_details(spark: SparkSession, d: str) -> DataFrame:
    """A detail page per debtor: title, day, text up to the end of the block, and documents once each."""
    k = F.col("debtor_id")
    inner = F.when(k % 2 == 0, F.lit("<div><span> dentro</span></div>")).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<h3><strong>Tribunal</strong></h3><div class='comunicado'><h3>Comunicado <i>"), k.cast("string"), F.lit("</i></h3> <time>05/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/2024</time><p>Pagamento a "), "name",
        F.lit(".</p> <a href='/FileFetch.ashx?codigo="), k.cast("string"), F.lit("'>Lista</a> <a href='https://www.tj.example/a/lista-"), k.cast("string"), F.lit(".pdf'> Anexo</a><a href='/a/lista-"), k.cast("string"), F.lit(".pdf'></a><a href='/contato'></a>"), inner, F.lit("</div> </div><footer>rodapé</footer>"),
    )
    found = structure.communications(b.debtors(spark, d).select(k.alias("page"), html.alias("html")), "page", "html", "https://www.tj.example/c/d")
    text = F.regexp_replace("text", "05/[0-9]{2}/2024", "")
    each = found.select("page", "title", "summary", "published_at", text.alias("text"), F.posexplode("documents").alias("n", "x"))
    return each.select("page", "title", "summary", "published_at", "text", (F.col("n") + 1).alias("n"), "x.format", "x.url", "x.code")
