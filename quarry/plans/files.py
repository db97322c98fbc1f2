"""Queries over tribunal files: each layout is written from the canonical tables, read back by the library, and held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import bindings as b
from quarry.plans.queries import query
from quarry.sources import files, tribunals


def _brl(c: Column | str) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def _file(rows: DataFrame, key: str, order: str, line: Column, head: str = "", foot: str = "", by: str = "\n") -> DataFrame:
    """(key, text): the lines of each key in order, below a head."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(lines, by), F.lit(foot)).alias("text"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Assets with texts for their nature and preference, and their position within their file: 10,000 ids of a court, so that files are more, not longer, with more assets."""
    from pyspark.sql import Window

    words = {"alimentar": "Crédito Alimentar", "comum": "Comum", "unknown": "Indefinido"}
    nature = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    wish = F.get(F.array(*map(F.lit, ("Superpreferência", "Idoso", "Doença grave", "-"))), F.pmod("asset_id", F.lit(4)).cast("int"))
    return b.assets(spark, d).withColumn("court", F.concat_ws("-", "court", F.floor(F.col("asset_id") / 10_000).cast("string"))).select("court", "asset_id", "cnj_number", "debtor_name", "total", (F.lit(2000) + F.col("exercise_year") % 30).alias("exercise_year"), "nature", nature[F.col("nature")].alias("nature_text"), wish.alias("wish"), F.row_number().over(Window.partitionBy("court").orderBy("asset_id")).alias("place"))


def _before(spark: SparkSession, d: str) -> DataFrame:
    """(court, list, before): each file of _listed, the court whose list it is a part of, and how many rows of the list stand in the parts before it."""
    from pyspark.sql import Window

    name = F.concat_ws("-", "court", F.floor(F.col("asset_id") / 10_000).cast("string"))
    parts = b.assets(spark, d).groupBy(name.alias("file"), F.col("court").alias("list"), F.floor(F.col("asset_id") / 10_000).alias("part")).agg(F.count("*").alias("rows"))
    above = F.sum("rows").over(Window.partitionBy("list").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(F.col("file").alias("court"), "list", F.coalesce(above, F.lit(0)).alias("before"))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """_listed with places within the whole list of a court, whose files are its parts."""
    return _listed(spark, d).join(_before(spark, d).select("court", "before"), "court").withColumn("place", F.col("place") + F.col("before")).drop("before")


def _court() -> Column:
    """The court of a part's name."""
    return F.regexp_replace("court", "-[0-9]+$", "").alias("court")


_LISTED = ", listed AS (SELECT * EXCLUDE (exercise_year, court), court || '-' || (asset_id // 10000) AS court, (2000 + exercise_year % 30)::INT AS exercise_year, row_number() OVER (PARTITION BY court, asset_id // 10000 ORDER BY asset_id) AS place, ['superpreference', 'elderly', 'illness', NULL][asset_id % 4 + 1] AS preference FROM assets)"
_WHOLE = ", listed AS (SELECT * EXCLUDE (exercise_year), (2000 + exercise_year % 30)::INT AS exercise_year, row_number() OVER (PARTITION BY court ORDER BY asset_id) AS place, ['superpreference', 'elderly', 'illness', NULL][asset_id % 4 + 1] AS preference FROM assets)"


@query(_LISTED + " SELECT court, place AS queue_position, cnj_number, debtor_name || '; Ltda' AS debtor_name, total AS value, exercise_year AS year, nature, preference FROM listed")
def delimited_list(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(";", "place", "cnj_number", F.concat(F.lit('"'), "debtor_name", F.lit('; Ltda"')), F.concat(F.lit("R$ "), _brl("total")), "exercise_year", "nature_text", "wish")
    text = _file(_listed(spark, d), "court", "place", line, "\n  \nOrdem;Processo;Devedor;Valor Atualizado;Exercício;Natureza;Preferência\n", "\n\n")
    return tribunals.delimited_records(text, "court", "text").drop("n")


@query(_LISTED + " SELECT court, count(*) AS rows FROM listed GROUP BY court")
def delimited_row_counts(spark: SparkSession, d: str) -> DataFrame:
    text = _file(_listed(spark, d), "court", "place", F.concat_ws(",", "place", "cnj_number"), "Ordem,Processo\n\n", "\n \n")
    return files.data_rows(files.lines(text, "court", "text"), "court")


@query(_LISTED + " SELECT court, cnj_number, total AS value, exercise_year AS year FROM listed")
def html_table_list(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("<tr class='x'><td>"), "cnj_number", F.lit("</td><td><b>R$&nbsp;"), _brl("total"), F.lit("</b></td><td>"), "exercise_year", F.lit("</td></tr>"))
    text = _file(_listed(spark, d), "court", "place", line, "<html><table><tr><th>Processo</th><th>Valor</th><th>Ano</th></tr>", "</table></html>", "\n")
    return tribunals.records(files.html_records(text, "court", "text"), ["court"]).select("court", "cnj_number", "value", "year")


@query(_LISTED + " SELECT court, cnj_number, total AS value, CASE WHEN substr(cnj_number, 12, 4) >= '2000' THEN substr(cnj_number, 12, 4)::INT ELSE (2000 + place % 30)::INT END AS year, nature FROM listed WHERE place % 3 > 0")
def spreadsheet_html_list(spark: SparkSession, d: str) -> DataFrame:
    """Rows of fewer than seven cells are left out; a sequence of six digits gets its zero; the year is the first from 2000 on in a row."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    short = F.regexp_replace("cnj_number", r"^0(\d{6}-)", "$1")
    full = F.concat(cell(F.col("place").cast("string")), cell(short), cell(F.lit("Vara")), cell(_brl("total")), cell((F.lit(2000) + F.col("place") % 30).cast("string")), cell("nature_text"), cell(F.lit("x")))
    line = F.concat(F.lit("<tr>"), F.when(F.col("place") % 3 > 0, full).otherwise(cell(short)), F.lit("</tr>"))
    text = _file(_listed(spark, d), "court", "place", line, "<table>", "</table>")
    return tribunals.excel_html(text, "court", "text").select("court", "cnj_number", "value", "year", "nature")


@query(_WHOLE + " SELECT court, place * 2 AS n, CASE WHEN place % 3 > 0 THEN cnj_number END AS cnj_number, CASE WHEN place % 3 <> 1 THEN total END AS value FROM listed")
def loose_text_list(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a text that name a number, an amount or both; every other line names neither."""
    line = F.concat(F.lit("Relação geral\n"), F.when(F.col("place") % 3 > 0, F.concat(F.lit("Autos n. "), "cnj_number", F.lit(" -"))).otherwise(F.lit("Sem autos:")), F.when(F.col("place") % 3 != 1, F.concat(F.lit(" valor de "), _brl("total"), F.lit("."))).otherwise(F.lit(" pendente")))
    found = files.loose_records(_file(_whole(spark, d), "court", "place", line), "court", "text").join(_before(spark, d), "court")
    return found.select(F.col("list").alias("court"), (F.col("n") + 2 * F.col("before")).alias("n"), "cnj_number", "value")


@query(_WHOLE + " SELECT court, cnj_number, (total + 10)::DECIMAL(18,2) AS value, place AS queue_position, debtor_name, CASE WHEN asset_id % 4 = 0 THEN '109****' ELSE '' END AS masks, 2::BIGINT AS rows FROM listed")
def chronological_list(spark: SparkSession, d: str) -> DataFrame:
    """Each number twice, below a preamble."""
    one = F.concat_ws(";", F.col("place") + 1, "cnj_number", F.lit(""), F.lit("10,00"), F.lit("x"), F.when(F.col("asset_id") % 4 == 0, F.lit("109****")).otherwise(F.lit("")))
    two = F.concat_ws(";", "place", "cnj_number", "debtor_name", _brl("total"), F.lit("y"), F.lit(""))
    text = _file(_whole(spark, d), "court", "place", F.concat_ws("\n", one, two), "Tribunal;;;;;\nLista de 2024\nOrdem;Processo;Devedor;Valor;Vara;Documento\n")
    return tribunals.chronological_csv(text, "court", "text").select(_court(), "cnj_number", F.col("value").cast("decimal(18,2)").alias("value"), "queue_position", "debtor_name", F.array_join("masks", ",").alias("masks"), "rows")


@query("SELECT court, lpad((debtor_id % 100000)::VARCHAR, 5, '0') AS code, name, abs(reliability * 1000 + 0.25)::DECIMAL(18,2) AS amount_1, NULL::DECIMAL(18,2) AS amount_2, 7.5::DECIMAL(18,2) AS amount_11, (reliability / 100.0)::DECIMAL(10,4) AS percent_1 FROM debtors")
def budget_table(spark: SparkSession, d: str) -> DataFrame:
    rows = b.debtors(spark, d)
    amounts = [_brl(F.col("reliability") * 1000 + 0.25), F.lit("-"), *([F.lit("0,00")] * 8), F.lit("7,50")]
    line = F.concat_ws(";", F.lpad(F.pmod("debtor_id", F.lit(100_000)).cast("string"), 5, "0"), "name", *amounts, F.concat(F.col("reliability").cast("string"), F.lit("%")), F.lit("-"), F.lit("1,5 %"))
    text = _file(rows, "court", "debtor_id", line, "Unidade;Nome\n00000;Total;1,00\nx;y\n")
    return tribunals.positional_budget(text, "court", "text").select("court", "code", "name", "amount_1", "amount_2", "amount_11", "percent_1")


@query(_LISTED + " SELECT court, place AS queue_position, cnj_number, 'MUNICIPIO DE ' || upper(court) AS debtor_name, total AS value, nature, preference FROM listed")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    """Records of several lines under a debtor named once."""
    line = F.concat(F.col("place").cast("string"), F.lit(" "), "cnj_number", F.lit(" PRC\n  natureza "), "nature_text", F.lit("\n  valor "), _brl("total"), F.lit("\n  "), "wish")
    text = _file(_listed(spark, d), "court", "place", line)
    text = text.withColumn("text", F.concat(F.lit("Relatório\nEntidade devedora: MUNICIPIO DE "), F.upper("court"), F.lit("\n"), "text"))
    return tribunals.report_blocks(text, "court", "text").select("court", "queue_position", "cnj_number", "debtor_name", "value", "nature", "preference")


@query(_WHOLE + " SELECT court, place AS queue_position, cnj_number, total AS value, CASE WHEN place % 2 = 0 THEN 'alimentar' ELSE 'comum' END AS nature FROM listed")
def sectioned_list(spark: SparkSession, d: str) -> DataFrame:
    """Two sections; process numbers of 19 digits without their first zero."""
    rows = _whole(spark, d).withColumn("section", F.when(F.col("place") % 2 == 0, 0).otherwise(1)).withColumn("o", F.col("section") * 10_000_000 + F.col("place"))
    line = F.concat_ws(" ", "place", F.regexp_replace(F.regexp_replace("cnj_number", "[^0-9]", ""), "^0", ""), F.concat(F.lit("R$ "), _brl("total")), F.when(F.col("wish") != "-", F.col("wish")).otherwise(F.lit("")))
    per = rows.groupBy("court", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    titled = per.withColumn("t", F.concat(F.when(F.col("section") == 0, F.lit("CRÉDITOS DE NATUREZA ALIMENTAR\n")).otherwise(F.lit("CRÉDITOS COMUNS\n")), "t"))
    return tribunals.sectioned_text(_file(titled, "court", "section", F.col("t")), "court", "text").select(_court(), "queue_position", "cnj_number", "value", "nature")


@query("""SELECT court, 2024 AS year, CASE WHEN debtor_id % 3 = 0 THEN 'Municipality IBGE ' || lpad(debtor_id::VARCHAR, 7, '0') || ' - RJ' WHEN debtor_id % 3 = 1 THEN 'MUNICIPIO DE X' || debtor_id ELSE 'PREFEITURA DE LINHA ' || debtor_id END AS debtor_name,
  debtor_id % 2 = 0 AS special, (debtor_id + 0.5)::DECIMAL(18,2) AS debt_before, (debtor_id + 1100.25)::DECIMAL(18,2) AS open_stock FROM debtors""")
def annual_debt_map(spark: SparkSession, d: str) -> DataFrame:
    """Names on the line, on the two lines before, or only as a number of the place."""
    key = F.col("debtor_id")
    name = F.when(key % 3 == 1, F.concat(F.lit("MUNICIPIO DE X"), key.cast("string"), F.lit(" "))).otherwise(F.lit(""))
    before = F.when(key % 3 == 2, F.concat(F.lit("PREFEITURA DE\nLINHA "), key.cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    regime = F.when(key % 2 == 0, F.lit("ESPECIAL")).otherwise(F.lit("GERAL"))
    ibge = F.concat(F.lpad(key.cast("string"), 7, "0"), F.lit(" "))
    line = F.concat(before, F.lit("TJRJ 2024 MUNICIPAL RJ "), ibge, regime, F.lit(" DIRETA "), name, F.lit("R$ "), _brl(key + 0.5), F.lit(" R$ 1,00 R$ 100,00 R$ "), _brl(key + 1000.25))
    found = tribunals.annual_map(_file(b.debtors(spark, d), "court", "debtor_id", line, "Mapa\nMapa anual\nMapa anual da dívida\nTJRJ 2024 MUNICIPAL RJ 0000000 GERAL DIRETA TOTAL R$ 0,00 R$ 0,00 R$ 0,00 R$ 0,00\n"), "court", "text")
    return found.where("debtor_name <> 'TOTAL'").select("court", "year", "debtor_name", "special", "debt_before", F.col("open_stock").cast("decimal(18,2)").alias("open_stock"))


@query(_LISTED + " SELECT court, place AS queue_position, cnj_number, created_at + INTERVAL 13 HOUR + INTERVAL 30 MINUTE AS presented_at, nature, total AS value, debtor_name FROM listed")
def printed_list(spark: SparkSession, d: str) -> DataFrame:
    """Local times, three hours before UTC (two in the summers of those years)."""
    rows = _listed(spark, d).join(b.read(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), "o_orderdate"), "asset_id")
    at = F.from_utc_timestamp(F.col("o_orderdate") + F.expr("interval 13 hours 30 minutes"), "America/Sao_Paulo")
    line = F.concat_ws(" ", "place", "cnj_number", F.date_format(at, "dd/MM/yyyy HH:mm:ss"), F.upper("nature"), _brl("total"), "debtor_name")
    return tribunals.pdf_rows(_file(rows, "court", "place", line, "Lista\n"), "court", "text").select("court", "queue_position", "cnj_number", "presented_at", "nature", "value", "debtor_name")


@query(_WHOLE + " SELECT court, cnj_number, debtor_name, total AS value, exercise_year AS year, place AS queue_position FROM listed")
def json_page_list(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("cnj_number").alias("Número do Processo"), F.col("debtor_name").alias("enteDevedor"), F.col("debtor_name").alias("Ente Devedor"), _brl("total").alias("VALOR"), F.col("exercise_year").cast("string").alias("Exercício"), F.col("place").cast("string").alias("ordem"))
    pages = _whole(spark, d).groupBy("court", (F.col("place") % 5).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("content"))).alias("payload"))
    return tribunals.json_pages(pages, ["court"], "payload").select(_court(), "cnj_number", "debtor_name", "value", "year", "queue_position")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """API hits: subjects as an object, a list, and a list in it; every seventh number is broken."""
    subject = lambda k: F.concat(F.lit(f'{{"codigo":{k},"nome":"Subject {k} of '), F.col("asset_id").cast("string"), F.lit('"}'))
    number = F.when(F.col("asset_id") % 7 == 0, F.lit("123")).otherwise(F.regexp_replace("cnj_number", "[^0-9]", ""))
    payload = F.concat(
        F.lit('{"numeroProcesso":"'), number, F.lit('","tribunal":"TRF1","dataAjuizamento":"'), F.date_format("created_at", "yyyyMMddHHmmss"), F.lit('","classe":{"codigo":1265,"nome":"Precatório"},"assuntos":['),
        subject(1), F.lit(",["), subject(2), F.lit(",["), subject(3), F.lit('],"text"],7],"movimentos":[{"codigo":26,"nome":"Distribuição","dataHora":"2020-01-02T03:04:05Z"},{"codigo":12457,"nome":"Expedição","dataHora":"20200203","complementosTabelados":[{"codigo":1,"valor":"5","nome":"grau"},{"codigo":2,"valor":"6","nome":"tipo"}]}]}'),
    )
    return files.spread(b.assets(spark, d), "asset_id").select(payload.alias("payload"))


@query("SELECT cnj_number, 'trf1' AS court, created_at AS filed_at, 1265 AS class_code, 'Precatório' AS class_name FROM assets WHERE asset_id % 7 > 0")
def process_hits(spark: SparkSession, d: str) -> DataFrame:
    return tribunals.process_hits(_hits(spark, d), "payload")["processes"]


@query("SELECT cnj_number, k AS position, k AS code, 'Subject ' || k || ' of ' || asset_id AS name FROM assets, (VALUES (1), (2), (3)) v(k) WHERE asset_id % 7 > 0")
def process_subjects(spark: SparkSession, d: str) -> DataFrame:
    return tribunals.process_hits(_hits(spark, d), "payload")["subjects"]


@query("""SELECT cnj_number, m.position, m.code, m.moment AS "at", c.value FROM assets, (VALUES (1, 26, TIMESTAMP '2020-01-02 03:04:05'), (2, 12457, TIMESTAMP '2020-02-03')) m(position, code, moment) LEFT JOIN (VALUES (2, '5'), (2, '6')) c(position, value) ON c.position = m.position WHERE asset_id % 7 > 0""")
def process_movements(spark: SparkSession, d: str) -> DataFrame:
    found = tribunals.process_hits(_hits(spark, d), "payload")
    per = found["complements"].select("cnj_number", "idempotency_key", "value")
    return found["movements"].join(per, ["cnj_number", "idempotency_key"], "left").select("cnj_number", "position", "code", "at", "value")


_BUDGET = """, rows AS (SELECT asset_id, court, asset_id % 9 = 0 AS no_key, asset_id % 8 = 0 AS no_value, cnj_number, exercise_year, debtor_name, total FROM assets),
checked AS (SELECT *, asset_id % 11 = 0 AS no_debtor, (asset_id % 11 = 0)::INT + no_value::INT AS missing FROM rows)"""


def _budget(spark: SparkSession, d: str) -> DataFrame:
    row = F.create_map(
        F.lit("chave"), F.when(F.col("asset_id") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("K"), F.col("asset_id").cast("string"))), F.lit("cnj"), F.when(F.col("asset_id") % 2 == 0, F.lit("1")).otherwise(F.col("cnj_number")), F.lit("exercicio"), F.col("exercise_year").cast("string"),
        F.lit("nome_da_uo_executada"), F.when(F.col("asset_id") % 11 > 0, F.concat(F.lit(" "), "debtor_name")).otherwise(F.lit("  ")), F.lit("valor_original_do_precatorio"), F.when(F.col("asset_id") % 8 == 0, F.lit("x")).otherwise(F.concat(F.lit("R$ "), _brl("total"))), F.lit("valor_atualizado"), F.concat(F.regexp_replace(_brl("total"), r"\.", ""), F.lit("999")),
        F.lit("indiceatualizacao"), F.lit("1,0315237099479411"), F.lit("tributario"), F.lit("Não"), F.lit("fundef"), F.lit("SIM"), F.lit("data_de_ajuizamento_da_acao_originaria"), F.date_format("created_at", "dd/MM/yyyy"), F.lit("data_da_autuacao"), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("valor"), F.lit(None).cast("string"),
    )
    return tribunals.budget_row(b.assets(spark, d).select("court", "asset_id", "created_at", row.alias("row")))


@query(_BUDGET + """ SELECT asset_id, CASE WHEN NOT no_key THEN 'K' || asset_id END AS external_id, CASE WHEN asset_id % 2 = 1 THEN cnj_number END AS cnj_number, exercise_year, CASE WHEN NOT no_debtor THEN debtor_name ELSE '' END AS debtor_name, CASE WHEN NOT no_value THEN total END AS face_value, total AS updated_value,
  1.0315237099479411::DECIMAL(38,16) AS index_value, false AS is_tax, true AS is_fundef, a.created_at::DATE AS filed_on, a.created_at::DATE AS registered_on, missing = 0 AS valid FROM checked JOIN (SELECT asset_id, created_at FROM assets) a USING (asset_id)""")
def open_data_rows(spark: SparkSession, d: str) -> DataFrame:
    return _budget(spark, d).select("asset_id", "external_id", "cnj_number", "exercise_year", "debtor_name", "face_value", "updated_value", "index_value", "is_tax", "is_fundef", "filed_on", "registered_on", "valid")


@query(_BUDGET + """, imports AS (SELECT court || '-' || (asset_id % 500) AS import, missing FROM checked)
SELECT import, count(*) AS total, count(*) FILTER (missing = 0) AS imported, count(*) FILTER (missing > 0) AS errors, CASE WHEN count(*) FILTER (missing > 0) = 0 THEN 'completed' WHEN count(*) FILTER (missing = 0) > 0 THEN 'partial' ELSE 'failed' END AS status FROM imports GROUP BY import
UNION ALL SELECT 'empty', 0, 0, 0, 'completed'""")
def import_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Small imports of a court, and one without rows."""
    rows = _budget(spark, d).select(F.concat_ws("-", "court", (F.col("asset_id") % 500).cast("string")).alias("import"), "valid")
    return tribunals.import_status(rows.unionAll(spark.createDataFrame([("empty", None)], "import string, valid boolean")), "import")


@query("""
, t AS (SELECT p_partkey AS id, p_partkey % 5 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'html' WHEN 3 THEN 'pdf' ELSE 'unknown' END AS format, 'Órgão € ' || id AS decoded FROM t""")
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Media type first, then the name, then the address; bytes that are not UTF-8 are windows-1252."""
    k, none = F.col("p_partkey") % 5, F.lit(None).cast("string")
    media = F.when(k == 0, F.lit("Text/CSV; charset=utf-8")).when(k == 2, F.lit("application/octet-stream"))
    name = F.when(k == 0, F.lit("x.pdf")).when(k == 1, F.lit("Lista.XLSX")).otherwise(none)
    url = F.when(k == 1, F.lit("https://a/b.csv")).when(k == 2, F.lit("https://a/page.htm?x=1")).when(k == 3, F.lit("https://a/file.PDF#1")).otherwise(F.lit("https://a/b"))
    text = F.concat(F.lit("Órgão € "), F.col("p_partkey").cast("string"))
    raw = F.when(k % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(F.translate(text, "€", "\x80"), "ISO-8859-1"))
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), files.detect_format(media, name, url).alias("format"), files.decoded(raw).alias("decoded"))


@query("""
SELECT debtor_id AS page, 'x' || debtor_id || '.csv' AS href, 1 AS rank, 'csv' AS format, 2000 + debtor_id % 30 AS year, CASE WHEN debtor_id % 2 = 0 THEN 'Listas de pagamento' END AS heading FROM debtors
UNION ALL SELECT debtor_id, '/mapa/' || debtor_id, 2, 'unknown', NULL, CASE WHEN debtor_id % 2 = 0 THEN 'Listas de pagamento' END FROM debtors""")
def ranked_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Relevant links of a page with their headings; noise and repeated addresses go; a heading far above does not count."""
    key = F.col("debtor_id").cast("string")
    gap = F.when(F.col("debtor_id") % 2 == 0, F.lit("")).otherwise(F.repeat(F.lit("<p>texto</p>"), 250))
    page = F.concat(
        F.lit("<h2>Listas de <b>pagamento</b></h2>"), gap, F.lit("<a href='/mapa/"), key, F.lit("'>Mapa</a> <a class=x href=\"x"), key, F.lit('.csv">Lista de precat&oacute;rios'.replace("&oacute;", "ó")), F.lit(" "), (F.lit(2000) + F.col("debtor_id") % 30).cast("string"), F.lit("</a><a href='x"), key,
        F.lit(".csv'>de novo: precatório</a><a href='/login'>Login precatório</a><a href='mailto:a@b'>Lista</a>"),
    )
    rows = b.debtors(spark, d).select(F.col("debtor_id").alias("page"), page.alias("html"))
    found = files.preceding_heading(rows, "page", "html", r"(?is)<h2\b[^>]*>(.*?)</h2\s*>")
    return files.ranked_links(found, "page").select("page", "href", "rank", "format", "year", "heading")


@query(_LISTED + """, s AS (SELECT asset_id, CASE WHEN asset_id % 6 < 4 THEN place END AS q, ['chronological_list', 'direct_agreement', 'preferential_lot', 'paid_or_payment_process', 'change_notice', NULL][(asset_id // 8) % 6 + 1] AS kind FROM listed)
SELECT asset_id, concat_ws(',', CASE WHEN q <= 100 THEN 'queue_position_favorable' END, CASE WHEN q IS NULL AND kind = 'chronological_list' THEN 'queue_position_unknown' END, CASE kind WHEN 'direct_agreement' THEN 'direct_agreement_window' WHEN 'preferential_lot' THEN 'preferential_queue' WHEN 'paid_or_payment_process' THEN 'payment_process_detected' END) AS signals FROM s""")
def list_signals(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of lists in turn, with and without places."""
    kinds = ("chronological_list", "direct_agreement", "preferential_lot", "paid_or_payment_process", "change_notice", None)
    rows = _listed(spark, d).withColumns({"queue_position": F.when(F.col("asset_id") % 6 < 4, F.col("place")), "source_kind": F.get(F.array(*map(F.lit, kinds)), F.pmod(F.floor(F.col("asset_id") / 8), F.lit(6)).cast("int"))})
    return rows.select("asset_id", F.array_join(tribunals.operational_signals(), ",").alias("signals"))


@query(_LISTED + """, s AS (SELECT *, row_number() OVER (PARTITION BY court ORDER BY place) AS k FROM listed WHERE asset_id % 9 > 0)
SELECT court, CASE WHEN asset_id % 4 = 0 THEN k ELSE 1000 + place END::INT AS queue_position, exercise_year AS year, cnj_number, total AS value, CASE asset_id % 3 WHEN 0 THEN 'superpreferential' WHEN 2 THEN 'alimentar_balance' END AS preference, CASE WHEN asset_id % 3 = 1 THEN 'comum' ELSE 'alimentar' END AS nature FROM s""")
def numbered_budget_list(spark: SparkSession, d: str) -> DataFrame:
    """Below a preamble; rows without a number go, rows without a position count what stays."""
    k = F.col("asset_id")
    number = F.when(k % 9 > 0, F.col("cnj_number")).otherwise(F.lit(" "))
    basis = F.when(k % 3 == 0, F.lit("Art. 102, § 2º, inciso II")).when(k % 3 == 1, F.lit("Créditos não alimentares")).otherwise(F.lit("inciso IV"))
    line = F.concat_ws(";", F.when(k % 4 > 0, (F.lit(1000) + F.col("place")).cast("string")).otherwise(F.lit("")), F.col("exercise_year").cast("string"), number, basis, F.concat(F.lit("R$ "), _brl("total")))
    text = _file(_listed(spark, d), "court", "place", line, "Tribunal\n\nRelação de precatórios\nNº de Ordem Cronológica;Proposta;Número do Precatório;Base legal para enquadramento na ordem cronológica;Parcela devida\n\n")
    return tribunals.budget_list(text, "court", "text").select("court", "queue_position", "year", "cnj_number", "value", "preference", "nature")


@query(_LISTED + """, s AS (SELECT *, asset_id % 6 AS k FROM listed)
SELECT court, asset_id, CASE WHEN k < 2 THEN cnj_number END AS cnj_number, CASE k WHEN 0 THEN cnj_number WHEN 1 THEN cnj_number WHEN 2 THEN 'R' || asset_id WHEN 3 THEN 'row' ELSE 'Q' || asset_id END AS process, CASE k WHEN 2 THEN 'R' || asset_id END AS requisition, CASE WHEN k <> 4 THEN total END AS value,
  CASE WHEN k = 1 THEN NULL ELSE place END::INT AS queue_position, CASE WHEN k IN (0, 2) THEN exercise_year WHEN k = 3 THEN 2024 WHEN k = 1 AND substr(cnj_number, 12, 4) >= '2000' THEN substr(cnj_number, 12, 4)::INT ELSE 2031 END::INT AS year, debtor_name, CASE WHEN k = 3 THEN DATE '2024-05-06' END AS filed_on FROM s WHERE k <> 5""")
def requisition_list(spark: SparkSession, d: str) -> DataFrame:
    """A year is in its column, else anywhere in the row, else the file's. Names of columns in turn: a process, a number in any cell, a requisition, only an amount, only a precatório; rows with none of them go."""
    k, s = F.col("asset_id") % 6, F.col("asset_id").cast("string")
    only = lambda test, value: F.when(test, value)
    row = F.create_map(
        F.lit("processo"), only(k == 0, F.col("cnj_number")), F.lit("observacao"), only(k == 1, F.concat(F.lit("ver "), "cnj_number")), F.lit("requisicao"), only(k == 2, F.concat(F.lit("R"), s)), F.lit("prc"), only(k == 4, F.concat(F.lit("Q"), s)), F.lit("valor"), only((k < 4), _brl("total")),
        F.lit("ordem"), only(k != 1, F.col("place").cast("string")), F.lit("exercicio"), only(k.isin(0, 2), F.col("exercise_year").cast("string")), F.lit("devedor"), F.col("debtor_name"), F.lit("autuacao"), only(k == 3, F.lit("06/05/2024")),
    )
    rows = _listed(spark, d).select("court", "asset_id", row.alias("row"))
    out = tribunals.requisitions(rows, ["court", "asset_id"], fallback_year=F.lit(2031))
    return out.withColumn("process", F.when(F.col("process").startswith("row:") & (F.length("process") == 68), F.lit("row")).otherwise(F.col("process"))).select("court", "asset_id", "cnj_number", "process", "requisition", "value", "queue_position", "year", "debtor_name", "filed_on")


@query("""
, m AS (SELECT court, debtor_id, name, debtor_id % 2 = 0 AS special, (debtor_id % 90 + 0.5)::DECIMAL(18,2) AS before, (debtor_id % 130)::DECIMAL(18,2) AS paid, 2020 + debtor_id % 4 AS year FROM debtors)
SELECT court, 'MUNICIPIO DE X' || debtor_id AS debtor_name, 'tjrj_annual_map:' || year AS source, make_date(year::INT, 1, 1) AS period_start, make_date(year::INT, 12, 31) AS period_end, 1 AS sample_size, paid AS paid_volume, (before + 7 + 10)::DECIMAL(18,2) AS open_debt_stock, special AS regime_special,
  floor(CASE WHEN special THEN 45 ELSE 68 END + 25 * least(paid / (before + 10)::DOUBLE, 1) + 0.5)::INT AS reliability_score FROM m""")
def payment_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Annual maps as statistics of debtors; a map that says a debtor twice keeps the later line."""
    key = F.col("debtor_id")
    row = lambda paid, before: F.concat(F.lit("TJRJ "), (F.lit(2020) + key % 4).cast("string"), F.lit(" MUNICIPAL RJ "), F.lpad(key.cast("string"), 7, "0"), F.lit(" "), F.when(key % 2 == 0, F.lit("ESPECIAL")).otherwise(F.lit("GERAL")), F.lit(" DIRETA MUNICIPIO DE X"), key.cast("string"), F.lit(" R$ "), _brl(before), F.lit(" R$ "), _brl(paid), F.lit(" R$ 10,00 R$ "), _brl(before + 7))
    line = F.concat(row(key * 3, key), F.lit("\n"), row(key % 130, key % 90 + 0.5))
    found = tribunals.annual_map(_file(b.debtors(spark, d), "court", "debtor_id", line, "Mapa\n"), "court", "text")
    out = tribunals.payment_stats(found, ["court"])
    return out.withColumns({"paid_volume": F.col("paid_volume").cast("decimal(18,2)"), "open_debt_stock": F.col("open_debt_stock").cast("decimal(18,2)")})
