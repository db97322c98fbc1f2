"""Link pages of courts and open-data portals: kinds of links by their titles, dates above them, selections, and targets to visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import code_key, col, search_text, strip_tags
from quarry.sources.files import computed, detect_format

# Per source, kinds of links by a pattern of the folded title (group 1: the year, if there is a group), the first that holds.
TITLES = {
    "open_data": (("expedition_file", r"precatorios expedidos para (\d{4})"), ("budget_history", r"serie historica de dados orcamentarios"), ("correction_index", r"indice de correcao monetaria")),
    "trf2": (("annual_debt_map", r"mapa anual da divida de (\d{4}) em csv"), ("paid_precatorios", r"precatorios pagos na proposta de (\d{4})(?:-\d{4})? em csv")),
}
# Kinds of the first court's links: section they must or must not stand in, and words of the title, all of which must be there.
SECTIONED = (
    ("federal_budget_proposal", None, None, ("proposta de", "art 12")), ("federal_debt_map", None, "subnational", ("mapa da situacao da divida", "referencia")), ("subnational_budget_proposal", None, None, ("proposta de", "art 85")),
    ("subnational_repasses", None, None, ("repasses entidades devedoras estaduais e municipais",)), ("subnational_consolidated_debt", None, None, ("divida consolidada ate",)),
    ("subnational_debt_map", "subnational", None, ("mapa da situacao da divida de precatorios",)),
)
SECTIONS = (("federal", "precatorios federais"), ("subnational", "precatorios de entes subnacionais"))
# Kinds of documents by words of title and address as a code key, the first that holds; groups of debtors by the number of a category page.
DOCUMENTS = (
    ("direct_agreement", ("ACORDO_DIRETO",)), ("preferential_lot", ("PREFERENCIAL",)), ("change_notice", ("ALTERACOES",)), ("paid_or_payment_process", ("PAGO", "PAGAMENTO")),
    ("chronological_list", ("LISTA_UNIFICADA", "ORDEM_CRONOLOGICA", "LISTA_CRONOLOGICA", "ATUALIZADA")), ("other_precatorio_report", ()),
)
CATEGORIES = {"6848": "state", "6849": "sao_luis", "6850": "other_debtors"}
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def with_context(df: DataFrame, key: str, html: str, reach: int) -> DataFrame:
    """(key, n, href, title, before): the anchors of a page, in order, each with up to reach characters of HTML before it."""
    anchor = r"(?is)<a\s+[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>"
    parts = F.arrays_zip(F.split(F.col(html), anchor, -1).alias("gap"), F.regexp_extract_all(html, F.lit(anchor), F.lit(0)).alias("a"))
    rows = df.select(key, html, F.posexplode(F.filter(parts, lambda x: x["a"].isNotNull())).alias("n", "x"), F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["a"]), F.lit(0))).alias("sizes"))
    at = F.aggregate(F.slice("sizes", 1, F.col("n")), F.lit(0), lambda s, x: s + x) + F.length("x.gap")
    begin = F.greatest(at - reach, F.lit(0))
    out = rows.select(key, "n", F.trim(strip_tags(F.regexp_extract("x.a", anchor, 1))).alias("href"), strip_tags(F.regexp_extract("x.a", anchor, 2)).alias("title"), F.substr(html, begin + 1, at - begin).alias("before"))
    return computed(out, "href", "title")


def title_kinds(links: DataFrame, source: str) -> DataFrame:
    """Links of a known kind, with kind and year (null where the title has none); the first of each address."""
    t, kind, year = F.col("_t"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern in reversed(TITLES[source]):
        kind = F.when(t.rlike(pattern), F.lit(name)).otherwise(kind)
        year = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1).try_cast("int") if "(" in pattern else F.lit(None).cast("int")).otherwise(year)
    folded = computed(links.withColumn("_t", search_text("title")), "_t")
    rows = computed(folded.withColumns({"kind": kind, "year": year}), "kind", "year").drop("_t").where("kind is not null")
    return rows.where(F.col("href").rlike(r"(?i)\.csv(?:$|\?)")) if source == "trf2" else rows


def sectioned_kinds(links: DataFrame) -> DataFrame:
    """Links (title, before) of a known kind, by the title and the section whose heading is the last above them."""
    plain = lambda c: F.trim(F.regexp_replace(search_text(c), r"[^a-z0-9]+", " "))
    folded = computed(links.withColumns({"_above": plain(strip_tags("before")), "_t": plain("title")}), "_above", "_t")
    above, t = F.col("_above"), F.col("_t")
    last = lambda words: F.length(above) - F.length(F.substring_index(above, words, -1))  # noqa: E731  0 where the words are not there
    (first, one), (second, two) = SECTIONS
    section = F.when(last(two) > last(one), F.lit(second)).when(last(one) > 0, F.lit(first))
    kind = F.lit(None).cast("string")
    for name, inside, outside, words in reversed(SECTIONED):
        test = F.lit(True)
        for word in words:
            test = test & F.contains(t, F.lit(word))
        test = test & (section.eqNullSafe(inside) if inside else F.lit(True)) & (~section.eqNullSafe(outside) if outside else F.lit(True))
        kind = F.when(test, F.lit(name)).otherwise(kind)
    return computed(folded.withColumns({"section": section, "kind": kind}), "section", "kind").drop("_above", "_t").where("kind is not null")


def monthly_reports(links: DataFrame) -> DataFrame:
    """Links (title, href, before) to csv, xlsx or pdf files, with the last year and the last month named before them; links without either go."""
    value, text = F.lower(F.concat_ws(" ", "title", "href")), strip_tags("before")
    kind = F.lit(None).cast("string")
    for name in ("pdf", "xlsx", "csv"):
        kind = F.when(value.rlike(rf"\b{name}\b|\.{name}(?:$|\?)"), F.lit(name)).otherwise(kind)
    year = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), F.lit(-1)).cast("int")
    month = F.try_element_at(F.regexp_extract_all(search_text(text), F.lit("|".join(MONTHS)), F.lit(0)), F.lit(-1))
    out = links.withColumns({"format": kind, "year": year, "month": F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")})
    return out.where("format is not null and year is not null and month > 0")


def documents(links: DataFrame) -> DataFrame:
    """Links to documents of precatórios, with kind, format and the first year in title or address."""
    links = computed(links.withColumn("_words", code_key(F.concat_ws(" ", "title", "href"))), "_words")
    haystack = F.col("_words")
    kind = F.lit(DOCUMENTS[-1][0])
    for name, words in reversed(DOCUMENTS[:-1]):
        test = F.lit(False)
        for word in words:
            test = test | F.contains(haystack, F.lit(word))
        kind = F.when(test, F.lit(name)).otherwise(kind)
    out = links.withColumns({"kind": kind, "format": detect_format(F.lit(None).cast("string"), F.lit(None).cast("string"), "href"), "year": F.regexp_extract(F.concat_ws(" ", "title", "href"), r"(20\d{2})", 1).try_cast("int")})
    return out.where(F.col("format").isin("pdf", "csv", "xlsx", "xls") & (F.contains(haystack, F.lit("PRECATORIO")) | F.contains(haystack, F.lit("ORDEM_CRONOLOGICA")))).drop("_words")


def category_group(href: Column | str) -> Column:
    """Group of debtors of a category page, null for other pages."""
    groups = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return groups[F.regexp_extract(col(href), r"/hotsite/prec/item/(\d+)", 1)]


def selected(links: DataFrame, limit: int | None = None, undated_kinds: Sequence[str] = (), **wanted: Sequence) -> DataFrame:
    """Links with one of the wanted values in each named column, the first `limit` of a page; undated_kinds stay whatever the years."""
    for column, values in wanted.items():
        if values:
            test = F.coalesce(F.col(column).isin(*values), F.lit(False))
            links = links.where(test | F.col("kind").isin(*undated_kinds) if column == "year" and undated_kinds else test)
    return links.orderBy("n").limit(limit) if limit else links


def targets(registry: DataFrame, limit: int | None = None, **wanted: Sequence) -> DataFrame:
    """Active targets with one of the wanted values in each named column, primary ones first, then enrichment, by court and key."""
    out = registry.where("is_active")
    for column, values in wanted.items():
        out = out.where(F.col(column).isin(*values)) if values else out
    rank = F.when(F.col("priority") == "primary", 1).when(F.col("priority") == "enrichment", 2).otherwise(3)
    out = out.orderBy(rank, F.asc_nulls_last("court"), "key")
    return out.limit(int(limit)) if limit else out


def content_path(root: str, tenant: Column | str, checksum: Column | str, name: Column | str) -> Column:
    """Where a file is kept, by its content: the same bytes under one name have one place."""
    safe = F.regexp_replace(col(name), r"[^A-Za-z0-9._-]+", "_")
    return F.concat_ws("/", F.lit(root.rstrip("/")), col(tenant).cast("string"), F.concat_ws("-", col(checksum), safe))
