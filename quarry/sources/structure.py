"""Nested structure of pages: tags with the depth at which they stand, regions that they open and close, and what stands in which.

A page becomes a row per tag. A running sum of what opens and closes gives each name its depth; an opening tag and
the next tag of its name at its level are a region. All of it is windows and joins within a page, so pages are
spread and no page is parsed by a function of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import col, collapse, decode_entities, fold, strip_tags

# Sections of the panels' page, by the text of their h3; what ends the last; kinds of lists below the h4 of a section.
FEDERAL, STATE, FOOTER = "Federais", "Estaduais e Municipais", "footer"
PANELS = (
    ("federal_debt", FEDERAL, None, "downloadDividaFederal", "TRF5 dívida federal"),
    ("state_municipal_chronological_order", STATE, r"(?i)^Ordem Cronol[óo]gica", "downloadDividaEstOrdem", "TRF5 ordem cronológica estadual/municipal"),
    ("state_municipal_special_regime_ec94", STATE, r"(?i)^Ente Devedor - Regime Especial \(EC94/2016\)$", "downloadDividaEstEntespc", "TRF5 regime especial EC94 estadual/municipal"),
    ("state_municipal_special_regime_ec136", STATE, r"(?i)^Ente Devedor - Regime Especial \(EC136/2025\)$", "downloadDividaEstEnte", "TRF5 regime especial EC136 estadual/municipal"),
)
# Kinds of maps by words of the folded title, all of which must be there; the first that holds.
MAPS = (("paid_precatorios", ("LISTA PRECATORIOS", "PAGOS")), ("consolidated_report", ("DEMONSTRATIVO",)), ("indicators", ("INDICADORES",)), ("annual_map", ("MAPA ANUAL",)))
#: Characters of a communication's text that are kept (fixed).
COMMUNICATION_TEXT = 10_000


def attribute(tag: Column | str, name: str) -> Column:
    """Value of a quoted attribute of a tag, empty if it has none."""
    return F.regexp_extract(col(tag), rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def absolute(href: Column | str, base: str) -> Column:
    """An address as the page at `base` means it."""
    href = F.trim(decode_entities(href))
    scheme, rest = base.split("://", 1)
    host = rest.split("/")[0]
    folder = base.rsplit("/", 1)[0] if "/" in rest else base
    return F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href)).when(href.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), href)).otherwise(F.concat(F.lit(f"{folder}/"), href))


def numeric_references(x: Column | str) -> Column:
    """Text with its numeric character references (&#233; and &#xe9;) decoded; what names no character stays."""
    parts = F.split(col(x), r"&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")

    def decoded(part: Column) -> Column:
        number = F.substring_index(part, ";", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).cast("long")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.substr(part, F.length(number) + 2))).otherwise(F.concat(F.lit("&#"), part))

    return F.when(col(x).contains("&#"), F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, F.size(parts)), decoded)), "")).otherwise(col(x))


def tags(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, tag, name, opens, text, depth): the tags of a page in order, each with the text up to the next.

    depth: how many tags of its name are open behind it. Comments are no tags. A null or empty page has none.
    """
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(r"(?s)<[/a-zA-Z][^>]*>[^<]*"), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("n", "piece"))
    tag = F.regexp_extract("piece", r"(?s)^<[^>]*>", 0)
    rows = rows.select(key, "n", tag.alias("tag"), F.lower(F.regexp_extract("piece", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"), (~F.col("piece").startswith("</")).alias("opens"), F.substr("piece", F.length(tag) + 1).alias("text"))
    step = F.when(F.col("opens"), F.when(F.col("tag").endswith("/>"), 0).otherwise(1)).otherwise(-1)
    return rows.withColumn("depth", F.sum(step).over(Window.partitionBy(key, "name").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))


def regions(scan: DataFrame, key: str, *names: str) -> DataFrame:
    """(key, name, begin, end, tag): what each opening tag of the names encloses; end is null for one that nothing closes."""
    level = F.col("depth") + F.when(F.col("opens"), 0).otherwise(1)
    same = Window.partitionBy(key, "name", "level").orderBy("n")
    rows = scan.where(F.col("name").isin(*names)).withColumn("level", level)
    rows = rows.withColumn("end", F.lead(F.when(~F.col("opens"), F.col("n"))).over(same))
    return rows.where("opens").select(key, "name", F.col("n").alias("begin"), "end", "tag")


def _covered(scan: DataFrame, regions_: DataFrame, key: str) -> DataFrame:
    """regions_ with `n`, a row for each tag from begin up to end, or to the last of the page: as many rows as they enclose, whatever else the page holds."""
    lasts = scan.groupBy(key).agg(F.max("n").alias("_last"))
    to = F.coalesce(F.col("end") - 1, F.col("_last"))
    return regions_.join(lasts, key).where(F.col("begin") <= to).withColumn("n", F.explode(F.sequence(F.col("begin"), to))).drop("_last")


def contents(scan: DataFrame, regions_: DataFrame, key: str, by: str = " ") -> DataFrame:
    """regions_ with `text`: what they enclose, without tags, references decoded, white space as one space."""
    inner = scan.select(key, "n", F.concat(F.when(F.col("opens") & F.col("name").isin("script", "style"), F.lit("")).otherwise(F.lit(by)), "text").alias("piece"))
    joined = _covered(scan, regions_, key).join(inner, [key, "n"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "")
    return joined.groupBy(*regions_.columns).agg(strip_tags(text, "").alias("text"))


def holders(rows: DataFrame, regions_: DataFrame, key: str) -> DataFrame:
    """rows (key, n), each with the begin of the innermost of regions_ that holds it; rows in none go."""
    own = _covered(rows, regions_, key).where(F.col("n") > F.col("begin")).select(key, F.col("begin").alias("holder"), "n")
    inside = rows.join(own, [key, "n"])
    return inside.groupBy(*rows.columns).agg(F.max("holder").alias("holder"))


def _carried(scan: DataFrame, key: str, value: Column) -> Column:
    return F.last(value, True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def panel_links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, n, kind, title, url, year, debtor_name, path_id): maps, federal debts and state debts of a page, the first of each address.

    Maps are anchors that name a year. Debts are options of a select: its year is in the first panel heading behind
    the select or heading before, its section and kind in the h3 and h4 above.
    """
    scan = tags(df, key, html)
    heads = contents(scan, regions(scan, key, "h3", "h4", "div").where("name <> 'div' or tag rlike '(?i)class=[\"'']panel-heading[\"'']'"), key).select(key, F.col("begin").alias("n"), "name", "text")
    known = scan.join(heads.select(key, "n", F.col("text").alias("head")), [key, "n"], "left")
    h3 = F.when((F.col("name") == "h3") & F.col("head").isin(FEDERAL, STATE), F.col("head")).when((F.col("name") == "div") & (attribute("tag", "id") == FOOTER), F.lit(""))
    known = known.withColumn("section", _carried(known, key, h3))
    h4 = F.when((F.col("name") == "h4") & F.col("opens"), F.struct("n", F.col("head").alias("text"))).when(h3.isNotNull(), F.struct(F.lit(-1).alias("n"), F.lit("").alias("text")))
    known = known.withColumn("h4", _carried(known, key, h4))
    ends = ((F.col("name") == "select") & ~F.col("opens")) | h3.isNotNull() | ((F.col("name") == "h4") & F.col("opens") & (F.col("section") == STATE))
    known = known.withColumn("gap", F.sum(ends.cast("int")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    year = F.when(F.col("name") == "div", F.when(F.col("head").rlike(r"^\d{4}$"), F.col("head").try_cast("int")))
    known = known.withColumn("year", F.first(year, True).over(Window.partitionBy(key, "gap").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    kind, endpoint, prefix = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, section, heading, path, title in reversed(PANELS):
        test = (F.col("section") == section) & (F.col("h4.text").rlike(heading) if heading else F.lit(True))
        kind, endpoint, prefix = (F.when(test, F.lit(new)).otherwise(old) for new, old in ((name, kind), (path, endpoint), (title, prefix)))
    selects = known.where("name = 'select' and opens").select(key, F.col("n").alias("holder"), "year", "section", "h4", kind.alias("kind"), endpoint.alias("endpoint"), prefix.alias("prefix")).where("kind is not null and year is not null")
    # Of two headings of one kind in a section the first counts.
    first = F.min(F.when(F.col("kind") != PANELS[0][0], F.col("h4.n"))).over(Window.partitionBy(key, "section", "kind"))
    selects = selects.withColumn("first", first).where("first is null or first = h4.n")
    options = contents(scan, regions(scan, key, "option"), key).select(key, F.col("begin").alias("n"), attribute("tag", "value").alias("href"), F.col("text").alias("debtor_name"))
    options = holders(options, regions(scan, key, "select"), key).join(selects, [key, "holder"])
    path = F.regexp_extract("href", r"/([A-Za-z]+)/(\d+)$", 1)
    options = options.where((path == F.col("endpoint")) & (F.col("debtor_name") != "") & ~F.col("debtor_name").rlike("(?i)selecione"))
    debts = options.select(key, "n", "kind", F.concat_ws(" ", "prefix", F.col("year").cast("string"), F.lit("-"), "debtor_name").alias("title"), "href", "year", "debtor_name")
    anchors = contents(scan, regions(scan, key, "a"), key).select(key, F.col("begin").alias("n"), attribute("tag", "href").alias("href"), strip_tags(attribute("tag", "title")).alias("title"), "text")
    folded, map_kind = F.upper(fold("title")), F.lit(None).cast("string")
    for name, words in reversed(MAPS):
        test = F.lit(True)
        for word in words:
            test = test & F.contains(folded, F.lit(word))
        map_kind = F.when(test, F.lit(name)).otherwise(map_kind)
    maps = anchors.where(F.col("href").rlike(r"/downloadMapas/\d+$") & F.col("text").rlike(r"^\d{4}$")).select(key, "n", map_kind.alias("kind"), "title", "href", F.col("text").cast("int").alias("year"), F.lit(None).cast("string").alias("debtor_name")).where("kind is not null")
    links = maps.unionByName(debts).withColumns({"url": absolute("href", base), "path_id": F.regexp_extract("href", r"/(\d+)$", 1)})
    order = F.array_position(F.array(*(F.lit(x) for x, *_ in MAPS)), F.col("kind")) > 0
    rank = F.when(order, 0)
    for place, (name, *_) in enumerate(PANELS):
        rank = rank.when(F.col("kind") == name, place + 1)
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy(rank, "n"))
    return links.withColumn("_first", first).where("_first = 1").select(key, "n", "kind", "title", "url", "year", "debtor_name", "path_id")


def _day(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(F.trim(text), "dd/MM/yyyy"))


def communication_links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, n, title, summary, url, published_at, code, page): the entries of a list page, the first of each address; entries without link or title go.

    An entry reaches from its block to the next, to the side column or to the end of the section.
    """
    scan = tags(df, key, html)
    css = attribute("tag", "class")
    is_div = (F.col("name") == "div") & F.col("opens")
    opens = is_div & (css == "lista-comunicados")
    ends = (is_div & css.startswith("col-md-3")) | ((F.col("name") == "section") & ~F.col("opens"))
    block = F.when(opens, F.col("n")).when(ends, F.lit(-1))
    at = scan.withColumn("block", _carried(scan, key, block)).where("block >= 0").select(key, "n", "block")
    texts = contents(scan, regions(scan, key, "h3", "p", "time", "a"), key, "").withColumnRenamed("begin", "n").join(at, [key, "n"]).withColumn("text", collapse(numeric_references("text")))
    inner = holders(texts.where("name = 'a'").select(key, "n", "block", "tag", "text"), regions(scan, key, "h3"), key)
    href = attribute("tag", "href")
    first = lambda value, test: F.min_by(value, F.when(test & value.isNotNull(), F.col("n")))
    entries = texts.groupBy(key, "block").agg(
        first(href, (F.col("name") == "a") & F.contains(F.lower(href), F.lit("/precatorios/comunicados/comunicado"))).alias("href"), first(F.col("text"), F.col("name") == "p").alias("summary"), first(_day(F.col("text")), F.col("name") == "time").alias("published_at")
    ).join(inner.groupBy(key, "block").agg(F.min_by("text", "n").alias("title")), [key, "block"])
    url = absolute("href", base)
    entries = entries.where("href is not null and title <> ''").select(key, F.col("block").alias("n"), "title", F.nullif("summary", F.lit("")).alias("summary"), url.alias("url"), "published_at")
    argument = lambda name: F.nullif(F.regexp_extract("url", rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    entries = entries.withColumns({"code": argument("codigoComunicado"), "page": argument("pagina").try_cast("int")})
    return entries.withColumn("_first", F.row_number().over(Window.partitionBy(key, "url").orderBy("n"))).where("_first = 1").drop("_first")


def communications(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, title, summary, published_at, text, documents): a detail page; documents is an array of title, url, format and code, in order.

    title: the first h3 in the block of the communication, else one that is bold as a whole. text: the block up to two
    blocks that close at once, else the page; its first 10,000 characters. Pages without tags have nulls and no documents.
    """
    h = F.col(html)
    plain = lambda c: collapse(numeric_references(strip_tags(c, "")))
    part = lambda pattern: F.when(h.rlike(pattern), plain(F.regexp_extract(h, pattern, 1)))
    filled = lambda c: F.nullif(c, F.lit(""))
    block, bold = r"(?is)<div\s+class=[\"']comunicado[\"'][^>]*>.*?<h3[^>]*>(.*?)</h3>", r"(?is)<h3[^>]*>\s*<strong[^>]*>(.*?)</strong>\s*</h3>"
    body = r"(?is)<div\s+class=[\"']comunicado[\"'][^>]*>(.*?)</div>\s*</div>"
    text = F.coalesce(part(body), plain(h))
    pages = df.select(key, filled(F.coalesce(part(block), part(bold))).alias("title"), filled(part(r"(?is)<p[^>]*>(.*?)</p>")).alias("summary"), _day(part(r"(?is)<time[^>]*>(.*?)</time>")).alias("published_at"), filled(F.substring(text, 1, COMMUNICATION_TEXT)).alias("text"))
    scan = tags(df, key, html)
    links = contents(scan, regions(scan, key, "a"), key, "").select(key, F.col("begin").alias("n"), F.trim(decode_entities(attribute("tag", "href"))).alias("href"), collapse(numeric_references("text")).alias("text"))
    links = links.where(F.col("href").rlike(r"(?i)FileFetch\.ashx|/Download/|\.(?:csv|xls|xlsx|ods|pdf|html?)(?:$|\?)")).withColumn("url", absolute("href", base))
    path = F.lower(F.regexp_extract("url", r"^[^?#]*", 0))
    kind = F.when(path.contains("filefetch.ashx"), F.lit("file_fetch")).otherwise(F.nullif(F.regexp_extract(path, r"\.([a-z0-9]+)$", 1), F.lit("")))
    title = F.coalesce(F.nullif("text", F.lit("")), F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1))
    code = F.nullif(F.regexp_extract("url", r"[?&]codigo=([^&#]*)", 1), F.lit(""))
    links = links.withColumn("_first", F.row_number().over(Window.partitionBy(key, "url").orderBy("n"))).where("_first = 1")
    links = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", title.alias("title"), "url", kind.alias("format"), code.alias("code")))).alias("documents"))
    none = F.array().cast("array<struct<title:string,url:string,format:string,code:string>>")
    return pages.join(links, key, "left").withColumn("documents", F.coalesce(F.transform("documents", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["format"].alias("format"), x["code"].alias("code"))), none))
