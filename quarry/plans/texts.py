"""Queries of the functions: values of the canonical tables are written as texts, and read back by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify, dates, json, maths, text
from quarry.plans import bindings as b
from quarry.plans.queries import query


def _turn(values, key: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_turn(values, key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def _brl(c) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


@query("""SELECT asset_id, total AS money, (-total)::DECIMAL(18,2) AS negative, total AS plain, NULL::DECIMAL(18,2) AS foreign_form, (total * 1000 + 0.123)::DECIMAL(38,16) AS decimals, NULL::DECIMAL(18,2) AS dash,
  (asset_id % 97 / 100.0)::DECIMAL(10,4) AS share, total AS found, total::VARCHAR AS as_text FROM assets""")
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("total")
    return b.assets(spark, d).select(
        "asset_id", text.brazilian_money(F.concat(F.lit(" R$ "), _brl(t))).alias("money"), text.brazilian_money(F.concat(F.lit("-"), _brl(t), F.lit("9"))).alias("negative"), text.brazilian_money(F.translate(t.cast("string"), ".", ",")).alias("plain"),
        text.brazilian_money(F.format_number(F.lit(1234) + t % 1, 2)).alias("foreign_form"), text.brazilian_decimal(F.concat(F.regexp_replace(_brl((t * 1000).cast("decimal(18,2)")), ",00$", ""), F.lit(",123"))).alias("decimals"), text.money_cell(F.lit(" - ")).alias("dash"),
        text.percent_cell(F.concat((F.col("asset_id") % 97).cast("string"), F.lit(",00 %"))).alias("share"), text.find_money(F.concat(F.lit("Total de 12 parcelas: R$ "), _brl(t), F.lit(", fl. 3"))).alias("found"), text.money_string(t).alias("as_text"),
    )


@query("""SELECT debtor_id, 'R$ ' || translate(format('{:,.2f}', reliability * 12345.5), ',.', '.,') AS brl, translate(format('{:,.2f}', reliability * 1.25), ',.', '.,') || '%' AS percent, '"' || name || ' ""x""; y"' AS cell, '' AS empty_cell FROM debtors""")
def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("reliability")
    return b.debtors(spark, d).select("debtor_id", text.format_brl(r * 12345.5).alias("brl"), text.format_percent(r * 0.0125).alias("percent"), text.csv_cell(F.concat("name", F.lit(' "x"; y'))).alias("cell"), text.csv_cell(F.lit(None)).alias("empty_cell"))


# Fixed values of these queries: names and texts in turn.
NAMES = ("União Federal", "Fazenda Nacional", "INSS - Instituto Nacional", "Fundação Universidade", "Autarquia de Águas", "Município de São Paulo", "Prefeitura de Betim", "Câmara Municipal", "Estado da Bahia", "IPREV Santos", "Departamento de Estradas", "Companhia Docas", "EMBASA", "Hospital", "Instituto de Terras", "")
NATURE_TEXTS = ("Alimentar", "crédito alimentício", "Não alimentares", "NAO ALIMENTAR", "Tributário", "Comum", "inciso V", "outros", "")
WISHES = ("Idade avançada", "idoso", "Doença grave", "Preferencial", "superpreferência", "Inciso II", "inciso III do art. 100", "Inciso IV", "INCISO V", "nenhuma", None)


def _case(value: str, rules, at: int) -> str:
    """First rule of which the text contains a word."""
    literal = lambda v: "NULL" if v is None else f"'{v}'"
    whens = " ".join("WHEN " + " OR ".join(f"contains({value}, '{w}')" for w in rule[0]) + f" THEN {literal(rule[at])}" for rule in rules[:-1])
    return f"CASE {whens} ELSE {literal(rules[-1][at])} END"


_CODE = "trim(regexp_replace(upper(strip_accents(n)), '[^A-Z0-9]+', '_', 'g'), '_')"


@query(f", t AS (SELECT debtor_id, payment_regime, {_sql_turn(NAMES, 'debtor_id')} AS n FROM debtors), k AS (SELECT *, {_CODE} AS k FROM t), " + "r AS (" + " UNION ALL ".join(
    f"SELECT debtor_id, '{source}' AS source, {_case('k', rules, 1)} AS debtor_type, coalesce({_case('k', rules, 2)}, payment_regime) AS payment_regime FROM k" for source, rules in classify.DEBTORS.items()
) + """) SELECT * FROM r UNION ALL SELECT debtor_id, 'map', CASE WHEN debtor_id % 3 = 0 AND debtor_id % 2 = 0 THEN 'union' WHEN debtor_id % 3 = 0 THEN 'autarchy' WHEN debtor_id % 3 = 1 AND debtor_id % 2 = 0 THEN 'state' WHEN debtor_id % 2 = 0 THEN 'municipality' WHEN contains(upper(n), 'FUNDA') THEN 'foundation' ELSE 'autarchy' END,
  CASE WHEN debtor_id % 3 = 0 THEN 'federal_unique' WHEN payment_regime = 'special' THEN 'special' ELSE 'other' END FROM k""")
def debtor_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The rule sets of eight sources over the same names."""
    rows = b.debtors(spark, d).select("debtor_id", "payment_regime", _turn(NAMES, "debtor_id").alias("n"))
    by_name = [F.struct(F.lit(source).alias("source"), classify.debtor_profile(source, "n", F.col("payment_regime")).alias("p")) for source in classify.DEBTORS]
    sphere, entity = _turn(("F", "E", "M"), "debtor_id"), _turn(("D", "I"), "debtor_id")
    by_name.append(F.struct(F.lit("map").alias("source"), classify.map_profile(sphere, entity, F.col("payment_regime") == "special", "n").alias("p")))
    return rows.select("debtor_id", F.explode(F.array(*by_name)).alias("x")).select("debtor_id", "x.source", "x.p.debtor_type", "x.p.payment_regime")


@query(f", t AS (SELECT asset_id, upper(strip_accents({_sql_turn(NATURE_TEXTS, 'asset_id')})) AS k FROM assets)" + " UNION ALL ".join(f" SELECT asset_id, '{source}' AS source, {_case('k', rules, 1)} AS nature FROM t" for source, rules in classify.NATURES.items()))
def natures_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", _turn(NATURE_TEXTS, "asset_id").alias("t"))
    return rows.select("asset_id", F.explode(F.array(*(F.struct(F.lit(source).alias("source"), classify.nature_by(source, "t").alias("nature")) for source in classify.NATURES))).alias("x")).select("asset_id", "x.*")


@query(f""", t AS (SELECT asset_id, {_sql_turn(WISHES, 'asset_id')} AS n FROM assets), k AS (SELECT asset_id, coalesce({_CODE}, '') AS k, upper(strip_accents(n)) AS u FROM t)
SELECT asset_id, contains(k, 'IDADE') OR contains(k, 'IDOS') OR contains(k, 'DOENCA_GRAVE') OR contains(k, 'PREFERENCIAL') OR contains(k, 'SUPERPREFER') AS super,
  CASE WHEN contains(u, 'INCISO II') THEN 'superpreferential' WHEN contains(u, 'INCISO III') THEN 'alimentar_preferential' WHEN contains(u, 'INCISO IV') THEN 'alimentar_balance' WHEN contains(u, 'INCISO V') THEN 'common' END AS preference FROM k""")
def preferences(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", _turn(WISHES, "asset_id").alias("t"))
    return rows.select("asset_id", classify.is_superpreference("t").alias("super"), classify.item_preference("t").alias("preference"))


@query("""SELECT asset_id, cnj_number AS spaced, NULL AS wrong, cnj_number AS found, cnj_number AS padded, cnj_number AS short, cnj_number AS joined, CASE WHEN right(cnj_number, 4) = '0000' THEN cnj_number END AS no_origin, replace(replace(cnj_number, '-', ''), '.', '') AS digits FROM assets""")
def process_number_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("cnj_number")
    digits = F.regexp_replace(n, "[^0-9]", "")
    wrong = F.concat(F.substring(digits, 1, 7), F.lpad(F.pmod(F.substring(digits, 8, 2).cast("int") + 1, F.lit(100)).cast("string"), 2, "0"), F.substring(digits, 10, 11))
    joined = F.concat(F.regexp_replace(n, r"^(.{15}\.\d)\.(\d\d\.\d{4})$", "$1$2"), F.lit("-7"))
    return b.assets(spark, d).select(
        "asset_id", text.process_number(F.concat(F.lit(" "), n)).alias("spaced"), text.process_number(wrong).alias("wrong"), text.find_process_number(F.concat(F.lit("autos 0000000-99.2020.4.01.0000 e "), n, F.lit("."))).alias("found"),
        text.padded_process_number(F.regexp_replace(digits, "^0+", "")).alias("padded"), text.short_process_number(F.regexp_replace(n, r"^0(\d{6}-)", "$1")).alias("short"), text.joined_process_number(joined).alias("joined"),
        text.process_number_without_origin(F.regexp_replace(n, r"\.\d{4}$", "")).alias("no_origin"), text.digits_or_null(n).alias("digits"),
    )


_SEGMENTS = (("3", "00", "stj"), ("4", "03", "trf3"), ("4", "07", None), ("5", "15", "trt15"), ("5", "25", None), ("6", "26", "tre-sp"), ("7", "01", "stm"), ("8", "07", "tjdft"), ("8", "19", "tjrj"), ("8", "28", None), ("9", "13", "tjmmg"), ("9", "19", None), ("1", "00", None))


@query(f"SELECT part.p_partkey AS id, {_sql_turn([alias for *_, alias in _SEGMENTS], 'p_partkey')} AS court FROM part")
def courts_of_segments(spark: SparkSession, d: str) -> DataFrame:
    """Valid numbers of all segments, and their courts."""
    part = [F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("2020"), _turn([s for s, *_ in _SEGMENTS], "p_partkey"), _turn([c for _, c, _ in _SEGMENTS], "p_partkey"), F.lit("0001")]
    number = F.concat(part[0], text.check_digits(*part), *part[1:])
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.court_of_process(number).alias("court"))


@query("""SELECT debtor_id, 'numero_do_processo_' || debtor_id AS header, 'acao ordinaria ' || debtor_id AS search, 'CUSTOMER ' || debtor_id AS words, CASE WHEN debtor_id % 2 = 0 THEN debtor_id::VARCHAR ELSE 'AB ' || debtor_id END AS identifier, 'first ' || debtor_id AS filled,
  'text & more ' || debtor_id AS stripped, debtor_id AS whole, CASE debtor_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, debtor_id % 2 = 0 AS overlap, '.pdf' AS extension, CASE WHEN debtor_id % 6 < 5 THEN 'trf' || (debtor_id % 6 + 1) END AS court, (2000 + debtor_id % 30)::INT AS year FROM debtors""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("debtor_id").cast("string")
    say = lambda head, tail="": F.concat(F.lit(head), key, F.lit(tail))
    even = F.col("debtor_id") % 2 == 0
    number = (F.col("debtor_id") % 6 + 1).cast("string")
    court = F.when(F.col("debtor_id") % 6 == 5, F.lit("Tribunal de Justiça")).when(even, F.concat(F.lit("TRF "), number)).otherwise(F.concat(F.lit("Tribunal Regional Federal da "), number, F.lit("ª Região")))
    return b.debtors(spark, d).select(
        "debtor_id", text.header_key(say(" Número do Processo: ", " ")).alias("header"), text.search_text(say("AÇÃO Ordinária ")).alias("search"), text.debtor_name(say("  customer — ", " !")).alias("words"),
        text.identifier(F.when(even, F.lit("process_number")).otherwise(F.lit("other")), F.when(even, say("n. ", "-")).otherwise(say(" áb   "))).alias("identifier"), text.first_filled(F.lit(" "), F.lit(None).cast("string"), say(" first "), F.lit("second")).alias("filled"),
        text.strip_tags(say("<script>x()</script><p>text&nbsp;&amp;\n<b>more</b> ", "</p>")).alias("stripped"), text.whole_number(say(" ", " ")).alias("whole"), text.yes_no(_turn(("Sim", "NÃO", "Recursos FUNDEF", "talvez"), "debtor_id")).alias("flag"),
        text.shares_long_word(F.lit("Revisão da aposentadoria"), F.when(even, F.lit("Aposentadorias especiais")).otherwise(F.lit("Outros da lei"))).alias("overlap"), text.safe_extension(say("Documento ", ".PDF")).alias("extension"),
        text.court_from_name(court).alias("court"), text.find_year(F.concat(F.lit("Lei 2099/10; orçamento de "), (F.lit(2000) + F.col("debtor_id") % 30).cast("string"))).alias("year"),
    )


def _xor(byte: int) -> str:
    return bytes(x ^ byte for x in b"pepper".ljust(64, b"\0")).hex()


@query(f"""SELECT debtor_id, sha256(unhex('{_xor(0x5C)}') || unhex(sha256(unhex('{_xor(0x36)}') || encode(name)))) AS keyed, sha256('{{"a":' || debtor_id || ',"b":{{"c":"' || name || '","d":[1,' || debtor_id || ']}},"e":null}}') AS stable FROM debtors""")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """A keyed hash by its definition; a fingerprint whose keys are in order at every depth and whose nulls stay."""
    row = F.concat(F.lit('{"e":null,"b":{"d":[1,'), F.col("debtor_id").cast("string"), F.lit('],"c":"'), "name", F.lit('"},"a":'), F.col("debtor_id").cast("string"), F.lit("}"))
    return b.debtors(spark, d).select("debtor_id", text.keyed_hash("name", "pepper").alias("keyed"), F.sha2(json.canonical(row, "e string, b struct<d:array<int>,c:string>, a long"), 256).alias("stable"))


@query("""SELECT asset_id, created_at::DATE AS iso, created_at::DATE AS slashed, created_at AS digits14, timezone('UTC', timezone('America/Sao_Paulo', created_at::TIMESTAMP)) AS local_time, date_trunc('month', created_at)::DATE AS short_month, last_day(created_at::DATE) AS month_end, year(created_at)::INT AS year_in_text,
  (DATE '1999-01-01' - created_at::DATE)::INT AS age, (DATE '1999-01-01' - created_at::DATE) > 1000 AS stale, (asset_id * 1000)::BIGINT AS ms FROM assets""")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("created_at")
    month = F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(at) - 1)
    return b.assets(spark, d).select(
        "asset_id", dates.day_or_null(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), dates.day_or_null(F.date_format(at, "dd/MM/yyyy HH:mm")).alias("slashed"), dates.moment_or_null(F.date_format(at, "yyyyMMddHHmmss")).alias("digits14"),
        dates.local_moment(F.date_format(at, "dd/MM/yyyy HH:mm:ss")).alias("local_time"), dates.short_month(F.concat(month, F.lit("/"), F.year(at).cast("string"))).alias("short_month"), dates.month_end(F.date_format(at, "MM/yyyy")).alias("month_end"),
        dates.year_of(F.concat(F.lit("de "), F.year(at).cast("string"))).alias("year_in_text"), dates.age_days("created_at", F.lit("1999-01-01").cast("timestamp")).alias("age"), dates.is_stale("created_at", F.lit("1999-01-01").cast("timestamp"), 1000).alias("stale"),
        dates.milliseconds("created_at", at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("asset_id"))).alias("ms"),
    )


@query("""
, days AS (SELECT range::DATE AS day FROM range(DATE '2024-01-01', DATE '2024-03-05', INTERVAL 1 DAY)), cal AS (SELECT day, isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-02-12', DATE '2024-02-13') AS working FROM days),
e AS (SELECT event_id, event_at::DATE AS day, (event_at::DATE + (event_id % 20)::INT - 4)::DATE AS other FROM asset_events)
SELECT event_id, (SELECT min(c.day) FROM cal c WHERE c.working AND c.day > e.day) AS published_on, (SELECT count(*) FROM cal c WHERE c.working AND c.day > e.day AND c.day <= e.other) AS working_days FROM e""")
def working_days(spark: SparkSession, d: str) -> DataFrame:
    """The first working day after a day, and the working days up to another."""
    days = dates.calendar(spark, "2023-12-01", "2024-03-31")
    rows = b.events(spark, d).select("event_id", F.to_date("event_at").alias("day")).withColumn("other", F.date_add("day", (F.col("event_id") % 20).cast("int") - 4))
    rows = dates.working_days_between(dates.add_working_days(rows, "day", 1, days, "published_on"), "day", "other", days, "working_days")
    return rows.select("event_id", "published_on", "working_days")


@query("""
, courts25 AS (SELECT court_id, (SELECT count(*) FROM courts) AS n FROM courts), start AS (SELECT n, ((dayofyear(DATE '2024-02-10') - 1) * 12) % n AS s FROM courts25 LIMIT 1)
SELECT 'batch' AS kind, court_id AS value FROM courts25, start WHERE (court_id - s + courts25.n) % courts25.n < 12 UNION ALL SELECT 'year', range FROM range(2008, 2026)""")
def turns(spark: SparkSession, d: str) -> DataFrame:
    """The courts whose turn it is on a day, and the years that a backfill takes."""
    batch = dates.daily_batch(b.courts(spark, d), "court_id", "2024-02-10").select(F.lit("batch").alias("kind"), F.col("court_id").cast("long").alias("value"))
    return batch.unionAll(dates.backfill_years(spark, "2024-05-05").select(F.lit("year"), F.col("year").cast("long")))


@query("""
, x AS (SELECT asset_id, total::DOUBLE AS t, (asset_id % 41 - 20) / 8.0::DOUBLE AS s, asset_id % 3 AS k, asset_id % 7 AS due FROM assets)
SELECT asset_id, least(greatest(s, -1), 1) AS clamped, least(greatest((s + 2) / 4, 0), 1) AS scaled, 1 - least(greatest((s + 2) / 4, 0), 1) AS inverse, floor(s * 10 + 0.5) / 10 AS half_up, CASE WHEN s > 1 THEN s / 100 ELSE s END AS rate,
  CASE WHEN due > 0 THEN round(k / due::DOUBLE, 4) ELSE 0 END AS ratio, CASE WHEN k <> 0 AND due <> 0 THEN k::DOUBLE / due END AS known_ratio,
  least(greatest(floor(CASE WHEN k = 0 THEN 45 ELSE 68 END + 25 * CASE WHEN due > 0 THEN least(k::DOUBLE / due, 1) ELSE 0 END + 0.5), 5), 95)::DOUBLE AS reliability, greatest(k, 1)::BIGINT AS errors,
  printf('%.2f', t * 1.005)::DOUBLE AS fixed FROM x""")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    x = b.assets(spark, d).select("asset_id", F.col("total").cast("double").alias("t"), ((F.col("asset_id") % 41 - 20) / 8).alias("s"), (F.col("asset_id") % 3).alias("k"), (F.col("asset_id") % 7).alias("due"))
    return x.select(
        "asset_id", maths.clamp("s", -1.0, 1.0).alias("clamped"), maths.scaled("s", -2.0, 2.0).alias("scaled"), maths.inverse_scaled("s", -2.0, 2.0).alias("inverse"), maths.half_up("s", 1).alias("half_up"), maths.rate("s").alias("rate"),
        maths.ratio("k", "due").alias("ratio"), maths.known_ratio("k", "due").cast("double").alias("known_ratio"), maths.reliability("k", "due", F.col("k") == 0).alias("reliability"), maths.at_least_one("k").alias("errors"), maths.to_fixed(F.col("t") * 1.005, 2).alias("fixed"),
    )


@query("""SELECT event_id, k::VARCHAR AS at_path, NULL AS through_list, k::VARCHAR AS own, 'trf1' AS flag, 'n' || k AS first_subject, 'B' || k AS merged, 'a' AS kept, 3::INT AS length, (k + 2)::VARCHAR AS last, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END::INT AS n_items FROM asset_events""")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Paths that stop at lists, the first name in nested lists, merges in which later maps win, lists of bounded length, and typed items."""
    k = F.col("k").cast("string")
    doc = F.concat(F.lit('{"a":{"b":{"k":'), k, F.lit('}},"l":[{"k":1}],"courtAlias":"trf1"}'))
    subjects = F.array(F.lit("7"), F.lit('[[{"codigo":1}],"x"]'), F.concat(F.lit('[{"nome":" n'), k, F.lit(' "}]')))
    good = '{"kind":"deadline","label":"x","dueAt":"2024-01-02","fatal":true}'
    items = F.concat(F.lit("[" + good + ',{"kind":1,"label":"x","dueAt":"2024-01-02","fatal":true},7,{"kind":"hearing"}'), F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.lit("," + good)), F.lit("]"))
    merged = json.merged(F.create_map(F.lit("x"), F.lit("A"), F.lit("y"), F.lit("a")), F.create_map(F.lit("x"), F.concat(F.lit("B"), k)), F.lit(None).cast("map<string,string>"))
    some = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.col("k") + i).cast("string"))
    grown = json.appended(json.appended(some, F.lit("z"), 3), (F.col("k") + 2).cast("string"), 3)
    return b.events(spark, d).select(
        "event_id", json.at(doc, ["a", "b", "k"]).alias("at_path"), json.at(doc, ["l", "k"]).alias("through_list"), json.at("props", ["k"]).alias("own"), F.get_json_object(doc, "$.courtAlias").alias("flag"), json.first_name(subjects).alias("first_subject"),
        merged["x"].alias("merged"), merged["y"].alias("kept"), F.size(grown).alias("length"), F.element_at(grown, -1).alias("last"), F.size(json.items(items)).alias("n_items"),
    )
