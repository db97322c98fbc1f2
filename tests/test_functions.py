"""Golden values of the functions, on literal rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from quarry.functions import dates, maths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_process_number(spark):
    assert one(spark, text.process_number(F.lit("00012349420244013400"))) == "0001234-94.2024.4.01.3400"
    assert one(spark, text.process_number(F.lit("0001234-00.2024.4.01.3400"))) is None
    assert one(spark, text.process_number(F.lit("123"))) is None
    assert one(spark, text.process_number(F.lit(None).cast("string"))) is None
    assert one(spark, text.court_of_process(F.lit("0001234-94.2024.4.01.3400"))) == "trf1"
    assert one(spark, text.padded_process_number(F.lit("1234-94.2024.4.01.3400"))) == "0001234-94.2024.4.01.3400"
    assert one(spark, text.find_process_number(F.lit("x 0001234-00.2024.4.01.3400 y 0001234-94.2024.4.01.3400"))) == "0001234-94.2024.4.01.3400"


def test_money(spark):
    for given, wanted in (("R$ 1.234.567,89", "1234567.89"), ("-2.500,15", "-2500.15"), ("401540,95", "401540.95"), ("454035,83505", "454035.83"), ("1,234.56", None), ("", None), ("x", None)):
        assert one(spark, text.brazilian_money(F.lit(given))) == (Decimal(wanted) if wanted else None), given
    assert one(spark, text.brazilian_decimal(F.lit("1.234,5678"))) == Decimal("1234.5678")
    assert one(spark, text.find_money(F.lit("valor de R$ 123.456,78 em 2024"))) == Decimal("123456.78")
    assert one(spark, text.percent_cell(F.lit("12,5%"))) == Decimal("0.1250")
    assert one(spark, text.money_cell(F.lit("-"))) is None
    assert one(spark, text.money_string(F.lit(Decimal("12.349")))) == "12.34"
    assert one(spark, text.format_brl(F.lit(1234567.5))) == "R$ 1.234.567,50"


def test_names(spark):
    assert one(spark, text.debtor_name(F.lit(" União Federal / Ministério da Saúde "))) == "UNIAO FEDERAL MINISTERIO DA SAUDE"
    assert one(spark, text.debtor_name(F.lit(" - "))) is None
    assert one(spark, text.header_key(F.lit(" Ano da Proposta (R$) "))) == "ano_da_proposta_r"
    assert one(spark, text.code_key(F.lit("São Paulo"))) == "SAO_PAULO"
    assert one(spark, text.slug(F.lit("Lista de Precatórios 2024.pdf"))) == "lista-de-precatorios-2024-pdf"
    assert one(spark, text.debtor_type(F.lit("Município de Niterói"))) == "municipality"
    assert one(spark, text.nature(F.lit("Crédito alimentício"))) == "alimentar"
    assert one(spark, text.find_year(F.lit("exercício 2023, pago em 2024"))) == 2023
    assert one(spark, text.yes_no(F.lit("Não"))) is False
    assert one(spark, text.strip_tags(F.lit("<b>a&amp;b</b><script>x</script>  c"))) == "a&b c"
    assert one(spark, text.csv_cell(F.lit('a"b'))) == '"a""b"'
    assert one(spark, text.shares_long_word(F.lit("Benefício previdenciário"), F.lit("revisao de beneficio"))) is True


def test_keyed_hash(spark):
    import hashlib
    import hmac

    for pepper in ("p", "x" * 100):
        assert one(spark, text.keyed_hash(F.lit("João"), pepper)) == hmac.new(pepper.encode(), "João".encode(), hashlib.sha256).hexdigest()


def test_dates(spark):
    assert one(spark, dates.day_or_null(F.lit("2014-07-28T00:00"))) == dt.date(2014, 7, 28)
    assert one(spark, dates.day_or_null(F.lit("07/08/2024"))) == dt.date(2024, 8, 7)
    assert one(spark, dates.day_or_null(F.lit("31/02/2024"))) is None
    assert one(spark, dates.moment_or_null(F.lit("20240131123045"))) == dt.datetime(2024, 1, 31, 12, 30, 45)
    assert one(spark, dates.short_month(F.lit("mar/24"))) == dt.date(2024, 3, 1)
    assert one(spark, dates.month_end(F.lit("02/2024"))) == dt.date(2024, 2, 29)
    for year, day in ((2024, (3, 31)), (2025, (4, 20)), (2026, (4, 5)), (2038, (4, 25))):
        assert one(spark, dates.easter(F.lit(year))) == dt.date(year, *day)


def test_deadlines(spark):
    rows = spark.createDataFrame([("2026-04-30", 1, "business_days"), ("2026-07-08", 2, "business_days"), ("2026-12-15", 10, "business_days"), ("2026-07-10", 2, "calendar_days"), (None, 5, "business_days")], "p string, n int, k string").withColumn("p", F.to_date("p"))
    days = dates.calendar(spark, "2026-01-01", "2027-12-31")
    got = {(r.p, r.n): r.due_on for r in dates.deadlines(rows, "p", "n", "k", days).collect()}
    assert got[dt.date(2026, 4, 30), 1] == dt.date(2026, 5, 4)
    assert got[dt.date(2026, 7, 8), 2] == dt.date(2026, 7, 10)
    # three open days are left before the recess, seven follow it
    assert got[dt.date(2026, 12, 15), 10] == dt.date(2027, 1, 29)
    assert got[dt.date(2026, 7, 10), 2] == dt.date(2026, 7, 13)
    assert got[None, 5] is None
    own = dates.calendar(spark, "2026-01-01", "2027-12-31", spark.createDataFrame([("2026-07-09",)], "day string"))
    assert dates.deadlines(rows.where("n = 2 and k = 'business_days'"), "p", "n", "k", own).first().due_on == dt.date(2026, 7, 13)
    between = spark.createDataFrame([("2026-07-08", "2026-07-13")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert dates.working_days_between(between, "a", "b", days, "n").first().n == 3


def test_maths(spark):
    assert one(spark, maths.half_up(F.lit(-2.5))) == -2
    assert one(spark, maths.rate(F.lit(12.0))) == 0.12
    assert one(spark, maths.ratio(F.lit(1), F.lit(0))) == 0
    assert one(spark, maths.known_ratio(F.lit(0.0), F.lit(2.0))) is None
    assert abs(one(spark, maths.correction_rate(F.lit(0.05), F.lit(0.1))) - 0.07) < 1e-12
    assert one(spark, maths.correction_rate(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.12
    frame = spark.createDataFrame([(2.0,), (0.0,), (3.0,)], "x double")
    assert frame.agg(maths.product("x")).first()[0] == 0
    assert frame.where("x > 5").agg(maths.product("x")).first()[0] == 1
