"""Dates: lenient parsing, Easter, holidays, and working-day arithmetic on a calendar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import col


def day_or_null(x: Column | str) -> Column:
    """ISO date in the first ten characters, else dd/MM/yyyy, else null."""
    head = F.substring(F.trim(col(x)), 1, 10)
    return F.coalesce(F.try_to_date(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head), "yyyy-MM-dd"), F.try_to_date(F.when(head.rlike(r"^\d{2}/\d{2}/\d{4}$"), head), "dd/MM/yyyy"))


def moment_or_null(x: Column | str) -> Column:
    """14 or 8 digits, or ISO with or without a zone (UTC)."""
    t = F.trim(col(x))
    return F.coalesce(
        F.try_to_timestamp(F.when(t.rlike(r"^\d{14}$"), t), F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t).try_cast("timestamp"),
    )


def local_moment(x: Column | str, zone: str = "America/Sao_Paulo") -> Column:
    """dd/MM/yyyy HH:mm:ss in a zone, as UTC."""
    t = F.trim(col(x))
    return F.to_utc_timestamp(F.try_to_timestamp(F.when(t.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"), t), F.lit("dd/MM/yyyy HH:mm:ss")), zone)


MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def short_month(x: Column | str) -> Column:
    """mar/24 as the first of that month."""
    t = F.lower(F.trim(col(x)))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, r"^([a-z]{3})", 1)).cast("int")
    year = F.regexp_extract(t, r"^[a-z]{3}[a-z]*\.?[/-](\d{2}|\d{4})$", 1).try_cast("int")
    return F.when(month > 0, F.make_date(F.when(year < 100, year + 2000).otherwise(year), month, F.lit(1)))


def month_end(x: Column | str) -> Column:
    """MM/yyyy as the last of that month."""
    return F.last_day(F.try_to_date(F.when(F.trim(col(x)).rlike(r"^(0[1-9]|1[0-2])/\d{4}$"), F.concat(F.lit("01/"), F.trim(col(x)))), "dd/MM/yyyy"))


def year_of(x: Column | str) -> Column:
    return F.regexp_extract(col(x).cast("string"), r"\b((?:19|20)\d{2})", 1).try_cast("int")


def age_days(at: Column | str, now: Column | str) -> Column:
    """Whole days of 24 hours since at."""
    return F.floor((F.unix_micros(F.col(now) if isinstance(now, str) else now) - F.unix_micros(col(at).cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")


def is_stale(at: Column | str, now: Column, days: int = 30) -> Column:
    return F.coalesce(age_days(at, now) > days, F.lit(True))


def milliseconds(start: Column | str, end: Column | str) -> Column:
    return F.unix_millis(col(end).cast("timestamp")) - F.unix_millis(col(start).cast("timestamp"))


def easter(year: Column | str) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    y = col(year).cast("int")
    div = lambda p, q: F.floor(p / q).cast("int")
    century, golden = div(y, F.lit(100)), y % 19
    leap, skip = div(century, F.lit(4)), century % 4
    moon = div(century - div(century + 8, F.lit(25)) + 1, F.lit(3))
    epact = (19 * golden + century - leap - moon + 15) % 30
    weekday = (32 + 2 * skip + 2 * div(y % 100, F.lit(4)) - epact - (y % 100) % 4) % 7
    shift = div(golden + 11 * epact + 22 * weekday, F.lit(451))
    day = epact + weekday - 7 * shift + 114
    return F.make_date(y, div(day, F.lit(31)), day % 31 + 1)


# National holidays as month and day, and as days from Easter.
FIXED_HOLIDAYS = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (11, 20), (12, 25))
EASTER_HOLIDAYS = (-48, -47, -2, 60)


def calendar(spark: SparkSession, first: str, last: str, extra: DataFrame | None = None) -> DataFrame:
    """day, is_holiday, is_working, ordinal (working days up to and including the day) for a range of days.

    extra: more holidays in a column day. One row a day, so a century is 36,525 rows: small enough for one
    window and for a broadcast.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    fixed = F.lit(False)
    for month, day in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month("day") == month) & (F.dayofmonth("day") == day))
    after = F.datediff("day", easter(F.year("day")))
    days = days.withColumn("is_holiday", fixed | after.isin(*EASTER_HOLIDAYS))
    if extra is not None:
        days = days.join(F.broadcast(extra.select(F.col("day").cast("date")).distinct().withColumn("_own", F.lit(True))), "day", "left").withColumn("is_holiday", F.col("is_holiday") | F.coalesce("_own", F.lit(False))).drop("_own")
    days = days.withColumn("is_working", ~F.col("is_holiday") & ~F.dayofweek("day").isin(1, 7))
    return days.withColumn("ordinal", F.sum(F.col("is_working").cast("int")).over(Window.orderBy("day")))


def holidays_of(holidays: DataFrame, courts: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(court, day): holidays (day, court) from first to last of each court, national ones (court null) for all. Both tables are catalogues."""
    span = holidays.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    national = courts.select(key).crossJoin(F.broadcast(span.where("court is null").select("day")))  # courts times days of a calendar
    return national.unionAll(courts.select(key).join(F.broadcast(span.where("court is not null").select(F.col("court").alias(key), "day")), key)).distinct()


def add_working_days(df: DataFrame, day: str, n: Column | str | int, days: DataFrame, out: str) -> DataFrame:
    """out: the n-th working day after day (day itself for n <= 0); both joins are with the calendar's rows."""
    steps = F.lit(n) if isinstance(n, int) else col(n)
    here = days.select(F.col("day").alias("_day"), F.col("ordinal").alias("_at"))
    there = days.where("is_working").select(F.col("day").alias("_to"), F.col("ordinal").alias("_ordinal"))
    joined = df.join(F.broadcast(here), F.col(day) == F.col("_day"), "left").withColumn("_goal", F.when(steps > 0, F.col("_at") + steps))
    joined = joined.join(F.broadcast(there), F.col("_goal") == F.col("_ordinal"), "left")
    return joined.withColumn(out, F.when(steps > 0, F.col("_to")).otherwise(F.col(day))).drop("_day", "_at", "_goal", "_to", "_ordinal")


def working_days_between(df: DataFrame, start: str, end: str, days: DataFrame, out: str) -> DataFrame:
    """out: working days after start up to and including end; 0 if end is not after start."""
    at = lambda x: days.select(F.col("day").alias(f"_d{x}"), F.col("ordinal").alias(f"_o{x}"))
    joined = df.join(F.broadcast(at("a")), F.col(start) == F.col("_da"), "left").join(F.broadcast(at("b")), F.col(end) == F.col("_db"), "left")
    return joined.withColumn(out, F.greatest(F.col("_ob") - F.col("_oa"), F.lit(0))).drop("_da", "_oa", "_db", "_ob")


def in_recess(day: Column) -> Column:
    """From 20 December to 20 January."""
    return ((F.month(day) == 12) & (F.dayofmonth(day) >= 20)) | ((F.month(day) == 1) & (F.dayofmonth(day) <= 20))


def deadlines(df: DataFrame, published: str, n: str, kind: str, days: DataFrame) -> DataFrame:
    """df with due_on: n business or calendar days after publication, suspended in the year-end recess.

    Days of the recess do not count unless the publication itself lies in it; a due day that is not a
    working day rolls forward to the next one, in the recess or not. Null published or n gives null.
    """
    marked = days.withColumn("_recess", in_recess(F.col("day")))
    order = Window.orderBy("day")
    table = marked.select(
        "day", "is_working", "ordinal", "_recess",
        F.sum((F.col("is_working") & ~F.col("_recess")).cast("int")).over(order).alias("open_ordinal"),
        F.sum((~F.col("_recess")).cast("int")).over(order).alias("open_days"),
        F.min(F.when(F.col("is_working"), F.col("day"))).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next_working"),
    )
    start = table.select(F.col("day").alias("_start"), F.col("ordinal").alias("_w"), F.col("open_ordinal").alias("_ow"), F.col("open_days").alias("_od"), F.col("_recess").alias("_inside"))
    out = df.join(F.broadcast(start), F.col(published) == F.col("_start"), "left")
    business, inside = F.col(kind) == "business_days", F.col("_inside")
    out = out.withColumn("_mode", F.when(business & inside, F.lit("w")).when(business, F.lit("o")).when(inside, F.lit("c")).otherwise(F.lit("d")))
    out = out.withColumn("_goal", F.when(F.col("_mode") == "w", F.col("_w") + F.col(n)).when(F.col("_mode") == "o", F.col("_ow") + F.col(n)).when(F.col("_mode") == "c", F.datediff(F.date_add(F.col(published), F.col(n).cast("int")), F.lit("1970-01-01"))).otherwise(F.col("_od") + F.col(n)))
    goals = (
        table.where("is_working").select(F.lit("w").alias("_m"), F.col("ordinal").cast("long").alias("_g"), F.col("day").alias("due_on"))
        .unionAll(table.where("is_working and not _recess").select(F.lit("o"), F.col("open_ordinal").cast("long"), "day"))
        .unionAll(table.select(F.lit("c"), F.datediff("day", F.lit("1970-01-01")).cast("long"), "next_working"))
        .unionAll(table.where("not _recess").select(F.lit("d"), F.col("open_days").cast("long"), "next_working"))
    )
    out = out.join(F.broadcast(goals), (F.col("_mode") == F.col("_m")) & (F.col("_goal").cast("long") == F.col("_g")), "left")
    return out.drop("_start", "_w", "_ow", "_od", "_inside", "_mode", "_goal", "_m", "_g")


def deadline_results(df: DataFrame, days: DataFrame, now: str) -> DataFrame:
    """df with due_on, overdue, reason, needs_review and items, an array of (kind, day, time, fatal), of each publication.

    df: published_on or available_on, deadline_days, deadline_kind, manual_due_on, court, calendar_verified,
    hearing_on, hearing_time, judgment_on. A publication is the first working day after its availability; a
    manual day wins over a computed one; without days or a publication there is none. A court whose calendar
    is not verified makes a computed or manual day partial, which is to be reviewed.
    """
    out = add_working_days(df, "available_on", 1, days, "_after").withColumn("published_on", F.coalesce("published_on", "_after")).drop("_after")
    out = deadlines(out, "published_on", "deadline_days", "deadline_kind", days).withColumnRenamed("due_on", "_computed")
    partial = F.col("court").isNotNull() & ~F.coalesce("calendar_verified", F.lit(False))
    out = out.withColumn("due_on", F.coalesce("manual_due_on", "_computed"))
    manual, due = F.col("manual_due_on").isNotNull(), F.col("due_on").isNotNull()
    reason = F.when(manual & partial, F.lit("manual_due_date_with_partial_calendar")).when(manual, F.lit("manual_due_date")).when(~due, F.lit("missing_deadline_data")).when(partial, F.lit("partial_court_calendar"))
    item = lambda kind, day, fatal, time=None: F.when(F.col(day).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(day).alias("day"), (F.col(time) if time else F.lit(None).cast("string")).alias("time"), F.lit(fatal).alias("fatal")))
    first = F.when(manual, item("manual_due_date", "due_on", True)).otherwise(item("deadline", "due_on", True))
    items = F.array_compact(F.array(first, item("hearing", "hearing_on", False, "hearing_time"), item("judgment", "judgment_on", False)))
    out = out.withColumns({"overdue": F.coalesce(F.col("due_on") < F.lit(now).cast("date"), F.lit(False)), "reason": reason, "needs_review": due & partial, "items": items})
    return out.drop("_computed")


def backfill_years(spark: SparkSession, now: str, first: int = 2008) -> DataFrame:
    """Every year from first to the one after now."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.year(F.lit(now).cast("date")) + 1)).alias("year"))


def daily_batch(df: DataFrame, ordinal: str, now: str, size: int = 12) -> DataFrame:
    """The rows whose turn it is on a day: size a day, in rotation by ordinal (from 0)."""
    count = df.agg(F.count("*").alias("_n"))
    start = F.pmod((F.dayofyear(F.lit(now).cast("date")) - 1) * size, F.col("_n"))
    return df.crossJoin(F.broadcast(count)).where(F.pmod(F.col(ordinal) - start, F.col("_n")) < size).drop("_n")
