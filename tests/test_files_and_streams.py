"""Files on disk, writers, and streams against their batch results."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import dates, maths
from quarry.operators import legal
from quarry.sources import files, sinks
from quarry.streaming import events as streams


def test_large_delimited_files_are_read_in_splits(spark, tmp_path):
    for number in range(2):
        (tmp_path / f"{number}.csv").write_text("Número do Processo;Valor (R$)\n" + "\n".join(f'{number}-{k};"1;{k}"' for k in range(50)), encoding="latin-1")
    rows = files.read_delimited(spark, str(tmp_path), encoding="ISO-8859-1").collect()
    assert len(rows) == 100 and {(r.row["numero_do_processo"], r.row["valor_r"]) for r in rows} == {(f"{n}-{k}", f"1;{k}") for n in range(2) for k in range(50)}


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Órgão\r\n\nfim".encode("cp1252"))
    assert [(r.n, r.line) for r in files.read_lines(spark, str(tmp_path / "a.txt")).orderBy("n").collect()] == [(1, "Órgão"), (2, ""), (3, "fim")]


def test_cells(spark):
    given = {'a;"b;c";': ["a", "b;c", ""], ";": ["", ""], "": [""], '"a;b': ["a;b"], ' x ;"y"z; ': ["x", "yz", ""], 'a,"b;c': ["a,b;c"]}
    rows = spark.createDataFrame([(x,) for x in given], "line string").select("line", files.cells("line", ";").alias("c")).collect()
    assert {r.line: r.c for r in rows} == given
    long = '"x";' * 100_000
    assert spark.createDataFrame([(long,)], "line string").select(F.size(files.cells("line")).alias("n")).first().n == 100_001


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'x"y', None), (2, "z", "w")], "k int, a string, b string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(tuple(r.row.get(c) for c in ("k", "a")) for r in files.read_delimited(spark, str(tmp_path / "csv")).collect()) == [("1", 'x"y'), ("2", "z")]
    for _ in range(2):
        sinks.append(rows, str(tmp_path / "log"), ["k"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.overwrite_partitions(rows.where("k = 1").withColumn("a", F.lit("new")), str(tmp_path / "log"), ["k"])
    assert sorted((r.k, r.a) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, "new"), (2, "z"), (2, "z")]


def test_a_stored_aggregate_is_computed_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v int")
    for where, wanted in (("true", {1: 5, 2: 4}), ("k = 1", {1: 5})):
        assert {r.k: r.s for r in sinks.refresh(rows.where(where).groupBy("k").agg(F.sum("v").alias("s")), str(tmp_path / "view")).collect()} == wanted


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    """Two files of events, the second with repeats of the first: once each, by window, by job."""
    source, batch = str(tmp_path / "in"), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    batch.coalesce(1).write.mode("append").parquet(source)
    batch.where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(source)
    read = streams.read_events(spark, source)
    run = lambda df, name, mode="append": streams.run_available(df, str(tmp_path / name), str(tmp_path / f"c_{name}"), mode) and spark.read.parquet(str(tmp_path / name))
    assert run(streams.once(read, "40 days"), "once").count() == batch.count()
    per = {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in run(streams.windowed(read), "windows").collect()}
    wanted = spark.read.parquet(source).groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    wanted = {(r.w.start, r.event_type): (r.n, round(r.total, 6)) for r in wanted.collect()}
    assert per and all(wanted[key] == value for key, value in per.items())  # windows still open at the end are not out yet
    jobs = [r.job_id for r in run(streams.job_keys(read, late="40 days"), "jobs").collect()]
    assert len(jobs) == len(set(jobs)) == batch.select("event_type", F.window("ts", "15 minutes")).distinct().count()
    codes = spark.createDataFrame([("error", "suspension_detected")], "event_type string, code string")
    assert run(streams.signals(read.where("event_id % 2 = 1"), codes), "signals").count() == batch.where("event_type = 'error' and event_id % 2 = 1").count()


def test_deadlines_before_a_recess(spark):
    """Calendar days that end on a weekend before the recess roll into it; those that reach it are suspended."""
    days = dates.calendar(spark, "2026-01-01", "2027-12-31")
    rows = spark.createDataFrame([(dt.date(2026, 12, 14), 5, "calendar_days"), (dt.date(2026, 12, 10), 15, "calendar_days"), (dt.date(2026, 12, 17), 3, "business_days"), (dt.date(2026, 4, 30), 1, "business_days"), (None, 5, "calendar_days")], "p date, n int, k string")
    got = [r.due_on for r in dates.deadlines(rows, "p", "n", "k", days).orderBy(F.col("p").desc_nulls_last()).collect()]
    assert got == [dt.date(2027, 1, 22), dt.date(2026, 12, 21), dt.date(2027, 1, 26), dt.date(2026, 5, 4), None]


def test_the_last_date_in_reach(spark):
    day, time = legal.dated_event(F.col("t"), legal.HEARING)
    texts = {"audiencia redesignada de 01/02/2024 para 12/05/2024 as 9:30": (dt.date(2024, 5, 12), "09:30"), "audiencia " + "x" * 90 + " 01/02/2024": (None, None), "conciliacao 01/02/2024": (dt.date(2024, 2, 1), None), "nada": (None, None)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", day.alias("d"), time.alias("h")).collect()
    assert {r.t: (r.d, r.h) for r in rows} == texts


def test_exact_rounding(spark):
    given = {1.005: 1.0, 1.255: 1.25, 2.5: 2.5, -1.005: -1.0, 0.125: 0.13, -0.125: -0.13, 8.345: 8.35, 10.235: 10.23, 0.0: 0.0, 1e12 + 0.005: round(1e12 + 0.005, 2)}
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", maths.to_fixed("x", 2).alias("y")).collect()
    assert {r.x: r.y for r in rows} == given


def test_years_of_links(spark):
    """Numbers in a page's address are no years, those in a file's are."""
    links = [(1, 0, "/mapa/2010", "Mapa"), (1, 1, "/mapa/2011", "Mapa de 2012"), (1, 2, "/lista-2013.csv", "Lista"), (1, 3, "/lista-2014.csv", "Lista de 2015")]
    rows = files.ranked_links(spark.createDataFrame(links, "page int, n int, href string, title string"), "page").orderBy("n").collect()
    assert [r.year for r in rows] == [None, 2012, 2013, 2015]
