"""Versions without a gap, upserts by batches, cursors, contents by hash, revealed data, stages and heartbeats."""

import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import history, relational, reveal
from quarry.sources import paged, versions
from quarry.streaming import events


def test_refresh_without_a_gap(spark, tmp_path):
    root, rows = str(tmp_path / "view"), spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v int")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    reader = versions.refresh(rows, root)
    assert versions.refresh(reader.where("k = 1"), root).count() == 2  # computed from the version before
    assert reader.count() == 3  # opened before the refresh
    assert versions.refresh(rows.limit(0), root).count() == 2  # an empty one leaves the last
    with pytest.raises(Exception, match="USER_RAISED|no"):
        versions.refresh(rows.withColumn("v", F.raise_error(F.lit("no")).cast("int")), root)
    assert versions.current(spark, root).count() == 2
    assert versions.forget(spark, root, keep=0) == 3 and versions.current(spark, root).count() == 2


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "table")
    merge = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new.groupBy("k").agg(F.max("v").alias("v")))
    assert versions.bucketed(spark, root) is None
    first = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(1).alias("v"))
    assert versions.upsert_batch(first, 0, root, ["k"], merge, 16)
    files = lambda: {f for f in glob.glob(f"{root}/*/bucket=*/*.parquet")}
    before, state = files(), json.load(open(f"{root}/_current"))
    change = spark.createDataFrame([(7, 5), (7, 6)], "k long, v int")
    assert versions.upsert_batch(change, 1, root, ["k"], merge, 16)
    now = json.load(open(f"{root}/_current"))
    assert sum(now["buckets"][b] != state["buckets"][b] for b in state["buckets"]) == 1 and before <= files()
    got = {r.k: r.v for r in versions.bucketed(spark, root).collect()}
    assert got == {None: 1, **{k: 1 for k in range(1, 200)}, 7: 6}
    assert not versions.upsert_batch(change.withColumn("v", F.lit(99)), 1, root, ["k"], merge, 16) and files() == files()
    assert json.load(open(f"{root}/_current")) == now
    gone = lambda old, new: old.join(new.select("k"), "k", "left_anti")
    assert versions.upsert_batch(first, 2, root, ["k"], gone, 16) and versions.bucketed(spark, root).where("k > 0").count() == 0


def test_stream_of_stages_with_late_ones(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    parts = [[(1, 1, 10, "new", day(1)), (1, 1, 12, "talks", day(5)), (1, 2, 20, "new", day(2))], [(1, 1, 13, "talks", day(7)), (1, 1, 11, "offer", day(6)), (1, 1, 12, "talks", day(5))], [(1, 1, 14, "won", day(6)), (1, 2, 21, None, day(3))]]
    source, shape = str(tmp_path / "in"), "tenant_id int, opportunity_id int, transition_id int, to_stage string, changed_at timestamp"
    for rows in parts:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        versions.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["tenant_id", "opportunity_id"], history.merged_transitions, 4)
    spans = history.stage_intervals(versions.bucketed(spark, str(tmp_path / "t")))
    got = sorted((r.opportunity_id, r.stage, r.valid_from.day, r.valid_to and r.valid_to.day, r.changes) for r in spans.collect())
    assert got == [(1, "new", 1, 5, 1), (1, "talks", 5, 6, 1), (1, "talks", 7, None, 1), (1, "won", 6, 7, 1), (2, "new", 2, None, 1)]
    moments = spark.createDataFrame([(1, 1, day(6)), (1, 2, day(1))], "tenant_id int, opportunity_id int, at timestamp")
    assert sorted((r.opportunity_id, r.stage) for r in history.as_of(spans, moments).collect()) == [(1, "won"), (2, None)]


def test_pages_behind_a_cursor(spark, tmp_path):
    """Stopped and started again, and with hits that came meanwhile, each hit comes once."""
    paged.register(spark)
    hits = [{"_id": k, "sort": [k // 3, k], "_source": {"numero": f"é{k}"}} for k in range(57)]

    def put(name, part):
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "pages" / f"{name}.json").write_text(json.dumps({"hits": {"hits": part}}), encoding="utf-8")

    def run():
        stream = spark.readStream.format("paged_hits").option("path", str(tmp_path / "pages")).option("page_size", 4).option("pages", 3).load()
        events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
        return spark.read.parquet(str(tmp_path / "out"))

    put("a", hits[:23])
    for _ in range(3):
        run()
    put("b", [])
    put("c", hits[23:])
    for _ in range(6):
        out = run()
    assert sorted(int(r.id) for r in out.collect()) == list(range(57))
    assert {json.loads(r.hit)["numero"] for r in out.where("id = 5").collect()} == {"é5"}


def test_contents_are_kept_once(spark, tmp_path):
    paged.register(spark)
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("t1", "a b.csv", bytearray(b"x")), ("t1", "a b.csv", bytearray(b"x")), ("t1", "c.csv", bytearray(b"x")), ("t2", "a b.csv", bytearray(b"x")), ("t1", "a b.csv", None)], "tenant string, name string, content binary").repartition(3)
    for _ in range(2):
        rows.write.format("content_store").option("path", root).mode("append").save()
    files = lambda: {os.path.relpath(f, root) for f in glob.glob(f"{root}/t*/**", recursive=True) if os.path.isfile(f)}
    kept = files()
    x, none = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert kept == {f"t1/{x}-a_b.csv", f"t1/{x}-c.csv", f"t2/{x}-a_b.csv", f"t1/{none}-a_b.csv"}
    broken = rows.withColumn("content", F.lit(b"new")).withColumn("name", F.when(F.col("tenant") == "t2", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception):  # noqa: B017
        broken.write.format("content_store").option("path", root).mode("append").save()
    assert files() == kept


def test_revealed_once_logged_once(spark, tmp_path):
    key, log = "0123456789abcdef", str(tmp_path / "log")
    people = spark.createDataFrame([(1, 7, "Ana", "123", "", None, None), (1, 8, "Gone", "1", "2", "3", dt.datetime(2024, 1, 1)), (2, 7, "Other tenant", "9", "9", "9", None)], "tenant_id int, id int, name string, document string, email string, phone string, deleted_at timestamp")
    people = people.withColumns({c: reveal.encrypted(c, key) for c in reveal.SECRET})
    asked = spark.createDataFrame([("a", 1, 5, 7, "why"), ("a", 1, 5, 7, "why"), ("b", 1, 5, 8, None), ("c", 1, 5, 99, "x")], "request_id string, tenant_id int, user_id int, beneficiary_id int, reason string")
    with pytest.raises(PermissionError):
        reveal.reveal(people, asked, None, log)
    assert [(r.action, r.allowed) for r in spark.read.parquet(log).where("request_id = 'b'").collect()] == [("reveal_denied", False)]
    for _ in range(2):  # the second is a retry
        out = reveal.reveal(people, asked, key, log)
    assert [tuple(r) for r in out.collect()] == [("a", 7, "Ana", "123", None, None)]
    wrong = reveal.reveal(people, asked.limit(1), "f" * 16, log)
    with pytest.raises(Exception):  # noqa: B017  the log has it nevertheless
        wrong.collect()
    rows = spark.read.parquet(log).where("allowed").collect()
    assert sorted(r.request_id for r in rows) == ["a", "b", "c"]


def test_a_queue_falls_silent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    beat = lambda *rows: spark.createDataFrame(rows, "queue_name string, checked_at timestamp").coalesce(1).write.mode("append").parquet(source)
    beat(("a", dt.datetime(2024, 1, 1, 0, 0, 10)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1)))
    stream = events.heartbeat_states(spark.readStream.schema("queue_name string, checked_at timestamp").parquet(source), 4)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def states():
        return sorted((r.queue_name, r.status, r.checked_at.second) for r in spark.read.schema("queue_name string, status string, checked_at timestamp").parquet(out).collect()) if glob.glob(f"{out}/*.parquet") else []

    def until(n):
        end = time.time() + 60
        while len(states()) < n and time.time() < end:
            time.sleep(0.3)
        return states()

    try:
        assert until(2)[:2] == [("a", "ok", 10), ("b", "ok", 0)]
        assert until(4) == [("a", "ok", 10), ("a", "stale", 10), ("b", "ok", 0), ("b", "stale", 0)]
        beat(("a", dt.datetime(2024, 1, 1, 0, 0, 9)), ("b", dt.datetime(2024, 1, 1, 0, 0, 20)))
        assert ("b", "ok", 20) in until(5) and [s for q, s, _ in states() if q == "a"] == ["ok", "stale"]
    finally:
        query.stop()
