"""Joins with hot keys, components, and plans on both sides of a switch, against plain results."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import _shared, jaccard_join, substring_dedup


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_a_hot_key(spark, how):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    per_key = rows.select("k").distinct().where("k % 3 > 0").withColumn("w", F.col("k") * 2)
    hot = _shared.hot_keys(rows, "k")
    assert [(r.k, r.salts) for r in hot.collect()] == [(1, 4)] and _shared.hot_keys(rows.where("k > 1"), "k") is None
    counted = _shared.hot_counts(rows.groupBy("k").count(), "k")
    assert [tuple(r) for r in counted.collect()] == [(1, 4)] and _shared.hot_counts(rows.limit(0).groupBy("k").count(), "k") is None
    got = sorted(map(tuple, _shared.spread_join(rows, per_key, "k", "v", hot, how).select("k", "v", "w").collect()))
    assert got == sorted(map(tuple, rows.join(per_key, "k", how).select("k", "v", "w").collect()), key=lambda r: (r[0], r[1]))


def test_components(spark):
    r = random.Random(7)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(90)] + [(5, 5), (None, 3)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {row.node: row.component for row in _shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert _shared.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similarity_with_ids_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", -1)
    texts = [" ".join(f"w{k % 40 + (k == j) * 100}" for k in range(40)) for j in range(6)] + ["other words entirely here now"]
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    parent = list(range(len(texts)))
    for _ in parent:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if near(i, j):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert got == dict(enumerate(parent))


@pytest.mark.parametrize(("before", "after"), [("0", "1000"), ("-1", "1000"), ("10000", "1000"), ("10", "10")])
def test_batches_are_bounded_whatever_the_session_says(spark, before, after):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        _shared.small_batches(spark.range(1))
        assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, old)


def test_windows_that_very_many_documents_have(spark):
    """One window in 3,000 texts that differ around it, its anchor and itself above the bound from which keys are dealt out."""
    shared = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(3)] + shared + [f"b{k}x{j}" for j in range(3)])) for k in range(3000)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, rows[0][1]) and len(got) == len(rows)
    assert all(got[k] == (50, " ".join(text.split()[:3] + text.split()[-3:])) for k, text in rows[1:])
