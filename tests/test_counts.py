"""Counts of many tables take one shuffle and one join."""

import pytest

from quarry.operators import relational
from quarry.plans import golden, reports


def test_counts_by_kind(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None), (3, "other"), (None, "a")], "k int, kind string")
    out = relational.counts_by_kind(rows, ["k"], "kind", ["a", "b"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, 1), (2, 0, 1), (3, 0, 0), (None, 1, 0)]


@pytest.mark.parametrize(("query", "joins"), [(golden.dossier_confidence, 2), (reports.asset_timelines, 1), (reports.asset_dossiers, 1)], ids=lambda x: getattr(x, "__name__", str(x)))
def test_counts_meet_assets_once(spark, sf_dir, query, joins):
    assert query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == joins
