"""Tables that are asked only for their keys meet in one shuffle and one join."""

import pytest

from quarry.operators import lists
from quarry.plans import lists as list_plans

NAMES = ("processes", "publications", "valuations", "budgets", "links", "candidates", "conflicts")


def planned(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()


def test_presence_deals_once(spark):
    tables = {name: spark.createDataFrame([(1, 1), (1, 1), (1, at + 2), (1, None)], "tenant_id int, asset_id int") for at, name in enumerate(NAMES)}
    out = lists.presence(tables)
    assert planned(out)[1].count("Exchange hashpartitioning") == 1
    got = {r.asset_id: tuple(r[name] for name in NAMES) for r in out.collect()}
    assert got == {1: (True,) * 7, None: (True,) * 7} | {at + 2: tuple(i == at for i in range(7)) for at in range(7)}


@pytest.mark.parametrize("query", [list_plans.reconcilable_assets, list_plans.reconcile_choice], ids=lambda f: f.__name__)
def test_tables_meet_assets_once(spark, sf_dir, query):
    """One join with all tables, one with the processes of publications, and those of assets and publications with debtors and courts."""
    assert planned(query(spark, sf_dir))[0].count("Join ") == 6


@pytest.mark.parametrize("keys", [("tenant_id", "asset_id"), ("asset_id",)], ids=len)
def test_reconcilable(spark, keys):
    """1 is whole; 2 to 8 lack or have one thing each; 9 has no score; 10 lacks all; 11 and 12 were taken up lately, 13 long ago; 14 is deleted; 15 has no id."""
    rows = spark.createDataFrame([(1, k, None if k == 9 else k, 1, "a", "x" if k == 14 else None) for k in [*range(1, 15), None]], "tenant_id int, asset_id int, current_score_id int, current_score int, source string, deleted_at string")
    have = {name: [k for k in range(1, 14) if k not in (at + 2, 10, 12, 13)] for at, name in enumerate(NAMES[:5])} | {"conflicts": [8], "candidates": [7]}
    make = lambda name, ids: spark.createDataFrame([(1, k, s) for k in ids for s in ("ambiguous", "rejected")] + [(1, 1, "rejected")] * (name == "candidates"), "tenant_id int, asset_id int, status string")
    audits = spark.createDataFrame([(1, 11, lists.PLANNED[0], "2024-01-10 00:00:00"), (1, 12, lists.PLANNED[1], "2024-01-09 12:00:00"), (1, 12, "other", "2024-01-10 00:00:00"), (1, 13, lists.PLANNED[0], "2024-01-08 00:00:00"), (1, 10, "other", "2024-01-10 00:00:00")], "tenant_id int, asset_id int, event string, created_at string")
    audits = audits.withColumn("created_at", audits.created_at.cast("timestamp"))
    out = lists.reconcilable(rows, {name: make(name, ids) for name, ids in have.items()}, audits, "2024-01-10 06:00:00", 24, "a", keys)
    assert sorted((r.asset_id or 0) for r in out.collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13]
    assert set(out.columns) == set(rows.columns)
