"""Lists that people work through: assets by every filter, and the assets and actions that a reconciliation takes up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import contains_any, page

# Priorities of a court's assets by its state of coherence; most assets of a run; hours in which planned or executed actions keep an asset out; actions that only people take.
CRITICAL, PARTIAL, TARGETED, OTHER = 300, 200, 100, 0
MOST, COOLDOWN = 250, 24
MANUAL = ("resolve_high_severity_conflicts", "link_primary_source_evidence")
PLANNED = ("asset_intelligence_actions_planned", "asset_intelligence_actions_executed")


def assets(
    rows: DataFrame, q: str | None = None, debtor: int | None = None, source: str | None = None, nature: str | None = None, status: str | None = None, compliance: str | None = None, year_from: int | None = None, year_to: int | None = None,
    low: float | None = None, high: float | None = None, sort: str = "created_at", descending: bool = True, number: int = 1, size: int = 25,
) -> DataFrame:
    """A page of assets: rows that meet every filter given, sorted, ties by id. rows carry latest_value, the latest value of each.

    q is looked for in process number, external id and asset number; a filter that is empty or 0 is none. Values are
    sorted with those of no value last, other columns with null first when descending.
    """
    for column, value in (("debtor_id", debtor), ("source", source), ("nature", nature), ("lifecycle_status", status), ("compliance_status", compliance)):
        rows = rows.where(F.col(column) == value) if value else rows
    tests = [contains_any(q, "cnj_number", "external_id", "asset_number")] if q else []
    tests += [F.col("exercise_year") >= year_from] if year_from else []
    tests += [F.col("exercise_year") <= year_to] if year_to else []
    tests += [F.col("latest_value") >= low] if low else []
    tests += [F.col("latest_value") <= high] if high else []
    for test in tests:
        rows = rows.where(test)
    if sort == "face_value":
        order = F.desc_nulls_last("latest_value") if descending else F.asc_nulls_last("latest_value")
    else:
        order = F.desc_nulls_first(sort) if descending else F.asc_nulls_last(sort)
    return page(rows, [order, F.asc("asset_id")], number, size)


def publications_of_assets(publications: DataFrame, processes: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """(keys, asset_id) with a publication of their own or of one of their processes. publications: asset_id, process_id; processes: process_id, asset_id."""
    direct = publications.where("asset_id is not null").select(*keys, "asset_id")
    linked = publications.where("process_id is not null").select(*keys, "process_id").distinct().join(processes.where("asset_id is not null").select(*keys, "process_id", "asset_id"), [*keys, "process_id"]).select(*keys, "asset_id")
    return direct.union(linked).distinct()


def presence(tables: dict[str, DataFrame], keys: Sequence[str] = ("tenant_id", "asset_id")) -> DataFrame:
    """A row for each key that any table has, with a flag for each table: rows are a key and a bit, summed before the one shuffle, however many tables there are."""
    rows = None
    for at, df in enumerate(tables.values()):
        own = df.select(*keys, F.lit(1 << at).cast("long").alias("_bit"))
        rows = own if rows is None else rows.unionAll(own)
    told = rows.groupBy(*keys).agg(F.bit_or("_bit").alias("_bits"))
    return told.select(*keys, *((F.col("_bits").bitwiseAND(F.lit(1 << at).cast("long")) != 0).alias(name) for at, name in enumerate(tables)))


def court_priority(court: Column | str, critical: Sequence[str], partial: Sequence[str], targeted: Sequence[str]) -> Column:
    """How urgent a court's assets are, by its coherence; 0 for others and for none."""
    c = F.lower(F.trim(F.col(court) if isinstance(court, str) else court))
    return F.when(c.isin(*critical), CRITICAL).when(c.isin(*partial), PARTIAL).when(c.isin(*targeted), TARGETED).otherwise(OTHER)


def reconcilable(rows: DataFrame, tables: dict[str, DataFrame], audits: DataFrame, now: str, cooldown: int = COOLDOWN, source: str | None = None, keys: Sequence[str] = ("tenant_id", "asset_id")) -> DataFrame:
    """Assets that lack a score, a process, a publication, a valuation, a budget fact or a source, or have a candidate that waits or a conflict; without those that a reconciliation took up within `cooldown` hours.

    rows: tenant_id, asset_id, current_score_id, current_score, source, deleted_at. tables, each with the keys:
    processes, publications, valuations, budgets, links, candidates (with status), conflicts. audits: the keys,
    event, created_at. keys: asset_id alone will do where ids are unique across tenants.
    """
    live = rows.where("deleted_at is null")
    live = live.where(F.col("source") == source) if source else live
    since = F.lit(now).cast("timestamp") - F.expr(f"interval {int(cooldown)} hours")
    recent = audits.where(F.col("event").isin(*PLANNED) & (F.col("created_at") >= since))
    told = presence(tables | {"candidates": tables["candidates"].where(F.col("status").isin("candidate", "ambiguous")), "_recent": recent}, keys)
    whole = ~F.col("candidates") & ~F.col("conflicts")
    for name in ("processes", "publications", "valuations", "budgets", "links"):
        whole = whole & F.col(name)
    # Only keys that can keep an asset out meet the assets: those taken up lately, and those that lack nothing.
    out = live.join(told.select(*keys, "_recent", whole.alias("_whole")).where("_recent or _whole"), list(keys), "left")
    lacks = F.col("current_score_id").isNull() | F.col("current_score").isNull() | ~F.coalesce("_whole", F.lit(False))
    return out.where(lacks & ~F.coalesce("_recent", F.lit(False))).drop("_recent", "_whole")


def chosen(rows: DataFrame, priority: Column | None = None, limit: int = 25) -> DataFrame:
    """The first assets of a run. With priorities the four times as many that were updated longest ago are ranked by them; without, those updated longest ago come."""
    limit = max(1, min(int(limit), MOST))
    first = rows.orderBy(F.asc_nulls_last("updated_at"), "asset_id").limit(min(limit * 4, MOST) if priority is not None else limit)
    ranked = first.withColumn("coherence_priority", priority if priority is not None else F.lit(OTHER))
    return ranked.orderBy(F.desc("coherence_priority"), F.col("asset_id").cast("string")).limit(limit)


def selected_actions(actions: DataFrame, high_only: bool = False, manual: bool = True, despite_conflicts: bool = False, most: int = 4) -> DataFrame:
    """(asset_id, keys): an asset's actions that a run takes, by priority, at most `most`. actions: asset_id, at (their order), key, priority.

    A conflict of high severity is resolved first: without leave to go on despite it, it is the only action.
    """
    rank = F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("priority"))
    whole = actions.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct((-rank).alias("rank"), "at", "key", "priority"))).alias("a"))
    keep = F.col("a")
    if not despite_conflicts:
        blocked = F.exists("a", lambda x: x["key"] == MANUAL[0])
        keep = F.when(blocked, F.filter("a", lambda x: x["key"] == MANUAL[0])).otherwise(F.col("a"))
    if high_only:
        keep = F.filter(keep, lambda x: x["priority"] == "high")
    if not manual:
        keep = F.filter(keep, lambda x: ~x["key"].isin(*MANUAL))
    return whole.select("asset_id", F.slice(F.transform(keep, lambda x: x["key"]), 1, int(most)).alias("keys"))
