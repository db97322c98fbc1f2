"""An asset's timeline and dossier: gaps, completeness, next actions, flags, evidence graph, freshness, and planned actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import age_days
from quarry.functions.maths import half_up

# Gaps of a timeline in order, with the value or count that must be there.
VALUE_GAPS = (("cnj_number", "missing_cnj_number"), ("debtor_id", "missing_debtor"), ("court_id", "missing_court_catalog"))
GAPS = (("valuations", "missing_valuation_snapshot"), ("budget_facts", "missing_budget_fact"))
LATE_GAPS = (("publications", "missing_publication_history"), ("scores", "missing_score_history"))
#: Kinds of events that are risks and chances.
RISKS = ("cession_detected", "prior_cession_detected", "judicial_block_detected", "suspension_detected", "attachment_detected", "regime_special_detected")
CHANCES = ("direct_agreement_opened", "payment_available", "superpreference_detected", "final_judgment_detected", "calculation_homologated")
# Action and priority for each check of a dossier that is not complete.
CHECK_ACTIONS = (("publication_history", "sync_djen_publications", "medium"), ("financial_facts", "backfill_financial_facts", "medium"), ("source_evidence", "link_primary_source_evidence", "medium"), ("scoring", "recompute_asset_score", "low"))


def _has(c: str) -> Column:
    """A count over 0, or a flag."""
    return F.coalesce(F.col(c).cast("long") > 0, F.lit(False))


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") != "", F.lit(False))


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def gaps() -> Column:
    """Codes of what a row's timeline lacks: cnj_number, debtor_id, court_id, counts of its children, and pending_candidates."""
    of = lambda pairs, there=_has: [F.when(~there(c), F.lit(code)) for c, code in pairs]
    process = F.when(~_has("processes") & ~_has("candidates"), F.lit("missing_datajud_process_link"))
    return _texts(*of(VALUE_GAPS, _known), *of(GAPS), process, F.when(_has("pending_candidates"), F.lit("pending_process_candidate_review")), *of(LATE_GAPS))


def completeness() -> Column:
    """Share of nine checks that a timeline passes, in whole per cent."""
    checks = [_has("has_source") | _has("source_links"), *(_known(c) for c, _ in VALUE_GAPS), *(_has(c) for c, _ in GAPS), _has("processes") | _has("candidates"), *(_has(c) for c, _ in LATE_GAPS)]
    passed = F.lit(0)
    for check in checks:
        passed = passed + check.cast("int")
    return half_up(passed / len(checks) * 100).cast("int")


def next_actions() -> Column:
    """What to do about the gaps of a row with gaps, counts, score and has_opportunity, in order."""
    lacks = lambda code: F.array_contains("gaps", code)
    return _texts(
        F.when(lacks("missing_cnj_number"), F.lit("enrich_asset_from_datajud")), F.when(lacks("pending_process_candidate_review"), F.lit("review_datajud_candidates")),
        F.when(~_has("processes") & _has("candidates"), F.lit("promote_best_process_candidate")), F.when(lacks("missing_publication_history"), F.lit("sync_djen_publications")), F.when(lacks("missing_score_history"), F.lit("recompute_asset_score")),
        F.when(~F.coalesce("has_opportunity", F.lit(False)) & (F.coalesce("score", F.lit(0)) >= 85), F.lit("create_cession_opportunity")),
    )


def dossier_actions() -> Column:
    """Array of (key, priority) from the states of a dossier's checks (a struct checks), high_conflicts, candidates, score and has_opportunity."""
    action = lambda key, priority: F.struct(F.lit(key).alias("key"), F.lit(priority).alias("priority"))
    open_ = lambda check: F.col(f"checks.{check}") != "complete"
    link = F.when(_has("candidates"), action("review_datajud_candidates", "high")).otherwise(action("enrich_from_datajud", "high"))
    return _texts(
        F.when(_has("high_conflicts"), action("resolve_high_severity_conflicts", "high")), F.when(open_("judicial_process"), link), *(F.when(open_(check), action(key, priority)) for check, key, priority in CHECK_ACTIONS),
        F.when(~F.coalesce("has_opportunity", F.lit(False)) & (F.col("score") >= 80), action("create_cession_opportunity", "low")),
    )


def flags(signals: DataFrame, events: DataFrame) -> DataFrame:
    """(asset_id, kind, code, at): risks are negative signals and risky events; chances positive signals and good ones.

    signals: asset_id, code, polarity, at; events: asset_id, event_type, at.
    """
    of_signal = signals.where("polarity in ('positive', 'negative')").select("asset_id", F.when(F.col("polarity") == "negative", F.lit("risk")).otherwise(F.lit("chance")).alias("kind"), "code", "at")
    kind = F.when(F.col("event_type").isin(*RISKS), F.lit("risk")).when(F.col("event_type").isin(*CHANCES), F.lit("chance"))
    return of_signal.unionAll(events.select("asset_id", kind.alias("kind"), F.col("event_type").alias("code"), "at").where("kind is not null"))


def evidence_graph(links: DataFrame) -> DataFrame:
    """Per asset: its links, the count of each role as a map, and the least, average and greatest confidence (four decimals)."""
    by_role = links.groupBy("asset_id", "role").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.sum("confidence").alias("sum"), F.count("confidence").alias("known"))
    return by_role.groupBy("asset_id").agg(
        F.sum("n").alias("links"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("by_role"), F.min("low").alias("minimum"), F.round(F.sum("sum") / F.sum("known"), 4).alias("average"), F.max("high").alias("maximum"),
    )


def distinct_values(identifiers: DataFrame, kinds: Sequence[str], value: str = "value") -> DataFrame:
    """Per asset and kind of identifier: its different normalised values, in order."""
    return identifiers.where(F.col("kind").isin(*kinds)).groupBy("asset_id", "kind").agg(F.sort_array(F.collect_set(value)).alias("values"))


def freshness(dates: DataFrame, assets: DataFrame, now: str, days: int = 30) -> DataFrame:
    """assets with the latest of all dates (asset_id, at) of evidence, its age, and whether it is stale, as it is without any."""
    latest = dates.groupBy("asset_id").agg(F.max("at").alias("latest_at"))
    out = assets.join(latest, "asset_id", "left").withColumn("age", age_days("latest_at", F.lit(now).cast("timestamp")))
    return out.withColumn("stale", F.coalesce(F.col("age") > days, F.lit(True)))


def planned(actions: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """(asset_id, key, priority): an asset's own actions, or, of those requested, each once: its own or one of low priority."""
    if not requested:
        return actions.select("asset_id", "key", "priority")
    keys = list(dict.fromkeys(requested))
    wanted = actions.select("asset_id").distinct().withColumn("key", F.explode(F.array(*map(F.lit, keys))))
    return wanted.join(actions.select("asset_id", "key", "priority"), ["asset_id", "key"], "left").fillna({"priority": "low"})


def court_job_id(tenant: Column | str, key: Column | str, court: Column | str, start: Column | str, end: Column | str) -> Column:
    """Id of a job for a court and a span of days: the same for all assets that ask for it."""
    text = lambda c, default: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(default))
    return F.concat_ws("-", F.lit("asset-intelligence"), text(tenant, ""), text(key, ""), text(court, "national"), text(start, "open"), text(end, "open"))
