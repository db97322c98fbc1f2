"""Coverage, quality, coherence and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import age_days
from quarry.functions.maths import clamp, ratio
from quarry.functions.text import col

# Grades by least quality.
QUALITY_GRADES = ((0.85, "A"), (0.7, "B"), (0.5, "C"))


def quality_grade(score: Column | str) -> Column:
    out = F.lit("D")
    for least, grade in reversed(QUALITY_GRADES):
        out = F.when(col(score) >= least, F.lit(grade)).otherwise(out)
    return out


def source_quality(runs: DataFrame, key: str = "source_id") -> DataFrame:
    """Per source: valid coverage, yield, field coverage, error rate, and the weighted score with its grade.

    runs: rows, valid, relevant, imported, errors and field_coverage (null where a run has none). Valid rows
    are measured against all rows, else the relevant, else themselves; imported rows and errors against the
    relevant rows, else the valid, else the imported ones. Averages leave nulls out; without any field
    coverage the valid coverage stands for it.
    """
    out = runs.groupBy(key).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "valid", "relevant", "imported", "errors")), F.avg("field_coverage").alias("field_coverage"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in names), F.lit(0))
    basis = first("relevant", "valid", "imported")
    out = out.withColumns({"valid_coverage": ratio("valid", first("rows", "relevant", "valid")), "yield": ratio("imported", basis), "error_rate": ratio("errors", F.col("errors") + basis)})
    fields = F.coalesce(F.col("field_coverage"), F.col("valid_coverage"))
    score = 0.4 * F.col("valid_coverage") + 0.3 * F.col("yield") + 0.2 * fields + 0.1 * (1 - F.col("error_rate"))
    return out.withColumn("quality_score", F.round(score, 4)).withColumn("grade", quality_grade("quality_score"))


def extraction_completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the share of rows with each field, and with all."""
    whole = F.lit(True)
    for field in fields:
        whole = whole & F.col(field).isNotNull()
    return rows.agg(F.count("*").alias("n_rows"), *(ratio(F.count(field), F.count("*")).alias(f"{field}_ratio") for field in fields), ratio(F.count_if(whole), F.count("*")).alias("complete_ratio"))


#: Coverage layers from weakest to strongest.
LAYERS = ("missing", "blocked", "mapped", "configured", "validated")


def layer_status() -> Column:
    """Of rows with needs_captcha, runnable, has_evidence and url."""
    return F.when(F.col("needs_captcha"), F.lit("blocked")).when(F.col("runnable") & F.col("has_evidence"), F.lit("validated")).when(F.col("runnable"), F.lit("configured")).when(F.col("url").isNotNull(), F.lit("mapped")).otherwise(F.lit("missing"))


def layer_rank(status: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), col(status)).cast("int") - 1


def primary_targets(targets: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The strongest target of each key; ties go to the first by order."""
    from quarry.operators.relational import top_by

    return top_by(targets, [key], [layer_rank(status).desc(), *(F.asc(c) for c in order)])


def layers(targets: DataFrame, key: str, counts: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per key its strongest target, as a layer: status, evidence_score and the counts behind them.

    targets: key, name, status, adapter, url, last_success_at, discovered, records, priority_order, dataset. A target
    ranks by its own status, then adapter, address and counts in points; of equal ones the first by priority_order and
    name. counts: dataset, records of the tenant, which count for the layer's status and score, not for the rank.
    """
    from quarry.operators.relational import top_by

    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    runs = F.col("status").isin("implemented", "generic_supported") & F.col("adapter").isNotNull()

    def state(tenant: Column) -> Column:
        evidence = F.col("last_success_at").isNotNull() | (n("discovered") > 0) | (n("records") > 0) | (tenant > 0)
        return F.when(F.col("status") == "blocked_captcha", F.lit("blocked")).when(runs & evidence, F.lit("validated")).when(runs, F.lit("configured")).when(F.col("url").isNotNull(), F.lit("mapped")).otherwise(F.lit("missing"))

    rank = layer_rank(state(F.lit(0))) * 1000 + F.when(F.col("adapter").isNotNull(), 100).otherwise(0) + F.when(F.col("url").isNotNull(), 10).otherwise(0) + n("records") + n("discovered")
    best = top_by(targets.withColumn("rank", rank), [key], [F.desc("rank"), F.asc("priority_order"), F.asc("name")])
    out = best.join(counts.select(dataset, F.col("records").alias("tenant_records")), dataset, "left").withColumn("tenant_records", n("tenant_records"))
    score = F.when(F.col("last_success_at").isNotNull(), 2.0).otherwise(0.0) + F.least(n("discovered"), F.lit(100)) / 100 + F.least(n("records") + F.col("tenant_records"), F.lit(100)) / 50
    return out.withColumns({"layer_status": state(F.col("tenant_records")), "evidence_score": score})


# Gaps of a state's coverage by its primary layer, with severity.
PRIMARY_GAPS = {"missing": ("primary_source_missing", "high"), "mapped": ("primary_source_mapped_without_adapter", "medium"), "configured": ("primary_source_not_validated", "medium")}


def state_intelligence(states: DataFrame) -> DataFrame:
    """states (primary, datajud, djen: layer statuses) with what they allow, whether any data prove it, and gaps (code, severity)."""
    runs = lambda c: F.col(c).isin("validated", "configured")
    out = states.withColumns({"has_primary": runs("primary"), "has_processes": runs("datajud"), "has_publications": runs("djen"), "has_evidence": F.array_contains(F.array("primary", "datajud", "djen"), "validated")})
    out = out.withColumn("ready", F.col("has_primary") & F.col("has_processes") & F.col("has_publications"))
    gap = lambda test, code, severity: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    rows = [gap(F.col("primary") == status, *row) for status, row in PRIMARY_GAPS.items()]
    rows += [gap(F.col(layer) == "missing", f"{layer}_missing", "medium") for layer in ("datajud", "djen")] + [gap(~F.col("ready"), "operational_scoring_incomplete", "low")]
    return out.withColumn("gaps", F.array_compact(F.array(*rows)))


def matrix_summary(states: DataFrame) -> DataFrame:
    """One row: states, those of each primary status, and those with any process and publication layer."""
    return states.agg(F.count("*").alias("states"), *(F.count_if(F.col("primary") == s).alias(s) for s in LAYERS), *(F.count_if(F.col(c) != "missing").alias(c) for c in ("datajud", "djen")))


def coherence_summary(report: DataFrame) -> DataFrame:
    """One row over the courts of coherence: assets and complete ones, the share of each flag (0 without assets), conflicts, and courts: all, with assets, ready and critical."""
    whole = F.sum("assets")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(
        total("assets"), F.coalesce(F.sum("complete"), F.lit(0)).alias("complete_assets"), ratio(F.sum("complete"), whole).alias("complete"), *(ratio(F.sum(flag), whole).alias(flag) for flag in FLAGS), *map(total, TROUBLES),
        F.count("*").alias("courts"), F.count_if(F.col("assets") > 0).alias("courts_with_assets"), F.count_if(F.col("status") == "complete").alias("ready_courts"), F.count_if(F.col("status") == "critical").alias("critical_courts"),
    )


def process_coverage(rows: DataFrame, groups: Column) -> DataFrame:
    """Per group: assets, those with a number and with a process, numbers of no known court, and processes per number in per cent.

    groups: an array of the groups that a row counts in. rows: cnj_number (valid or null), has_process, courts (an array).
    """
    numbered = F.col("cnj_number").isNotNull()
    out = rows.withColumn("group", F.explode(groups)).groupBy("group").agg(
        F.count("*").alias("assets"), F.count_if(numbered).alias("numbered"), F.count_if(numbered & F.col("has_process")).alias("with_process"), F.count_if(numbered & (F.size("courts") == 0)).alias("no_court"),
    )
    return out.withColumn("percent", F.when(F.col("numbered") > 0, F.round(F.col("with_process") / F.col("numbered") * 100, 2)).otherwise(F.lit(0.0)))


def source_groups(sources: DataFrame, key: str) -> DataFrame:
    """Per group: its sources, their counts, and how many are covered, manual or blocked, and in error.

    sources: records, discovered, imported, last_success_at, status, blocked_links, manual_url, last_error_at.
    """
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return sources.groupBy(key).agg(
        F.count("*").alias("sources"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "discovered", "imported")), F.count_if((F.coalesce("records", F.lit(0)) > 0) | F.col("last_success_at").isNotNull()).alias("covered"),
        F.count_if((F.coalesce("status", F.lit("")) == "blocked") | (F.coalesce("blocked_links", F.lit(0)) > 0) | F.col("manual_url").isNotNull()).alias("manual_or_blocked"), F.count_if(F.col("last_error_at").isNotNull() | (F.coalesce("status", F.lit("")) == "error")).alias("errors"),
    )


def without_targets(datasets: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Datasets that no target names."""
    return datasets.join(targets.select(key), key, "left_anti")


# Points of the reasons to run a source again, in their order.
RECOVERY = {
    "configured_without_validated_run": 35, "never_succeeded": 50, "stale_success": 0, "no_tenant_source_records": 30, "quality_unknown": 10, "quality_failed": 35, "quality_weak": 20,
    "low_import_yield": 20, "high_error_rate": 20, "low_field_coverage": 15,
}


def recovery_plan(targets: DataFrame, now: str) -> DataFrame:
    """Reasons, points and priority of the targets that can run: configured or validated, with an adapter. The others go.

    targets: last_success_at, status, adapter, records, grade (null: quality not known), quality_score, yield, error_rate,
    field_coverage. The days since the last success count up to 30 points at any age, lost quality up to 20.
    """
    age = age_days("last_success_at", F.lit(now).cast("timestamp"))
    known, score = F.col("grade").isNotNull(), F.col("quality_score")
    failed = known & ((F.col("grade") == "D") | (score < 0.5))
    tests = {
        "configured_without_validated_run": F.col("status") == "configured", "never_succeeded": F.col("last_success_at").isNull(), "stale_success": age >= 7, "no_tenant_source_records": F.col("records") == 0, "quality_unknown": ~known,
        "quality_failed": failed, "quality_weak": known & ~F.coalesce(failed, F.lit(False)) & ((F.col("grade") == "C") | (score < 0.7)), "low_import_yield": known & (F.col("yield") < 0.5), "high_error_rate": known & (F.col("error_rate") >= 0.25),
        "low_field_coverage": known & (F.coalesce("field_coverage", F.lit(1.0)) < 0.65),
    }
    hits = {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    out = targets.where(F.col("adapter").isNotNull() & F.col("status").isin("configured", "validated"))
    reasons = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in hits.items())))
    out = out.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("healthy_refresh"))))
    points = F.coalesce(F.least(age, F.lit(30)), F.lit(0)) + F.when(known, F.floor(F.round((1 - score) * 20, 9) + 0.5)).otherwise(0) + F.when((F.col("status") == "validated") & (F.col("reasons")[0] == "healthy_refresh"), 5).otherwise(0)
    for name, hit in hits.items():
        points = points + F.when(hit, RECOVERY[name]).otherwise(0)
    out = out.withColumn("recovery_score", points.cast("int"))
    return out.withColumn("recovery_priority", F.when(F.col("recovery_score") >= 80, F.lit("critical")).when(F.col("recovery_score") >= 50, F.lit("high")).when(F.col("recovery_score") >= 25, F.lit("medium")).otherwise(F.lit("low")))


def coverage_score(status: Column, errors: Column, records: Column, linked: Column, discovered: Column) -> Column:
    """0 for a failed run, 0.5 with any error, 1 with records or linked assets, 0.75 if something was discovered, else 0.25."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.when(status == "failed", 0.0).when(n(errors) > 0, 0.5).when((n(records) > 0) | (n(linked) > 0), 1.0).when(n(discovered) > 0, 0.75).otherwise(0.25)


# Fields without which an asset is not known; flags that are counted; what troubles a court; gaps: flag or trouble, code, severity and the action for it.
CORE_FIELDS = ("cnj_number", "debtor_name", "court_alias", "face_value")
FLAGS = ("has_primary_source", "has_process", "has_publication", "has_value", "has_score", "has_evidence", "has_resolved")
TROUBLES = ("conflicts", "field_conflicts", "pending")
GAPS = (
    ("has_primary_source", "missing_primary_source", "high", "link_primary_source"), ("has_process", "missing_datajud_process", "medium", "search_process"), ("has_publication", "missing_djen_publication", "medium", "search_publication"),
    ("has_value", "missing_valuation", "medium", "import_valuation"), ("has_score", "missing_score", "medium", "refresh_score"), ("has_resolved", "missing_field_evidence", "medium", "materialize_field_evidence"),
    ("conflicts", "source_conflicts", "high", "resolve_conflict"), ("field_conflicts", "field_evidence_conflicts", "high", "review_field_evidence"), ("pending", "pending_candidate_review", "medium", "review_candidates"),
)


def coherence(rows: DataFrame, key: str = "court", every: DataFrame | None = None) -> DataFrame:
    """Per court: counts of each flag, of complete assets and of troubled ones, gaps, the first four actions, status.

    rows: one per asset with the first five FLAGS and the counts evidence, resolved_fields, n_conflicts, n_field_conflicts
    and pending_candidates. every: courts that are reported also without assets. An asset is complete with the five flags
    and all core fields resolved, and without conflict or candidate.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumns({"has_evidence": n("evidence") > 0, "has_resolved": n("resolved_fields") >= len(CORE_FIELDS)})
    trouble = dict(zip(TROUBLES, (n("n_conflicts") > 0, n("n_field_conflicts") > 0, n("pending_candidates") > 0), strict=True))
    complete = F.lit(True)
    for test in (*(F.col(flag) for flag in FLAGS if flag != "has_evidence"), *(~test for test in trouble.values())):
        complete = complete & test
    out = rows.groupBy(key).agg(F.count("*").alias("assets"), *(F.count_if(F.col(flag)).alias(flag) for flag in FLAGS), F.count_if(complete).alias("complete"), *(F.count_if(test).alias(name) for name, test in trouble.items()))
    if every is not None:
        out = every.select(key).distinct().join(out, key, "full").fillna(0)
    out = out.withColumn("complete_rate", ratio("complete", "assets"))
    missing = lambda name: F.col(name) if name in TROUBLES else F.col("assets") - F.col(name)
    gap = lambda code, severity, count, action: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), count.cast("long").alias("missing"), F.lit(action).alias("action"))
    gaps = F.array_compact(F.array(*(F.when(missing(name) > 0, gap(code, severity, missing(name), action)) for name, code, severity, action in GAPS)))
    out = out.withColumn("gaps", F.when(F.col("assets") == 0, F.array(gap("no_assets", "medium", F.lit(0), "link_assets"))).otherwise(gaps))
    high = F.exists("gaps", lambda g: g["severity"] == "high")
    usable = (F.col("has_primary_source") > 0) & (F.col("has_process") > 0) & (F.col("has_score") > 0)
    status = F.when(F.col("assets") == 0, F.lit("partial")).when(high, F.lit("critical")).when(F.col("complete_rate") >= 0.95, F.lit("complete")).when(usable, F.lit("usable")).otherwise(F.lit("partial"))
    return out.withColumns({"actions": F.slice(F.transform("gaps", lambda g: g["action"]), 1, 4), "status": status})


def gap_roll_up(report: DataFrame, key: str = "court") -> DataFrame:
    """Per gap code: missing assets, courts, the worst severity and its action."""
    rows = report.select(key, F.explode("gaps").alias("g")).select(key, "g.*")
    rank = F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("severity"))
    return rows.groupBy("code").agg(F.sum("missing").alias("missing"), F.countDistinct(key).alias("courts"), F.max_by("severity", rank).alias("severity"), F.min("action").alias("action"))


def readiness(actual: Column | str, warn: float, good: float) -> Column:
    return F.when(col(actual) >= good, F.lit("pass")).when(col(actual) >= warn, F.lit("warn")).otherwise(F.lit("fail"))


def roll_up(checks: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The worst status of each section."""
    rank = F.array_position(F.array(*map(F.lit, ("pass", "warn", "fail"))), F.col(status))
    return checks.groupBy(key).agg(F.max_by(status, rank).alias(status), F.count("*").alias("checks"), F.count_if(F.col(status) == "fail").alias("failed"))


def job_state(runs: DataFrame, key: str, now: str, success_h: int = 20, running_h: int = 6, failure_h: int = 2) -> DataFrame:
    """Per job: last completed, running and failed run, and why it need not run: in_progress, recent_success, recent_failure, or null.

    runs: key, status and at. A run that failed, was skipped or was cancelled is a failure.
    """
    last = lambda *s: F.max(F.when(F.col("status").isin(*s), F.col("at")))
    out = runs.groupBy(key).agg(last("completed").alias("last_success"), last("running").alias("last_running"), last("failed", "skipped", "cancelled").alias("last_failure"))
    recent = lambda c, hours: F.col(c) >= F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    return out.withColumn("skip_reason", F.when(recent("last_running", running_h), F.lit("in_progress")).when(recent("last_success", success_h), F.lit("recent_success")).when(recent("last_failure", failure_h), F.lit("recent_failure")))


def health(queues: DataFrame, workers: DataFrame, stalled: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row, status: degraded, attention or ok. queues, workers and jobs have a status; stalled has a row for each run that hangs.

    A degraded queue, a stale worker or a hanging run degrade the whole; a queue with a backlog, or a job that is due or cools down, ask for attention.
    """
    count = lambda df, *states: df.agg(F.count_if(F.col("status").isin(*states)).alias("n"))
    parts = {"degraded": count(queues, "degraded"), "stale": count(workers, "stale"), "stalled": stalled.agg(F.count("*").alias("n")), "backlogged": count(queues, "backlogged"), "waiting": count(jobs, "cooldown", "due")}
    row = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("name"), "n")
        row = one if row is None else row.unionAll(one)
    row = row.agg(*(F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in parts))
    return row.withColumn("status", F.when((F.col("degraded") > 0) | (F.col("stale") > 0) | (F.col("stalled") > 0), F.lit("degraded")).when((F.col("backlogged") > 0) | (F.col("waiting") > 0), F.lit("attention")).otherwise(F.lit("ok")))


def freshness(beats: DataFrame, queues: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """Every queue with its last heartbeat, whether it is fresh."""
    last = beats.groupBy("queue").agg(F.max("at").alias("last_beat"))
    return queues.select("queue").distinct().join(last, "queue", "left").withColumn("fresh", F.coalesce(F.col("last_beat") >= F.lit(now).cast("timestamp") - F.expr(f"interval {seconds} seconds"), F.lit(False)))


def counters(previous: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """previous with the counters that new has, none below 0, whole numbers."""
    both = previous.join(new.select(key, *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return both.withColumns({c: F.greatest(F.lit(0), F.coalesce(F.col(f"_{c}").cast("long"), F.col(c).cast("long"), F.lit(0))) for c in names}).drop(*(f"_{c}" for c in names))


def share(part: Column, whole: Column) -> Column:
    return clamp(ratio(part, whole), 0.0, 1.0)


def run_totals(runs: DataFrame, key: str, sums: list[str], distinct: str) -> DataFrame:
    """Per key: runs, the sums of counters, and how many different values a column has."""
    return runs.groupBy(key).agg(F.count("*").alias("runs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.countDistinct(distinct).alias("kinds"))
