"""Queries over the canonical tables, each with the DuckDB SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dates, maths, text
from quarry.operators import coverage, desk, evidence, legal, pricing, relational
from quarry.plans import bindings as b

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name; sql follows the canonical tables."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = f"WITH {b.SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {b.SQL} {sql}"
        return function

    return add


MONEY = "decimal(18,2)"
# Fixed values of these queries: fields of an asset by line number, the four core ones first.
FIELDS = ("cnj_number", "debtor_name", "court_alias", "face_value", "nature", "exercise_year", "lifecycle_status")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest_by(b.valuations(spark, d), ["asset_id"], b.newest())


def _money(c, name: str):
    return F.coalesce(c, F.lit(0)).cast(MONEY).alias(name)


@query("""
SELECT tenant_id, count(*) AS assets, count(*) FILTER (lifecycle_status = 'paid') AS paid, count(*) FILTER (nature = 'alimentar') AS alimentar,
  coalesce(sum(face_value), 0)::DECIMAL(18,2) AS face_value, coalesce(sum(updated_value), 0)::DECIMAL(18,2) AS updated_value
FROM assets LEFT JOIN latest USING (asset_id) GROUP BY tenant_id""")
def dashboard_asset_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", "tenant_id", "lifecycle_status", "nature").join(_latest(spark, d).select("asset_id", "face_value", "updated_value"), "asset_id", "left")
    return rows.groupBy("tenant_id").agg(F.count("*").alias("assets"), F.count_if(F.col("lifecycle_status") == "paid").alias("paid"), F.count_if(F.col("nature") == "alimentar").alias("alimentar"), _money(F.sum("face_value"), "face_value"), _money(F.sum("updated_value"), "updated_value"))


@query("""
SELECT d.debtor_id, d.tenant_id, count(a.asset_id) AS assets, coalesce(sum(l.face_value), 0)::DECIMAL(18,2) AS face_value, avg(a.total::DOUBLE) AS avg_total
FROM debtors d LEFT JOIN assets a USING (debtor_id) LEFT JOIN latest l USING (asset_id) GROUP BY ALL""")
def debtor_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", "debtor_id", "total").join(_latest(spark, d).select("asset_id", "face_value"), "asset_id", "left")
    sums = rows.groupBy("debtor_id").agg(F.count("*").alias("assets"), F.sum("face_value").alias("face_value"), F.avg(F.col("total").cast("double")).alias("avg_total"))
    return b.debtors(spark, d).select("debtor_id", "tenant_id").join(sums, "debtor_id", "left").select("debtor_id", "tenant_id", F.coalesce("assets", F.lit(0)).alias("assets"), _money(F.col("face_value"), "face_value"), "avg_total")


@query("""
SELECT tenant_id, exercise_year, count(*) AS assets, coalesce(sum(face_value), 0)::DECIMAL(18,2) AS face_value, min(created_at) AS first_created
FROM assets LEFT JOIN latest USING (asset_id) GROUP BY ALL""")
def asset_yearly_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", "tenant_id", "exercise_year", "created_at").join(_latest(spark, d).select("asset_id", "face_value"), "asset_id", "left")
    return rows.groupBy("tenant_id", "exercise_year").agg(F.count("*").alias("assets"), _money(F.sum("face_value"), "face_value"), F.min("created_at").alias("first_created"))


@query("""
SELECT asset_id, debtor_name, nature, updated_value FROM assets LEFT JOIN latest USING (asset_id)
WHERE tenant_id = 1 AND lifecycle_status IN ('paid', 'in_payment') AND nature <> 'unknown' AND contains(lower(coalesce(debtor_name, '')), '9')
  AND updated_value >= 20000 AND exercise_year BETWEEN 1994 AND 1997
ORDER BY updated_value DESC NULLS LAST, asset_id LIMIT 50""")
def asset_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    a = relational.live(b.assets(spark, d), 1).where(F.col("lifecycle_status").isin("paid", "in_payment") & (F.col("nature") != "unknown") & F.col("exercise_year").between(1994, 1997) & relational.contains_any("9", "debtor_name"))
    chosen = a.select("asset_id", "debtor_name", "nature")
    latest = relational.latest_by(b.valuations(spark, d).join(chosen.select("asset_id"), "asset_id", "left_semi"), ["asset_id"], b.newest())
    rows = chosen.join(latest.select("asset_id", "updated_value"), "asset_id", "left").where(relational.in_range("updated_value", 20000, 0))
    return relational.page(rows, [F.desc_nulls_last("updated_value"), F.asc("asset_id")], 1, 50)


@query("SELECT debtor_id, name, debtor_type, reliability FROM debtors WHERE debtor_type = 'state' AND payment_regime = 'special' AND reliability >= 50 ORDER BY reliability DESC, debtor_id LIMIT 25 OFFSET 25")
def debtor_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = b.debtors(spark, d).where("debtor_type = 'state' and payment_regime = 'special' and reliability >= 50").select("debtor_id", "name", "debtor_type", "reliability")
    return relational.page(rows, [F.desc("reliability"), F.asc("debtor_id")], 2, 25)


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 25.0))::BIGINT AS last_page FROM debtors WHERE payment_regime = 'special'")
def debtor_page_info(spark: SparkSession, d: str) -> DataFrame:
    return relational.page_info(b.debtors(spark, d).where("payment_regime = 'special'"))


@query("SELECT source_id, count(*) AS records, max(seen_at) AS last_seen, count(DISTINCT asset_id) FILTER (role = 'conflict') AS conflict_assets FROM links GROUP BY source_id")
def records_by_source(spark: SparkSession, d: str) -> DataFrame:
    return b.links(spark, d).groupBy("source_id").agg(F.count("*").alias("records"), F.max("seen_at").alias("last_seen"), F.countDistinct(F.when(F.col("role") == "conflict", F.col("asset_id"))).alias("conflict_assets"))


@query("SELECT lifecycle_status AS status, count(*) AS n FROM assets GROUP BY ALL")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return b.assets(spark, d).groupBy(F.col("lifecycle_status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS job, max(event_at) AS last_run, count(*) AS runs FROM asset_events GROUP BY ALL")
def latest_run_by_job(spark: SparkSession, d: str) -> DataFrame:
    return b.events(spark, d).groupBy(F.col("event_type").alias("job")).agg(F.max("event_at").alias("last_run"), F.count("*").alias("runs"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    links, events = b.links(spark, d), b.events(spark, d)
    by_role = links.groupBy("asset_id").agg(F.bool_or(F.col("role") == "primary").alias("has_primary_source"), F.bool_or(F.col("role") == "enrichment").alias("has_cross_check"), F.countDistinct(F.when(F.col("role") == "conflict", F.col("source_id"))).alias("n_conflicts"))
    by_event = events.groupBy("asset_id").agg(F.bool_or(F.col("event_type") == "view").alias("has_process"), F.bool_or(F.col("event_type") == "click").alias("has_publication"), F.bool_or(F.col("event_type") == "purchase").alias("has_score"))
    # A line item is the evidence of a field, in conflict if it was returned, and a candidate that waits if its discount is the highest.
    item = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.get(F.array(*map(F.lit, FIELDS)), F.pmod(F.col("l_linenumber") - 1, F.lit(len(FIELDS))).cast("int")).alias("field"), (F.col("l_returnflag") == "R").alias("conflict"), (F.col("l_discount") >= 0.1).alias("waits"))
    by_field = item.groupBy("asset_id").agg(F.count("*").alias("evidence"), F.countDistinct(F.when(~F.col("conflict") & F.col("field").isin(*coverage.CORE_FIELDS), F.col("field"))).alias("resolved_fields"), F.count_if("conflict").alias("n_field_conflicts"), F.count_if("waits").alias("pending_candidates"))
    rows = b.assets(spark, d).select("asset_id", "court", "cnj_number", "debtor_id").join(_latest(spark, d).select("asset_id", "updated_value"), "asset_id", "left").join(by_role, "asset_id", "left").join(by_event, "asset_id", "left").join(by_field, "asset_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_primary_source", "has_cross_check", "has_process", "has_publication", "has_score")}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_conflicts", "evidence", "resolved_fields", "n_field_conflicts", "pending_candidates")}
    return rows.withColumns(flags | counts | {"face_value": F.col("updated_value"), "has_cnj": F.col("cnj_number").isNotNull(), "has_debtor": F.col("debtor_id").isNotNull(), "has_value": F.coalesce(F.col("updated_value") > 0, F.lit(False))})


_FLAGS_SQL = """, by_role AS (
  SELECT asset_id, bool_or(role = 'primary') AS has_primary_source, bool_or(role = 'enrichment') AS has_cross_check, count(DISTINCT source_id) FILTER (role = 'conflict') AS n_conflicts FROM links GROUP BY asset_id),
by_field AS (
  SELECT l_orderkey AS asset_id, count(*) AS evidence, count(DISTINCT (l_linenumber - 1) % 7) FILTER (l_returnflag <> 'R' AND (l_linenumber - 1) % 7 < 4) AS resolved_fields, count(*) FILTER (l_returnflag = 'R') AS n_field_conflicts, count(*) FILTER (l_discount >= 0.1) AS pending_candidates
  FROM lineitem GROUP BY l_orderkey),
by_event AS (
  SELECT asset_id, bool_or(event_type = 'view') AS has_process, bool_or(event_type = 'click') AS has_publication, bool_or(event_type = 'purchase') AS has_score FROM asset_events GROUP BY asset_id),
flags AS (
  SELECT asset_id, court, cnj_number IS NOT NULL AS has_cnj, debtor_id IS NOT NULL AS has_debtor, coalesce(updated_value > 0, false) AS has_value,
    coalesce(has_primary_source, false) AS has_primary_source, coalesce(has_cross_check, false) AS has_cross_check, coalesce(has_process, false) AS has_process,
    coalesce(has_publication, false) AS has_publication, coalesce(has_score, false) AS has_score, coalesce(n_conflicts, 0) AS n_conflicts, updated_value AS face_value,
    coalesce(evidence, 0) AS evidence, coalesce(resolved_fields, 0) AS resolved_fields, coalesce(n_field_conflicts, 0) AS n_field_conflicts, coalesce(pending_candidates, 0) AS pending_candidates
  FROM assets LEFT JOIN latest USING (asset_id) LEFT JOIN by_field USING (asset_id) LEFT JOIN by_role USING (asset_id) LEFT JOIN by_event USING (asset_id))
"""


_QUALITY_SQL = _FLAGS_SQL + """, q AS (
  SELECT *, coalesce(face_value, 0) <= 0 OR NOT has_value AS i1, NOT has_process AS i2, NOT has_publication AS i3, resolved_fields < 4 AS i4, n_conflicts > 0 OR n_field_conflicts > 0 AS i5, pending_candidates > 0 AS i6 FROM flags),
quality AS (SELECT *, CASE WHEN i5 OR i6 THEN 'blocked' WHEN i1 OR i2 OR i3 OR i4 THEN 'review' ELSE 'complete' END AS status FROM q)
"""


@query(_QUALITY_SQL + """
SELECT asset_id, nullif(concat_ws(',', CASE WHEN i1 THEN 'missing_value' END, CASE WHEN i2 THEN 'missing_datajud' END, CASE WHEN i3 THEN 'missing_djen' END, CASE WHEN i4 THEN 'missing_field_evidence' END, CASE WHEN i5 THEN 'conflicts' END, CASE WHEN i6 THEN 'candidate_review' END), '') AS issues, status
FROM quality""")
def asset_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).withColumn("q", pricing.data_quality()).select("asset_id", F.when(F.size("q.issues") > 0, F.array_join("q.issues", ",")).alias("issues"), "q.status")


# A court with few assets has fewer gaps: courts are told apart further by the year of the process.
_COHERENCE_SQL = _FLAGS_SQL + """, marked AS (
  SELECT *, court || '-' || substr(cnj_number, 12, 4) AS place, has_primary_source AND has_process AND has_publication AND has_value AND has_score AND resolved_fields >= 4 AND n_conflicts = 0 AND n_field_conflicts = 0 AND pending_candidates = 0 AS is_complete
  FROM flags JOIN (SELECT asset_id, cnj_number FROM assets) USING (asset_id)),
per_court AS (
  SELECT place AS court, count(*) AS assets, count(*) FILTER (is_complete) AS complete, count(*) FILTER (has_primary_source) AS c1, count(*) FILTER (has_process) AS c2, count(*) FILTER (has_publication) AS c3, count(*) FILTER (has_value) AS c4, count(*) FILTER (has_score) AS c5,
    count(*) FILTER (evidence > 0) AS c6, count(*) FILTER (resolved_fields >= 4) AS c7, count(*) FILTER (n_conflicts > 0) AS conflicts, count(*) FILTER (n_field_conflicts > 0) AS field_conflicts, count(*) FILTER (pending_candidates > 0) AS pending
  FROM marked GROUP BY place UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
"""


@query(_COHERENCE_SQL + """
SELECT court, assets, complete, c1 AS has_primary_source, c2 AS has_process, c3 AS has_publication, c4 AS has_value, c5 AS has_score, c6 AS has_evidence, c7 AS has_resolved, conflicts, field_conflicts, pending,
  CASE WHEN assets = 0 THEN 'no_assets' ELSE concat_ws(',', CASE WHEN c1 < assets THEN 'missing_primary_source' END, CASE WHEN c2 < assets THEN 'missing_datajud_process' END, CASE WHEN c3 < assets THEN 'missing_djen_publication' END, CASE WHEN c4 < assets THEN 'missing_valuation' END,
    CASE WHEN c5 < assets THEN 'missing_score' END, CASE WHEN c7 < assets THEN 'missing_field_evidence' END, CASE WHEN conflicts > 0 THEN 'source_conflicts' END, CASE WHEN field_conflicts > 0 THEN 'field_evidence_conflicts' END, CASE WHEN pending > 0 THEN 'pending_candidate_review' END) END AS gaps,
  CASE WHEN assets = 0 THEN 'partial' WHEN c1 < assets OR conflicts > 0 OR field_conflicts > 0 THEN 'critical' WHEN complete >= 0.95 * assets THEN 'complete' WHEN c1 > 0 AND c2 > 0 AND c5 > 0 THEN 'usable' ELSE 'partial' END AS status
FROM per_court""")
def coherence_by_court(spark: SparkSession, d: str) -> DataFrame:
    counts = ("has_primary_source", "has_process", "has_publication", "has_value", "has_score", "has_evidence", "has_resolved", "conflicts", "field_conflicts", "pending")
    return _coherence(spark, d).select("court", "assets", "complete", *counts, F.array_join(F.transform("gaps", lambda g: g["code"]), ",").alias("gaps"), "status")


def _coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = _flags(spark, d).withColumn("court", F.concat_ws("-", "court", F.substring("cnj_number", 12, 4)))
    return coverage.coherence(rows, every=spark.createDataFrame([("none",)], "court string"))


@query(_COHERENCE_SQL + """, gaps AS (
  SELECT court, 'missing_primary_source' AS code, 'high' AS severity, assets - c1 AS missing FROM per_court UNION ALL SELECT court, 'missing_datajud_process', 'medium', assets - c2 FROM per_court
  UNION ALL SELECT court, 'missing_djen_publication', 'medium', assets - c3 FROM per_court UNION ALL SELECT court, 'missing_valuation', 'medium', assets - c4 FROM per_court UNION ALL SELECT court, 'missing_score', 'medium', assets - c5 FROM per_court
  UNION ALL SELECT court, 'missing_field_evidence', 'medium', assets - c7 FROM per_court UNION ALL SELECT court, 'source_conflicts', 'high', conflicts FROM per_court UNION ALL SELECT court, 'field_evidence_conflicts', 'high', field_conflicts FROM per_court
  UNION ALL SELECT court, 'pending_candidate_review', 'medium', pending FROM per_court)
SELECT code, sum(missing)::BIGINT AS missing, count(*) AS courts, any_value(severity) AS severity FROM gaps WHERE missing > 0 GROUP BY code
UNION ALL SELECT 'no_assets', 0, count(*), 'medium' FROM per_court WHERE assets = 0""")
def gap_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return coverage.gap_roll_up(_coherence(spark, d)).select("code", "missing", "courts", "severity")


@query("SELECT asset_id, lifecycle_status FROM assets WHERE NOT EXISTS (SELECT 1 FROM asset_events e WHERE e.asset_id = assets.asset_id)")
def assets_without_events(spark: SparkSession, d: str) -> DataFrame:
    return b.assets(spark, d).select("asset_id", "lifecycle_status").join(b.events(spark, d).select("asset_id"), "asset_id", "left_anti")


@query("""
SELECT asset_id, CASE WHEN court IN ('brazil', 'france') THEN 300 WHEN payment_regime = 'special' THEN 200 ELSE 100 END AS court_priority FROM assets a
WHERE (NOT EXISTS (SELECT 1 FROM asset_events e WHERE e.asset_id = a.asset_id AND e.event_type = 'view') OR NOT EXISTS (SELECT 1 FROM links l WHERE l.asset_id = a.asset_id AND role = 'primary'))
  AND NOT EXISTS (SELECT 1 FROM asset_events e WHERE e.asset_id = a.asset_id AND e.event_type = 'error' AND e.event_at >= TIMESTAMP '2024-01-20')
  AND lifecycle_status <> 'paid'
ORDER BY court_priority DESC, asset_id LIMIT 250""")
def reconcile_candidates(spark: SparkSession, d: str) -> DataFrame:
    events, links = b.events(spark, d), b.links(spark, d)
    a = b.assets(spark, d).where("lifecycle_status <> 'paid'").select("asset_id", "court", "payment_regime")
    a = relational.with_flag(relational.with_flag(a, events.where("event_type = 'view'"), ["asset_id"], "seen"), links.where("role = 'primary'"), ["asset_id"], "sourced").where("not seen or not sourced")
    a = a.join(events.where("event_type = 'error' and event_at >= timestamp '2024-01-20'").select("asset_id"), "asset_id", "left_anti")
    rank = F.when(F.col("court").isin("brazil", "france"), 300).when(F.col("payment_regime") == "special", 200).otherwise(100)
    return a.select("asset_id", rank.alias("court_priority")).orderBy(F.desc("court_priority"), "asset_id").limit(250)


@query("""
, matches AS (SELECT o_custkey * 100 + year(o_orderdate) % 100 AS k, count(*) AS n, min(o_orderkey) AS one FROM orders GROUP BY ALL)
SELECT p.l_orderkey AS record_id, p.l_linenumber AS line, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN one END AS linked_id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'conflict' ELSE 'unmatched' END AS link_status
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey * 100 + year(l_shipdate) % 100 AS k FROM lineitem) p LEFT JOIN matches USING (k)""")
def exact_link_arity(spark: SparkSession, d: str) -> DataFrame:
    left = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 100 + F.year("l_shipdate") % 100).alias("k")).distinct()
    right = b.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 100 + F.year("o_orderdate") % 100).alias("k"))
    return relational.link_by_arity(left, right, "k", "o_orderkey").select("record_id", "line", "matches", "linked_id", "link_status")


# Typed from the rules, not from the library: multiplier, weight and sign of each signal.
_SIGNAL_VALUES = """('direct_agreement_opened', 1.6, 18, 1), ('direct_agreement_window', 1.45, 16, 1), ('superpreference_granted', 1.4, 16, 1), ('preferential_queue', 1.25, 14, 1), ('payment_available', 1.9, 22, 1),
  ('payment_process_detected', 1.35, 18, 1), ('queue_position_favorable', 1.18, 10, 1), ('final_judgment', 1.12, 10, 1), ('calculation_homologated', 1.1, 9, 1), ('requisition_issued', 1.08, 8, 1),
  ('prior_cession_detected', 0.0, 100, -1), ('lien_detected', 0.6, 28, -1), ('suspension_detected', 0.3, 42, -1), ('objection_pending', 0.55, 28, -1), ('beneficiary_inventory_pending', 0.45, 36, -1),
  ('fee_dispute_detected', 0.7, 18, -1), ('special_regime_declared', 0.7, 22, -1), ('queue_position_unknown', 0.95, 6, -1)"""
_SIGNALS_SQL = f""", signal(code, multiplier, weight, sign) AS (VALUES {_SIGNAL_VALUES}),
all_signals AS (SELECT asset_id, code FROM asset_events UNION ALL SELECT asset_id, CASE lifecycle_status WHEN 'in_payment' THEN 'payment_available' WHEN 'suspended' THEN 'suspension_detected' END FROM assets),
by_asset AS (
  SELECT asset_id, product(multiplier) AS multiplier, sum(CASE WHEN sign > 0 THEN weight ELSE 0 END)::BIGINT AS positive_weight, sum(CASE WHEN sign < 0 THEN weight ELSE 0 END)::BIGINT AS negative_weight,
    count(*) FILTER (sign > 0) AS positive_signals, count(*) FILTER (sign < 0) AS negative_signals, list_sort(list(DISTINCT code)) AS codes
  FROM all_signals JOIN signal USING (code) GROUP BY asset_id)
"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return pricing.signals_by_asset(b.events(spark, d).select("asset_id", "code").unionAll(pricing.lifecycle_signals(b.assets(spark, d))))


@query(_SIGNALS_SQL + "SELECT asset_id, round(multiplier, 9) AS multiplier, positive_weight, negative_weight, array_to_string(codes, ',') AS codes FROM by_asset")
def payment_probability_product(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("asset_id", F.round("multiplier", 9).alias("multiplier"), "positive_weight", "negative_weight", F.array_join("codes", ",").alias("codes"))


@query(f""", signal(code, multiplier, weight, sign) AS (VALUES {_SIGNAL_VALUES}),
by_events AS (
  SELECT asset_id, sum(CASE WHEN sign > 0 THEN weight ELSE 0 END)::BIGINT AS p, sum(CASE WHEN sign < 0 THEN weight ELSE 0 END)::BIGINT AS n, list(DISTINCT code) AS codes FROM asset_events JOIN signal USING (code) GROUP BY asset_id),
s AS (
  SELECT asset_id, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(codes, []) AS codes, coalesce(updated_value, 0) AS v, cnj_number, debtor_id
  FROM assets LEFT JOIN latest USING (asset_id) LEFT JOIN by_events USING (asset_id)),
t AS (
  SELECT *, 30 * ((cnj_number IS NOT NULL)::INT + (debtor_id IS NOT NULL)::INT + (v > 0)::INT) AS quality,
    least(greatest(40 + 20 * list_contains(codes, 'requisition_issued')::INT + 15 * list_contains(codes, 'final_judgment')::INT + 15 * list_contains(codes, 'calculation_homologated')::INT, 0), 100) AS maturity,
    least(greatest(45 + 35 * list_contains(codes, 'payment_available')::INT + 25 * list_contains(codes, 'payment_process_detected')::INT + 25 * list_contains(codes, 'direct_agreement_opened')::INT + 22 * list_contains(codes, 'direct_agreement_window')::INT
      + 20 * list_contains(codes, 'preferential_queue')::INT + 20 * list_contains(codes, 'superpreference_granted')::INT - n / 2.0, 0), 100) AS liquidity,
    CASE WHEN list_contains(codes, 'prior_cession_detected') THEN 0 ELSE least(greatest(50 + p - n, 0), 100) END AS legal, CASE WHEN v >= 50000 THEN 70 ELSE 45 END AS economic FROM s),
u AS (SELECT *, least(greatest(100 - legal + n / 2.0, 0), 100) AS risk FROM t)
SELECT asset_id, quality::INT AS quality_score, maturity::INT AS maturity_score, legal::INT AS legal_score, liquidity::DOUBLE AS liquidity_score, risk::DOUBLE AS risk_score, economic::INT AS economic_score,
  least(greatest(floor((2 * quality + 2 * maturity + 2 * liquidity + 3 * legal + economic - risk)::DECIMAL(18,3) / 10 + 0.5), 0), 100)::INT AS signal_score FROM u""")
def event_signal_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores by events alone: the state of an asset is no event."""
    a = b.assets(spark, d).select("asset_id", "cnj_number", "debtor_id").join(_latest(spark, d).select("asset_id", F.col("updated_value").alias("face_value")), "asset_id", "left")
    scored = pricing.signal_scores(a.join(pricing.signals_by_asset(b.events(spark, d).select("asset_id", "code")), "asset_id", "left"))
    return scored.select("asset_id", *(F.col(c).cast("int").alias(c) for c in ("quality_score", "maturity_score", "legal_score", "economic_score")), *(F.col(c).cast("double").alias(c) for c in ("liquidity_score", "risk_score")), "signal_score")


def _priced(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Priced assets, or of (asset_id, few enough to be broadcast) only those: the limit comes before the joins."""
    some = (lambda df: df) if of is None else (lambda df: df.join(F.broadcast(of), "asset_id", "left_semi"))
    latest = relational.latest_by(some(b.valuations(spark, d)), ["asset_id"], b.newest())
    own = some(b.assets(spark, d))
    signals = pricing.signals_by_asset(some(b.events(spark, d).select("asset_id", "code")).unionAll(pricing.lifecycle_signals(own)))
    a = own.drop("total", "cnj_number", "created_at").join(latest.select("asset_id", F.col("updated_value").alias("face_value"), "queue_position"), "asset_id", "left").join(signals, "asset_id", "left")
    unknown = {"on_time_rate": F.lit(None).cast("double"), "average_months": F.lit(None).cast("int"), "regime_special": F.lit(None).cast("boolean"), "recent_default": F.lit(None).cast("boolean")}
    return pricing.price(a.withColumns(unknown))


_PRICE_SQL = _SIGNALS_SQL + """, p0 AS (
  SELECT asset_id, tenant_id, court, coalesce(updated_value, 0)::DOUBLE AS face_value, nature, debtor_type, payment_regime, lifecycle_status, queue_position, reliability, coalesce(multiplier, 1.0)::DOUBLE AS multiplier, coalesce(codes, []) AS codes,
    coalesce(positive_signals, 0) AS positive_signals, coalesce(negative_signals, 0) AS negative_signals
  FROM assets LEFT JOIN latest USING (asset_id) LEFT JOIN by_asset USING (asset_id)),
p1 AS (
  SELECT *, CASE WHEN list_has_any(codes, ['payment_available', 'payment_process_detected']) THEN 12 WHEN list_contains(codes, 'superpreference_granted') THEN 10 WHEN list_contains(codes, 'preferential_queue') THEN 12
      WHEN list_contains(codes, 'direct_agreement_window') THEN 18 WHEN queue_position <= 25 THEN 12 WHEN queue_position <= 100 THEN 18 WHEN lifecycle_status IN ('in_payment', 'paid') THEN 12 WHEN payment_regime = 'special' THEN 72
      WHEN debtor_type IN ('union', 'autarchy', 'foundation') THEN 24 WHEN debtor_type = 'state' THEN 42 WHEN debtor_type = 'municipality' THEN 60 ELSE 36 END AS term_months,
    CASE WHEN nature = 'alimentar' THEN 0.72 WHEN debtor_type IN ('union', 'autarchy', 'foundation') THEN 0.78 WHEN debtor_type = 'state' THEN 0.6 WHEN debtor_type = 'municipality' THEN 0.35 ELSE 0.65 END::DOUBLE AS offer_rate FROM p0),
p2 AS (SELECT *, face_value * offer_rate AS cost, face_value * pow(1 + 0.12::DOUBLE, term_months / 12.0::DOUBLE) AS pay FROM p1),
p3 AS (SELECT *, pay - face_value * 0.015::DOUBLE - greatest(pay - cost, 0) * 0.15::DOUBLE AS net FROM p2),
p4 AS (
  SELECT *, CASE WHEN cost > 0 THEN least(greatest(pow(net / cost, 12.0::DOUBLE / term_months) - 1, -1), 2) ELSE 0 END AS irr,
    least(greatest(reliability / 100.0::DOUBLE * CASE WHEN payment_regime = 'special' THEN 0.7::DOUBLE ELSE 1 END * multiplier, 0), 1) AS probability FROM p3),
p5 AS (SELECT *, least(greatest(irr * probability, -1), 2) AS risk_irr FROM p4),
priced AS (
  SELECT *, 0.4::DOUBLE * least(greatest((risk_irr - 0.05::DOUBLE) / (0.6::DOUBLE - 0.05::DOUBLE), 0), 1) + 0.25::DOUBLE * probability + 0.2::DOUBLE * (1 - least(greatest((term_months - 1) / 59.0::DOUBLE, 0), 1))
    + 0.15::DOUBLE * least(greatest((face_value - 50000) / 4950000.0::DOUBLE, 0), 1) AS final_score FROM p5),
graded AS (
  SELECT *, CASE WHEN final_score >= 0.85 THEN 'A+' WHEN final_score >= 0.7 THEN 'A' WHEN final_score >= 0.55 THEN 'B+' WHEN final_score >= 0.4 THEN 'B' WHEN final_score >= 0.25 THEN 'C' ELSE 'D' END AS grade FROM priced)
"""


@query(_PRICE_SQL + "SELECT asset_id, term_months::INT AS term_months, offer_rate, round(net, 2) AS net_proceeds, round(irr, 6) AS expected_irr, round(probability, 6) AS payment_probability, round(final_score, 6) AS final_score, grade FROM graded")
def opportunity_pricing(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n, name: F.round(c, n).alias(name)
    return _priced(spark, d).select("asset_id", "term_months", "offer_rate", r("net_proceeds", 2, "net_proceeds"), r("expected_irr", 6, "expected_irr"), r("payment_probability", 6, "payment_probability"), r("final_score", 6, "final_score"), "grade")


@query(_PRICE_SQL + "SELECT g.grade, count(asset_id) AS n FROM (VALUES ('A+'), ('A'), ('B+'), ('B'), ('C'), ('D')) g(grade) LEFT JOIN graded USING (grade) GROUP BY ALL")
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    grades = spark.createDataFrame([(row[1],) for row in pricing.GRADES], "grade string")
    return F.broadcast(grades).join(_priced(spark, d).groupBy("grade").agg(F.count("*").alias("n")), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


@query(_PRICE_SQL + """, staged AS (SELECT *, ['inbox', 'screening', 'pricing', 'offer', 'diligence', 'closing', 'won', 'lost'][(asset_id % 8 + 1)::INT] AS stage FROM graded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY round(final_score, 6) DESC, asset_id) AS rn FROM staged)
SELECT stage, count(*) AS n, round(sum(face_value::DECIMAL(18,2)), 2)::DECIMAL(18,2) AS face_value, round(avg(final_score), 6) AS avg_score, min(asset_id) FILTER (rn = 1) AS best, count(*) FILTER (rn <= 50) AS shown FROM ranked GROUP BY stage""")
def pipeline_board(spark: SparkSession, d: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("inbox", "screening", "pricing", "offer", "diligence", "closing", "won", "lost")))
    rows = _priced(spark, d).select("asset_id", "face_value", "final_score", F.get(stages, F.pmod("asset_id", F.lit(8)).cast("int")).alias("stage"))
    sums = rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("face_value").cast(MONEY)).cast(MONEY).alias("face_value"), F.round(F.avg("final_score"), 6).alias("avg_score"))
    top = relational.top_by(rows.withColumn("s", F.round("final_score", 6)), ["stage"], [F.desc("s"), F.asc("asset_id")], 50)
    cards = top.groupBy("stage").agg(F.max_by("asset_id", F.struct("s", -F.col("asset_id"))).alias("best"), F.count("*").alias("shown"))
    return sums.join(cards, "stage")


@query(_PRICE_SQL + """, newest AS (SELECT asset_id FROM assets ORDER BY created_at DESC, asset_id LIMIT 1000)
SELECT asset_id, grade, round(final_score, 6) AS final_score FROM graded JOIN newest USING (asset_id) WHERE grade IN ('A+', 'A', 'B+') AND probability >= 0.5""")
def opportunity_list(spark: SparkSession, d: str) -> DataFrame:
    """The limit comes before the filter: the newest 1,000 assets are priced, then filtered."""
    newest = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), "o_orderdate").orderBy(F.desc("o_orderdate"), "asset_id").limit(1000).select("asset_id")
    return _priced(spark, d, newest).where(F.col("grade").isin("A+", "A", "B+") & (F.col("payment_probability") >= 0.5)).select("asset_id", "grade", F.round("final_score", 6).alias("final_score"))


@query(_PRICE_SQL + """, checks AS (
  SELECT *, list_contains(codes, 'prior_cession_detected')::INT + list_contains(codes, 'suspension_detected')::INT + list_contains(codes, 'beneficiary_inventory_pending')::INT AS n_blocked,
    list_contains(codes, 'lien_detected')::INT + list_contains(codes, 'fee_dispute_detected')::INT + (NOT list_contains(codes, 'suspension_detected') AND (list_contains(codes, 'objection_pending') OR lifecycle_status = 'suspended'))::INT
      + (NOT list_has_any(codes, ['payment_available', 'direct_agreement_opened', 'superpreference_granted']))::INT AS n_review FROM graded),
adv AS (SELECT *, least(greatest(72 + 6 * positive_signals - 12 * negative_signals - 8 * n_review - 35 * n_blocked, 0), 100) AS r FROM checks),
states AS (SELECT *, CASE WHEN n_blocked > 0 OR r < 45 THEN 'blocked' WHEN r < 78 OR n_review > 0 THEN 'review' ELSE 'ready' END AS advice_state FROM adv),
fits AS (
  SELECT asset_id, r, advice_state, n_review, n_blocked, CASE WHEN advice_state = 'blocked' THEN 0 ELSE floor(least(greatest(r + 20 * final_score + CASE WHEN list_contains(codes, 'payment_available') THEN 8 ELSE 0 END, 0), 100) + 0.5) END AS f1,
    CASE WHEN advice_state = 'blocked' THEN 0 ELSE least(greatest(r + CASE WHEN list_contains(codes, 'direct_agreement_opened') THEN 24 ELSE -12 END + CASE WHEN list_contains(codes, 'superpreference_granted') THEN 8 ELSE 0 END, 0), 100) END AS f2,
    floor(least(greatest(55 + 30 * probability - term_months / 3.0::DOUBLE, 0), 100) + 0.5) AS f3, CASE WHEN advice_state = 'blocked' THEN 0 ELSE least(greatest(r - 12 + CASE WHEN probability > 0.75 THEN 10 ELSE -10 END, 0), 100) END AS f4 FROM states)
SELECT asset_id, r::BIGINT AS readiness, n_review::INT AS review_items, n_blocked::INT AS blocked_items, advice_state, concat_ws(',', f1::INT, f2::INT, f3::INT, f4::INT) AS fits,
  CASE WHEN greatest(f1, f2, f3, f4) < 55 THEN NULL WHEN f1 >= greatest(f2, f3, f4) THEN 'private_cession' WHEN f2 >= greatest(f3, f4) THEN 'direct_agreement' WHEN f3 >= f4 THEN 'hold_and_wait' ELSE 'bridge_loan' END AS recommended_channel FROM fits""")
def liquidity_advice(spark: SparkSession, d: str) -> DataFrame:
    """Readiness by the checklist of each asset, and the best of four ways out."""
    rows = _priced(spark, d).withColumns({"positive_signals": F.coalesce("positive_signals", F.lit(0)), "negative_signals": F.coalesce("negative_signals", F.lit(0)), "codes": F.coalesce("codes", F.array().cast("array<string>"))}).withColumn("_list", desk.checklist())
    rows = rows.withColumns({"review_items": F.size(F.filter("_list", lambda x: x["state"] == "review")), "blocked_items": F.size(F.filter("_list", lambda x: x["state"] == "blocked"))})
    return evidence.advise(rows).select("asset_id", F.col("readiness").cast("long").alias("readiness"), "review_items", "blocked_items", "advice_state", F.array_join(F.transform("channels", lambda x: x["fit"].cast("int").cast("string")), ",").alias("fits"), "recommended_channel")


@query("""
, s AS (SELECT asset_id, count(*) AS n, ((max(face_value) - min(face_value)) / min(face_value))::DOUBLE AS spread FROM valuations WHERE face_value > 0 GROUP BY asset_id)
SELECT asset_id, n, round(spread, 6) AS spread FROM s WHERE spread >= 0.05""")
def valuation_spread(spark: SparkSession, d: str) -> DataFrame:
    return evidence.relative_spread(b.valuations(spark, d), "asset_id", "face_value").select("asset_id", "n", F.round("spread", 6).alias("spread"))


@query("""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY computed_at DESC, l_linenumber DESC, face_value DESC, l_partkey, l_suppkey) AS rn FROM valuations)
SELECT asset_id, string_agg(face_value::VARCHAR, ',' ORDER BY rn) AS recent FROM ranked WHERE rn <= 3 GROUP BY asset_id""")
def recent_valuations(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.children(b.valuations(spark, d), ["asset_id"], b.latest_order(), 3, "recent", ["face_value"])
    return rows.select("asset_id", F.array_join(F.transform("recent", lambda x: x["face_value"].cast("string")), ",").alias("recent"))


@query("""
, keys AS (SELECT DISTINCT asset_id FROM links WHERE role = 'primary' UNION SELECT DISTINCT asset_id FROM asset_events WHERE event_type = 'click')
SELECT tenant_id, count(*) AS with_publication FROM assets WHERE asset_id IN (SELECT asset_id FROM keys) GROUP BY tenant_id""")
def assets_with_publication(spark: SparkSession, d: str) -> DataFrame:
    keys = relational.key_union(b.links(spark, d).where("role = 'primary'").select("asset_id"), b.events(spark, d).where("event_type = 'click'").select("asset_id"))
    return b.assets(spark, d).select("asset_id", "tenant_id").join(keys, "asset_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("with_publication"))


@query("""
SELECT asset_id, source_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, max_by(role, (seen_at, role, status)) AS role, max_by(status, (seen_at, role, status)) AS status FROM links GROUP BY ALL""")
def evidence_link_upsert(spark: SparkSession, d: str) -> DataFrame:
    return relational.merge_sightings(b.links(spark, d), ["asset_id", "source_id"], "seen_at", ["role", "status"])


@query("""
, daily AS (SELECT date_trunc('day', event_at)::DATE AS day, event_type AS series, avg(value) / 100000 AS rate FROM asset_events GROUP BY ALL)
SELECT series, max(day) AS as_of, round(product(1 + rate) - 1, 9) AS growth, round(pow(1 + arg_max(rate, day), 252) - 1, 9) AS annual FROM daily GROUP BY series""")
def rate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    daily = b.events(spark, d).groupBy(F.to_date("event_at").alias("day"), F.col("event_type").alias("series")).agg((F.avg("value") / 100000).alias("rate"))
    return daily.groupBy("series").agg(F.max("day").alias("as_of"), F.round(maths.compound("rate"), 9).alias("growth"), F.round(maths.annual_from_daily(F.max_by("rate", "day")), 9).alias("annual"))


@query("""
, runs AS (SELECT l_suppkey AS source_id, 1 AS rows, (l_quantity > 5)::INT AS valid, (l_quantity > 10 AND l_suppkey % 5 > 0)::INT AS relevant, (l_quantity > 20)::INT AS imported, (l_returnflag = 'R')::INT AS errors, (l_discount * 100)::INT AS f FROM lineitem),
s AS (SELECT source_id, sum(rows) AS rows, sum(valid) AS valid, sum(relevant) AS relevant, sum(imported) AS imported, sum(errors) AS errors, avg(f) / 10 AS fields FROM runs GROUP BY source_id),
q AS (
  SELECT source_id, round(valid::DOUBLE / coalesce(nullif(rows, 0), nullif(relevant, 0), nullif(valid, 0)), 4) AS vc, coalesce(nullif(relevant, 0), nullif(valid, 0), imported) AS basis, imported, errors, fields FROM s),
r AS (SELECT *, CASE WHEN basis > 0 THEN round(imported::DOUBLE / basis, 4) ELSE 0 END AS y, CASE WHEN basis + errors > 0 THEN round(errors::DOUBLE / (basis + errors), 4) ELSE 0 END AS e FROM q)
SELECT source_id, round(vc, 3) AS valid_coverage, round(y, 3) AS yield, round(0.4::DOUBLE * vc + 0.3::DOUBLE * y + 0.2::DOUBLE * fields + 0.1::DOUBLE * (1 - e), 2) AS quality_score FROM r""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.lit(1).alias("rows"), *(F.expr(e).cast("int").alias(c) for c, e in (("valid", "l_quantity > 5"), ("relevant", "l_quantity > 10 and l_suppkey % 5 > 0"), ("imported", "l_quantity > 20"))), (F.col("l_returnflag") == "R").cast("int").alias("errors"), (F.round(F.col("l_discount") * 100).cast("int") / 10).alias("field_coverage"))
    return coverage.source_quality(rows).select("source_id", F.round("valid_coverage", 3).alias("valid_coverage"), F.round("yield", 3).alias("yield"), F.round("quality_score", 2).alias("quality_score"))


@query("""
, c AS (SELECT asset_id, 'court' AS field, upper(role) AS value, CASE role WHEN 'primary' THEN 90 WHEN 'enrichment' THEN 72 ELSE 35 END AS w FROM links UNION ALL SELECT asset_id, 'court', 'PRIMARY', 95 FROM assets),
g AS (SELECT asset_id, field, value, sum(w) AS score, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT *, sum(score) OVER (PARTITION BY asset_id, field) AS total, count(*) OVER (PARTITION BY asset_id, field) AS k, row_number() OVER (PARTITION BY asset_id, field ORDER BY score DESC, n DESC, value) AS rn FROM g)
SELECT asset_id, value AS resolved_value, CASE WHEN k > 1 THEN 'conflict' ELSE 'resolved' END AS status, k AS distinct_values, n AS mentions FROM t WHERE rn = 1""")
def field_evidence(spark: SparkSession, d: str) -> DataFrame:
    from_links = b.links(spark, d).select("asset_id", F.lit("court").alias("field"), F.col("role").alias("value"), F.lit("link").alias("source"), "role")
    canonical = b.assets(spark, d).select("asset_id", F.lit("court").alias("field"), F.lit("primary").alias("value"), F.lit("canonical").alias("source"), F.lit(None).cast("string").alias("role"))
    return evidence.resolve_fields(evidence.weigh(from_links.unionAll(canonical))).select("asset_id", "resolved_value", "status", "distinct_values", "mentions")


@query("""
SELECT debtor_id, upper(trim(regexp_replace(strip_accents(name), '[^A-Za-z0-9]+', ' ', 'g'))) AS normalized, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(upper(name), '[^A-Z0-9]+', '_', 'g'), '_') AS code, sha256('{"court":' || to_json(court) || ',"name":' || to_json(name) || '}') AS fingerprint FROM debtors""")
def debtor_keys(spark: SparkSession, d: str) -> DataFrame:
    return b.debtors(spark, d).select("debtor_id", text.debtor_name("name").alias("normalized"), text.slug("name").alias("slug"), text.code_key("name").alias("code"), text.fingerprint(name=F.col("name"), court=F.col("court")).alias("fingerprint"))


@query("SELECT asset_id, cnj_number, 'trf' || substr(cnj_number, 20, 1) AS court_alias FROM assets WHERE substr(cnj_number, 20, 1) BETWEEN '1' AND '6'")
def process_number_courts(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", text.process_number(text.digits("cnj_number")).alias("cnj_number"))
    return rows.withColumn("court_alias", text.court_of_process("cnj_number")).where("court_alias is not null")


@query("""
SELECT page_id, n::BIGINT AS n_links, first_link FROM (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n, regexp_extract(html, '<a [^>]*href="([^"]*)"', 1) AS first_link FROM pages) WHERE n > 0""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources import files

    found = files.links(b.read(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min_by("href", "n").alias("first_link"))


@query("""
, days AS (SELECT range::DATE AS day FROM range(DATE '1991-12-01', DATE '1999-12-31', INTERVAL 1 DAY)),
e AS (SELECT DISTINCT year(day) AS y FROM days),
easter(y, day) AS (VALUES (1991, DATE '1991-03-31'), (1992, DATE '1992-04-19'), (1993, DATE '1993-04-11'), (1994, DATE '1994-04-03'), (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04')),
cal AS (
  SELECT days.day, isodow(days.day) < 6 AND strftime(days.day, '%m-%d') NOT IN ('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '11-20', '12-25') AND (days.day - easter.day) NOT IN (-48, -47, -2, 60) AS working
  FROM days JOIN easter ON easter.y = year(days.day)),
o AS (SELECT *, sum(working::INT) OVER (ORDER BY day) AS n FROM cal)
SELECT asset_id, a.created_at::DATE AS created_on, t.day AS answer_by FROM assets a JOIN o s ON s.day = a.created_at::DATE JOIN o t ON t.working AND t.n = s.n + 15""")
def answer_deadlines(spark: SparkSession, d: str) -> DataFrame:
    days = dates.calendar(spark, "1991-12-01", "1999-12-30")
    rows = b.assets(spark, d).select("asset_id", F.to_date("created_at").alias("created_on"))
    return dates.add_working_days(rows, "created_on", 15, days, "answer_by").where("answer_by is not null").select("asset_id", "created_on", "answer_by")


@query("""
, s AS (SELECT event_id, asset_id, event_type, event_at, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 15 MINUTE, event_at) ORDER BY event_at, event_id) AS rn FROM asset_events)
SELECT event_type || ':' || strftime(time_bucket(INTERVAL 15 MINUTE, event_at), '%Y%m%d%H%M') AS job_id, event_id FROM s WHERE rn = 1""")
def deduplicated_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = b.events(spark, d).select("event_id", "event_type", "event_at").withColumn("w", F.window("event_at", "15 minutes")).withColumn("job_id", F.concat_ws(":", "event_type", F.date_format("w.start", "yyyyMMddHHmm")))
    return relational.top_by(rows, ["job_id"], [F.asc("event_at"), F.asc("event_id")]).select("job_id", "event_id")


@query("""
SELECT court, count(*) AS assets, sum(count(*)) OVER (ORDER BY count(*) DESC, court)::BIGINT AS running FROM assets GROUP BY court""")
def courts_by_size(spark: SparkSession, d: str) -> DataFrame:
    """The running sum is over one row per court, of which there are 25."""
    counts = b.assets(spark, d).groupBy("court").agg(F.count("*").alias("assets"))
    return counts.withColumn("running", F.sum("assets").over(Window.orderBy(F.desc("assets"), "court")))


@query("""
SELECT 'events' AS subject, count(*) AS total_rows, count(*) FILTER (event_at < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY) AS expired_rows FROM asset_events
UNION ALL SELECT 'source', count(*), count(*) FILTER (seen_at < TIMESTAMP '2024-06-01' - INTERVAL 10000 DAY) FROM links""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return relational.retention_manifest({"events": (b.events(spark, d), "event_at"), "source": (b.links(spark, d), "seen_at"), "pii": (b.links(spark, d), "seen_at")}, {"events": 90, "source": 10_000}, "2024-06-01").drop("cutoff")
