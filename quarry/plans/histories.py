"""Queries over histories and protected data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import history, reveal
from quarry.plans import bindings as b
from quarry.plans.queries import query

_KEY = "quarry-test-key!"


@query("""
, t AS (SELECT (user_id % 5)::INT AS tenant_id, user_id AS opportunity_id, event_id AS transition_id, event_type AS to_stage, date_trunc('hour', ts) AS changed_at FROM events),
one AS (SELECT tenant_id, opportunity_id, changed_at, arg_max(to_stage, transition_id) AS stage FROM t GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lag(stage) OVER w IS NOT DISTINCT FROM stage THEN 0 ELSE 1 END AS fresh FROM one WINDOW w AS (PARTITION BY tenant_id, opportunity_id ORDER BY changed_at)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, opportunity_id ORDER BY changed_at) AS run FROM marked),
spans AS (SELECT tenant_id, opportunity_id, run, min(stage) AS stage, min(changed_at) AS valid_from, count(*) AS changes FROM runs GROUP BY ALL)
SELECT tenant_id, opportunity_id, stage, strftime(valid_from, '%Y-%m-%d %H') AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY tenant_id, opportunity_id ORDER BY run), '%Y-%m-%d %H') AS valid_to, changes FROM spans""")
def stage_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as transitions, dealt out as if they came late: intervals of each stage, repeats merged, the last change of an hour holds."""
    moves = b.read(spark, d, "events").select((F.col("user_id") % 5).cast("int").alias("tenant_id"), F.col("user_id").alias("opportunity_id"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("to_stage"), F.date_trunc("hour", "ts").alias("changed_at"))
    early = history.merged_transitions(moves.where("transition_id % 3 > 0"), moves.where("transition_id % 3 <> 1"))
    spans = history.stage_intervals(early)
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias(c)
    return spans.select("tenant_id", "opportunity_id", "stage", hour("valid_from"), hour("valid_to"), "changes")


@query("""
, people AS (SELECT c_nationkey % 5 AS tenant_id, c_custkey AS id, c_name AS name, c_mktsegment AS document, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS email, c_custkey % 9 = 0 AS deleted FROM customer)
SELECT o_orderkey AS request_id, id, name, document, email, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS why, 'reveal_success' AS action
FROM orders LEFT JOIN people ON id = o_custkey AND tenant_id = o_orderkey % 5 AND NOT deleted""")
def revealed_beneficiaries(spark: SparkSession, d: str) -> DataFrame:
    """Every order asks for its customer, as a user of some tenant: the log has all, the result those of the own tenant that are not deleted."""
    c = F.col("c_custkey")
    people = b.read(spark, d, "customer").select(
        (F.col("c_nationkey") % 5).alias("tenant_id"), c.alias("id"), *(reveal.encrypted(value, _KEY).alias(name) for name, value in (("name", F.col("c_name")), ("document", F.col("c_mktsegment")), ("email", F.when(c % 4 > 0, F.col("c_mktsegment")).otherwise(F.lit(""))), ("phone", F.lit(None).cast("string")))),
        F.when(c % 9 == 0, F.lit("1998-12-01")).alias("deleted_at"),
    )
    orders = b.read(spark, d, "orders")
    asked = orders.unionByName(orders.where("o_orderkey % 2 = 0")).select(F.col("o_orderkey").alias("request_id"), F.pmod("o_orderkey", F.lit(5)).alias("tenant_id"), F.lit(1).alias("user_id"), F.col("o_custkey").alias("beneficiary_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("reason"))
    shown = reveal.revealed(people, asked, _KEY).select("request_id", "id", "name", "document", "email")
    return reveal.access_rows(asked, True).select("request_id", F.col("reason").alias("why"), "action").join(shown, "request_id", "left")
