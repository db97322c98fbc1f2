"""History of stages: when each opportunity was in which stage, from its transitions in any order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_intervals(transitions: DataFrame, key: Sequence[str] = ("tenant_id", "opportunity_id"), stage: str = "to_stage", at: str = "changed_at", tie: str = "transition_id") -> DataFrame:
    """(key, stage, valid_from, valid_to, changes): from each change of stage to the next; valid_to is null for the last.

    A transition to the stage that already holds adds to `changes` and to nothing else. Of transitions at one time the
    last by `tie` holds. Repeated rows of one tie are one transition; transitions without a time or stage count nowhere.
    """
    rows = transitions.where(F.col(at).isNotNull() & F.col(stage).isNotNull()).groupBy(*key, tie).agg(F.min(F.struct(at, stage)).alias("_x")).select(*key, tie, "_x.*")
    rows = rows.groupBy(*key, at).agg(F.max_by(stage, tie).alias(stage))
    order = Window.partitionBy(*key).orderBy(at)
    rows = rows.withColumn("_new", (~F.col(stage).eqNullSafe(F.lag(stage).over(order))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    spans = rows.groupBy(*key, "_run").agg(F.first(stage).alias("stage"), F.min(at).alias("valid_from"), F.count("*").alias("changes"))
    return spans.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("_run"))).select(*key, "stage", "valid_from", "valid_to", "changes")


def merged_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge for versions.upsert_batch: all transitions, each once; late ones take their place when intervals are made."""
    return old.unionByName(new).dropDuplicates()


def as_of(intervals: DataFrame, moments: DataFrame, key: Sequence[str] = ("tenant_id", "opportunity_id"), at: str = "at") -> DataFrame:
    """moments (key, at) with the stage that held then, null before the first."""
    inside = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    found = moments.join(intervals.select(*key, "stage", "valid_from", "valid_to"), list(key)).where(inside).select(*key, at, "stage").distinct()
    return moments.join(found, [*key, at], "left")
