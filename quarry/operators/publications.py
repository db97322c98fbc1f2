"""The flow of publications: intake, links to assets, projected events, agenda and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import deadline_results
from quarry.functions.text import process_number
from quarry.operators.legal import classify, interpret


def intake(processes: DataFrame, items: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(processes, publications) after items of an API.

    A process that is known keeps what it has and gets what it lacks, of an item with a value the smallest; a
    new one is added. A publication is known by its process, day and text (by hash): each once.
    """
    offered = items.groupBy(key).agg(*(F.min(c).alias(f"_{c}") for c in columns))
    merged = processes.join(offered, key, "full_outer").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))
    once = items.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256)).groupBy(key, "day", "text_hash").agg(F.min("publication_id").alias("publication_id"), F.first("text").alias("text"))
    return merged, once


def linked(items: DataFrame, processes: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, processes): items with cnj_number, process_key and asset_id, and the processes after them.

    items: tenant_id, process_number, court. processes: tenant_id, cnj_number, asset_id, court. assets: tenant_id,
    cnj_number, asset_id. A valid number links to the process of its tenant, which gets the court it lacks; without
    one a process is made, of the asset with that number (the smallest id), if there is one. A known process keeps
    its asset, also if it has none. Other numbers link to nothing.
    """
    keys = ["tenant_id", "cnj_number"]
    rows = items.drop("cnj_number", "asset_id").withColumn("cnj_number", process_number("process_number"))
    named = rows.where("cnj_number is not null").groupBy(*keys).agg(F.min("court").alias("_court"))
    owners = assets.where("cnj_number is not null").groupBy(*keys).agg(F.min("asset_id").alias("_owner"))
    both = processes.select(*keys, "asset_id", "court", F.lit(True).alias("_known")).join(named, keys, "full").join(owners, keys, "left")
    after = both.select(*keys, F.when(F.col("_known"), F.col("asset_id")).otherwise(F.col("_owner")).alias("asset_id"), F.coalesce("court", "_court").alias("court"), F.col("_known").isNull().alias("is_new"))
    return rows.join(after.select(*keys, "asset_id"), keys, "left"), after


def flow(items: DataFrame, known: DataFrame, processes: DataFrame, assets: DataFrame, days: DataFrame, now: str) -> dict[str, DataFrame]:
    """What items of an API make: publications (linked, interpreted, with deadline and whether they are new), processes, events.

    items: tenant_id, djen_id, process_number, court, communication, judicial_class, text, available_on, published_on,
    calendar_verified. known: tenant_id, djen_id. An item of a djen_id that is known replaces it; of repeated items the
    last text holds. Events: `ingested` of a publication that is new, and the signals of its text for its asset.
    """
    keys = ["tenant_id", "djen_id"]
    once = items.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in items.columns if c not in keys)), "text").alias("_i")).select(*keys, "_i.*")
    rows, after = linked(once, processes, assets)
    rows = rows.join(known.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")
    read = interpret(rows, "text", F.col("court"), F.col("communication"), F.col("judicial_class"))
    read = deadline_results(read.withColumn("manual_due_on", F.lit(None).cast("date")), days, now)
    ingested = read.where("is_new").select(*keys, "asset_id", F.lit("ingested").alias("event_type"))
    signals = classify(read.where("asset_id is not null"), "text", [*keys, "asset_id"]).select(*keys, "asset_id", F.col("code").alias("event_type"))
    return {"publications": read, "processes": after, "events": ingested.unionAll(signals.distinct())}


def newest(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """A classification scan: the newest rows, up to a limit."""
    return df.orderBy(*order).limit(limit)


def project(publications: DataFrame, processes: DataFrame) -> DataFrame:
    """Events (publication_id, asset_id, event_type, idempotency_key) of the signals in publications.

    The asset is the publication's own, else its process's; without one there is no event. One event for each
    publication and signal, however often it is projected.
    """
    owner = processes.select("process_id", F.col("asset_id").alias("_owner"))
    linked = publications.join(owner, "process_id", "left").withColumn("asset_id", F.coalesce("asset_id", "_owner")).where("asset_id is not null")
    found = classify(linked, "text", ["publication_id", "asset_id"])
    return found.select("publication_id", "asset_id", F.col("code").alias("event_type"), "idempotency_key").dropDuplicates(["idempotency_key"])


def affected(events: DataFrame) -> DataFrame:
    """The assets to score anew, each once, with their events."""
    return events.groupBy("asset_id").agg(F.count("*").alias("events"))


def agenda(publications: DataFrame, now: str, sources: int = 200, most: int = 25) -> DataFrame:
    """The first items of an agenda by day: deadlines are fatal, so they can be overdue; hearings and judgments are not.

    They come from the publications that are not dismissed and have any day, the first `sources` of them by
    their deadline, else hearing, else judgment.
    """
    kept = publications.where(~F.coalesce("dismissed", F.lit(False))).withColumn("_by", F.coalesce("due_on", "hearing_on", "judgment_on")).where("_by is not null")
    kept = kept.orderBy("_by", "publication_id").limit(sources)
    item = lambda kind, day, fatal: F.struct(F.lit(kind).alias("kind"), F.col(day).alias("day"), F.lit(fatal).alias("fatal"))
    items = kept.select("publication_id", F.explode(F.array(item("deadline", "due_on", True), item("hearing", "hearing_on", False), item("judgment", "judgment_on", False))).alias("i")).select("publication_id", "i.*").where("day is not null")
    return items.withColumn("overdue", F.col("fatal") & (F.col("day") < F.lit(now).cast("date"))).orderBy("day", "publication_id", "kind").limit(most)


def monitored(subjects: DataFrame, publications: DataFrame, key: str, at: str) -> DataFrame:
    """subjects with the number of their publications, 0 without any, and the latest day."""
    per = publications.groupBy(key).agg(F.count("*").alias("publications"), F.max(at).alias("latest_on"))
    return subjects.join(per, key, "left").withColumn("publications", F.coalesce("publications", F.lit(0)))


def monitoring_totals(cases: DataFrame, registrations: DataFrame) -> DataFrame:
    """One row: active cases, active registrations, and the publications of both."""
    total = lambda df, name: df.agg(F.count_if("active").alias(name), F.coalesce(F.sum("publications"), F.lit(0)).alias(f"_{name}"))
    both = total(cases, "active_cases").crossJoin(total(registrations, "active_registrations"))  # one row each
    return both.select("active_cases", "active_registrations", (F.col("_active_cases") + F.col("_active_registrations")).alias("publications"))
