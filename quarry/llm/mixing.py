"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight p/q its k-th block (from 0) is released at slot
floor(kq/p) and due before slot ceil((k+1)q/p); earliest deadline first meets all deadlines, so at any slot
every source is less than one block from its share. The schedule has period q, so one period is computed
and every block finds its slot by arithmetic; documents are never ordered in one task.

Sources of weight 1 have one block a period, released at its start and due at its end. Whatever their
number, only the slots of the heavier sources are simulated: those of weight 1 take the slots between in
the order of their names, so a number among them, which Spark gives, is all that their slot needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import stored

#: Documents of a block; slots of a period before rounding; blocks a period that given weights over 1 may add up to.
BLOCK, PERIOD, MAX_SLOTS = 16, 1000, 250_000


def schedule(heavy: list[tuple[int, int]], light: int) -> list[tuple[int, int, int]]:
    """(source, block, slot) of the sources of weight 2 and more in one period, by earliest deadline, then name.

    heavy: weight of each such source, in order of names, and how many of the `light` sources of weight 1 have
    smaller names. The slots that are not returned go to the light sources in order of their names.
    """
    period = sum(weight for weight, _ in heavy) + light
    waiting = [(0, source) for source in range(len(heavy))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    done, slots, slot, passed = [0] * len(heavy), [], 0, 0  # passed: light sources that have had their slot
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            source = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[source] + 1) * period // heavy[source][0]), source))
        if ready and (ready[0][0] < period or heavy[ready[0][1]][1] <= passed):
            source = heapq.heappop(ready)[1]
            slots.append((source, done[source], slot))
            done[source] += 1
            slot += 1
            if done[source] < heavy[source][0]:
                heapq.heappush(waiting, (done[source] * period // heavy[source][0], source))
        else:  # light sources, up to the next release or a heavy one that is due no later and named before the next
            until = min(heavy[ready[0][1]][1] if ready else light, passed + (waiting[0][0] - slot if waiting else light))
            slot, passed = slot + until - passed, until
    return slots


def _between(taken: Iterable[int]):
    """The slot of the r-th light source, where those in taken, ascending, have gone to others."""
    before = np.array([slot - k for k, slot in enumerate(taken)], np.int64)  # light slots before each

    @F.pandas_udf("long")
    def slot(rank: pd.Series) -> pd.Series:
        return rank + np.searchsorted(before, rank.to_numpy(), side="right")

    return slot


def _shares(sizes: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """(_source, _own): the weight of each source. Given ones are divided by their common divisor; else see mix_sources."""
    if weights is None:
        # Decimals add up to the same total in any order.
        total = sizes.agg(F.sum(F.sqrt("count").cast("decimal(38,12)"))).first()[0]
        return sizes.select("_source", F.greatest(F.lit(1), F.floor(PERIOD * F.sqrt("count") / F.lit(float(total or 1)) + 0.5)).cast("long").alias("_own"))
    positive = {source: weight for source, weight in weights.items() if weight > 0}
    divisor = gcd(*positive.values()) or 1
    if (slots := sum(weight for weight in positive.values() if weight > divisor) // divisor) > MAX_SLOTS:
        raise ValueError(f"the weights have a period of {slots} slots and more; give smaller whole numbers")
    shares = sizes.sparkSession.createDataFrame([(source, weight // divisor) for source, weight in positive.items()], "_source string, _own long")
    if missing := [x["_source"] for x in sizes.join(F.broadcast(shares), "_source", "left_anti").limit(5).collect()]:  # as many as weights were given
        raise ValueError(f"no weight for {sorted(missing)}")
    return shares


def _numbered(shares: DataFrame) -> DataFrame:
    """shares with _light: how many sources of weight 1 have smaller names."""
    ranges = stored(shares.repartitionByRange("_source").withColumn("_range", F.spark_partition_id()))
    before = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranges.groupBy("_range").agg(F.count_if(F.col("_own") == 1).alias("n"))
    per_range = per_range.select("_range", F.coalesce(F.sum("n").over(before(Window.orderBy("_range"))), F.lit(0)).alias("_from"))  # one row a shuffle partition
    within = F.count_if(F.col("_own") == 1).over(before(Window.partitionBy("_range").orderBy("_source")))
    return ranges.withColumn("_light", F.coalesce(within, F.lit(0))).join(F.broadcast(per_range), "_range").select("_source", "_own", (F.col("_from") + F.col("_light")).alias("_light"))


def mix_sources(documents: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, digits: int = 3) -> DataFrame:
    """documents with block (number within its source), slot and place (within the block): their order is the mix.

    weights gives each source a whole number; without it, sources have weights in proportion to the square roots
    of their sizes, in whole slots of about PERIOD and at least one. Every source has a weight of its own, whatever
    their number. Within a source, documents are in order of the MD5 of doc_id, so any prefix of the mix is a fair
    sample of it. A source that runs out leaves its slots empty; the others keep theirs. A null source is a source
    of its own, named ''; null doc_ids come last in their source; repeated rows each have a place; columns
    named block, slot or place give way; an empty table gives no rows. A source without a positive weight
    in given weights is an error, and so are given weights over the common divisor that add up to more than
    MAX_SLOTS of them.
    """
    base = documents.drop("block", "slot", "place")
    spark = documents.sparkSession
    name, digest = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g"))
    shares = stored(_numbered(_shares(base.groupBy(name.alias("_source")).count(), weights)))
    # Fewer than PERIOD sources by sizes have more than one slot of about PERIOD; of given weights, at most half of MAX_SLOTS.
    heavy = shares.where("_own > 1").orderBy("_source").collect()
    light = shares.where("_own = 1").count()
    slots = schedule([(x["_own"], x["_light"]) for x in heavy], light)
    period = sum(x["_own"] for x in heavy) + light
    shares = shares.withColumn("_alone", F.when(F.col("_own") == 1, _between(slot for _, _, slot in slots)("_light")))
    slots = spark.createDataFrame([(heavy[source]["_source"], number, slot) for source, number, slot in slots], "_source string, _number long, _slot long")
    keyed = base.withColumn("_source", name).withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, digits))
    parts = keyed.select("_source", "_part").groupBy("_source", "_part").count()
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_source", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    parts = parts.join(shares.drop("_light"), "_source")  # 16 ** digits rows of a source at most
    within = Window.partitionBy("_source", "_part").orderBy(F.col("doc_id").isNull(), "_digest", "doc_id", *([F.xxhash64("text")] if "text" in base.columns else []))
    placed = keyed.join(parts, ["_source", "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    placed = placed.withColumn("block", F.floor(F.col("_rank") / block)).withColumn("place", F.pmod("_rank", F.lit(block)))
    placed = placed.withColumn("_number", F.pmod("block", "_own")).join(F.broadcast(slots), ["_source", "_number"], "left")  # MAX_SLOTS rows at most
    slot = F.floor(F.col("block") / F.col("_own")) * period + F.coalesce("_slot", "_alone")
    return placed.select(*base.columns, "block", slot.alias("slot"), "place")


def op7_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, blocks of 16, weights as the square roots of the sources' sizes."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")).select("doc_id", "source", "block", "slot", "place")


QUERIES = {"op7_mixing_sources": op7_mixing_sources}
ORACLE_SQL = {
    "op7_mixing_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, coalesce(md5(doc_id::VARCHAR), 'g') AS h FROM documents),
size AS (SELECT s, sqrt(count(*)) AS r FROM d GROUP BY s),
weight AS (SELECT s, greatest(1, floor({PERIOD} * r / (SELECT sum(r ORDER BY s) FROM size) + 0.5))::BIGINT AS p FROM size),
all_weights AS (SELECT list(s ORDER BY s) AS names, list(p ORDER BY s) AS p, sum(p)::BIGINT AS q FROM weight),
step AS (
  SELECT -1::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS c, 0::BIGINT AS pick FROM all_weights
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: CASE WHEN i = k THEN x + 1 ELSE x END), k
  FROM (
    SELECT t, c, list_position(due, list_min(due))::BIGINT AS k FROM (
      SELECT t, c, list_transform(c, lambda x, i: CASE WHEN x < p[i] AND (x * q) // p[i] <= t + 1 THEN ((x + 1) * q + p[i] - 1) // p[i] ELSE 9000000000000 END) AS due
      FROM step, all_weights WHERE t + 1 < q))
),
period AS (SELECT names[pick] AS s, c[pick] - 1 AS number, t AS slot, p[pick] AS p, q FROM step, all_weights WHERE t >= 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id IS NULL, h, doc_id) - 1 AS r FROM d)
SELECT doc_id, source, r // {BLOCK} AS block, (r // {BLOCK} // period.p) * q + slot AS slot, r % {BLOCK} AS place
FROM ranked JOIN period ON period.s = ranked.s AND period.number = (r // {BLOCK}) % period.p
"""
}
