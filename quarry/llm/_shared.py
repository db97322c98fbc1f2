"""Tables in the folder that all executors share, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset: a new temporary folder in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df, with the session's Arrow batches bounded, for texts of any length must fit beside the executor's heap.

    Spark has these bounds for a session only, so they stay set; sessions with smaller ones keep theirs. Spark
    takes 0 and less for no bound at all.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts the lineage and survives lost executors.

    The table stays there as long as results that read it may: whoever clears the folder ends them. With a
    path, what stood there before is replaced.
    """
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts into which the edges of one node are dealt for a join with its minimum.
SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, component), component the smallest node reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars, which
    links around one centre are after a round or two. Each round is a pre-aggregated minimum and a join
    with it; the edges of a node are dealt to SALTS tasks and its minimum to each of them, so that a node
    with very many edges is no single task's. The rounds write two tables in turn. Self-loops and null ends
    are ignored. No edges: no rows.
    """
    paths = new_path(edges.sparkSession), new_path(edges.sparkSession)
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), paths[0])
    salt, every = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def beside(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.select("u", "v", salt).join(least.select("u", "m", every), ["u", "salt"])

    number = 0
    while not _stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = beside(both, least).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Of each node's smaller neighbours, the smallest becomes the parent of the node and of the others.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        number += 1
        now = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), paths[number % 2])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether in distinct edges (u, v) each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.col("down") * F.least("up", F.lit(1)) > 1)).first()[0]


def components_with(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found, a stored result of components, with more edges (a, b): only what it left apart is searched again."""
    ends = edges
    for x in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(x), F.col("component").alias("_c")), x, "left").withColumn(x, F.coalesce("_c", x)).drop("_c")
    more = stored(components(ends))
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = spread_join(found, moved, "component", "node", hot_keys(found, "component"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    return out.unionAll(more.join(found.select("node"), "node", "left_anti").select("node", "component"))


def hot_counts(counts: DataFrame, key: str, share: int = 1000, least: int = 1000) -> DataFrame | None:
    """(key, salts) of the keys that hold more than `least` rows and one in `share`: fewer than `share` keys, whatever the table; None without any. counts: key, count."""
    most = max(least, (counts.agg(F.sum("count")).first()[0] or 0) // share)
    found = counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("salts"))
    known = found.collect()  # fewer than `share`
    return counts.sparkSession.createDataFrame(known, found.schema) if known else None


def hot_keys(rows: DataFrame, key: str, share: int = 1000, least: int = 1000) -> DataFrame | None:
    """As hot_counts, of the rows' own counts."""
    most = max(least, rows.count() // share)
    found = rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("salts"))
    known = found.collect()  # fewer than `share`
    return rows.sparkSession.createDataFrame(known, found.schema) if known else None


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with per_key, one row of each key; the rows of a hot key are dealt by `by` to its salts, its row goes to each."""
    if hot is None:
        return rows.join(per_key, key, how)
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), "salts"), F.lit(0)).cast("int")).drop("salts")
    right = per_key.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
