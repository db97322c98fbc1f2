"""Tables that are replaced as a whole or by buckets, without a moment at which a reader finds nothing.

Every write goes to a folder of its own. A small file in the table's root names the folders that are current; it is
replaced by one atomic rename. Who has opened the table goes on reading the folders it opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table that is upserted.
BUCKETS = 64


def _files(spark: SparkSession):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path, jvm


def _state(spark: SparkSession, root: str) -> dict:
    """What the pointer of a table says; empty if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return {}
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, state: dict) -> None:
    """The pointer, replaced in one step."""
    context, Path, jvm = _files(spark)
    new = Path(f"{root}/_{uuid.uuid4().hex}")
    out = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, Path(f"{root}/_current"), options)


def refresh(df: DataFrame, root: str, least: int = 1) -> DataFrame:
    """A stored aggregate, computed anew; the current one then. With fewer than `least` rows the last version stays.

    The first version is taken whatever it holds. df may read the version before; if its job fails, nothing changes.
    """
    spark, state = df.sparkSession, _state(df.sparkSession, root)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    new = spark.read.schema(df.schema).parquet(f"{root}/{folder}")
    if not state or len(new.take(least)) == least:
        _point(spark, root, {"folder": folder, "before": state.get("folder"), "schema": df.schema.json()})
    return current(spark, root)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current rows of a refreshed table."""
    from pyspark.sql.types import StructType

    state = _state(spark, root)
    if not state:
        raise FileNotFoundError(root)
    return spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(f"{root}/{state['folder']}")


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes folders that are neither current nor among the last `keep`, and says how many. For times when no reader holds older ones."""
    state = _state(spark, root)
    used = {state.get("folder"), *state.get("buckets", {}).values()}
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(((x.getModificationTime(), x.getPath().getName()) for x in system.listStatus(path) if x.getPath().getName().startswith("v-")), reverse=True)
    old = [name for _, name in found[keep:] if name not in used]
    for name in old:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return len(old)


def bucketed(spark: SparkSession, root: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The current rows of an upserted table, or of some of its buckets; None before its first batch."""
    from pyspark.sql.types import StructType

    state = _state(spark, root)
    if not state:
        return None
    paths = [f"{root}/{folder}/bucket={bucket}" for bucket, folder in sorted(state["buckets"].items()) if only is None or int(bucket) in only]
    schema = StructType.fromJson(json.loads(state["schema"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batch(rows: DataFrame, batch: int, root: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> bool:
    """Merges a batch into a table of hash buckets; False, and nothing done, if the table has that batch already.

    merge(old, new) gives the rows that the keys of both have then. Only buckets with keys of the batch are read and
    written; the others keep their files. For foreachBatch: a batch that is played again, after a failure before or
    behind its end, changes nothing more. Null keys are keys. A key's rows are always in one bucket.
    """
    spark = rows.sparkSession
    state = _state(spark, root)
    if state and state["batch"] >= batch:
        return False
    buckets = state.get("of", buckets)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", place).persist()  # read for its buckets and for the merge
    try:
        touched = [x["bucket"] for x in rows.select("bucket").distinct().collect()]  # at most `buckets`
        rows = rows.drop("bucket")
        old = bucketed(spark, root, touched)
        merged = merge(rows.limit(0) if old is None else old, rows)
        folder = f"v-{uuid.uuid4().hex}"
        merged.withColumn("bucket", place).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{root}/{folder}")
        held = {str(x["bucket"]) for x in spark.read.schema("bucket int").parquet(f"{root}/{folder}").select("bucket").distinct().collect()} if touched else set()
        kept = {k: v for k, v in state.get("buckets", {}).items() if int(k) not in touched}
        _point(spark, root, {"batch": batch, "of": buckets, "buckets": kept | {k: folder for k in held}, "schema": merged.schema.json()})
    finally:
        rows.unpersist()
    return True


def upsert_stream(rows: DataFrame, root: str, checkpoint: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS):
    """A streaming query that merges what there is, batch by batch, and ends."""
    query = rows.writeStream.foreachBatch(lambda df, batch: upsert_batch(df, batch, root, keys, merge, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
