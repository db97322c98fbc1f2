"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision where it can matter.

Each normalised vector x is kept as s * q + e with q of int8 and the norm of e known. For two vectors
|x.y - st(q.r)| <= |e|(1 + |f|) + (1 + |e|)|f| + |e||f|, so only pairs whose int8 product plus that bound
reaches the threshold are computed again in double precision. Equal vectors of a label are one row with a
count before any product. A label is cut into tiles and each pair of tiles is a group of its own; a group
returns a count and a local root per vector, never its pairs.

In large labels a tile holds vectors near one pivot, and the range of its angles to every pivot is known. By
the triangle inequality two vectors are at least as far apart as their angles to any pivot differ, so a pair
of tiles whose ranges lie too far apart for some pivot has no link and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import components, stored

#: Vectors of a tile; labels that get pivots, the largest ones of more than a tile, and pivots of each. Neither changes a result.
TILE, PIVOT_LABELS, PIVOTS = 2048, 64, 32


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and an upper bound of the error norm of each row."""
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    q = np.rint(unit / np.where(scale > 0, scale, 1)[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


def close_pairs(vectors: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i in rows, j in others, i < j or from different tiles, and cosine >= threshold."""
    norm = np.linalg.norm(vectors, axis=1)
    q, scale, error = quantise(vectors / norm[:, None])
    # Sums of up to 1000 int8 products are exact in single precision, which BLAS multiplies fastest.
    kind = np.float32 if vectors.shape[1] <= 1000 else np.float64
    same, out = rows is others, []
    for a in range(0, len(rows), block):
        i = rows[a : a + block]
        j = others[a:] if same else others
        near = (q[i].astype(kind) @ q[j].astype(kind).T).astype(np.float64) * scale[i][:, None] * scale[j]
        slack = error[i][:, None] * (1 + error[j]) + (1 + error[i])[:, None] * error[j] + error[i][:, None] * error[j]
        x, y = np.nonzero(near + slack >= threshold - 1e-9)
        x, y = i[x], j[y]
        if same:
            x, y = x[x < y], y[x < y]
        for b in range(0, len(x), 1 << 16):
            u, v = x[b : b + (1 << 16)], y[b : b + (1 << 16)]
            sure = np.einsum("ij,ij->i", vectors[u], vectors[v]) / (norm[u] * norm[v]) >= threshold
            out.append((u[sure], v[sure]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _tile_pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.num_rows
        rep, copies, tile, s, t = (table.column(c).to_numpy() for c in ("rep", "copies", "tile", "s", "t"))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(n, -1)
        rows = np.flatnonzero(tile == s[0])
        others = rows if s[0] == t[0] else np.flatnonzero(tile == t[0])
        a, b = close_pairs(vectors, rows, others, threshold)
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        root = rep.copy()
        while len(a):
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            if (before == root).all():
                break
        own = np.flatnonzero(links)
        return pa.table({**{c: table.column(c).take(pa.array(own)) for c in ("label", "k1", "k2")}, "rep": rep[own], "links": links[own].astype(np.int64), "root": root[own]})

    return run


def _angled(pivots: dict[tuple, tuple[np.ndarray, int]], schema: pa.Schema):
    """The number of the nearest of the label's first pivots, as many as it has tiles, and the angles to all of its pivots; none where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims, vectors = (batch.column(c).to_pylist() if c != "embedding" else batch.column(c) for c in ("label", "dim", "embedding"))
            cell, angles = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(labels, dims, strict=True)):
                if key in pivots:
                    groups.setdefault(key, []).append(row)
            for key, rows in groups.items():
                own = np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), -1)
                unit, first = pivots[key]
                angle = np.arccos(np.clip((own / np.linalg.norm(own, axis=1)[:, None]) @ unit.T, -1, 1))
                cell[rows] = angle[:, :first].argmin(axis=1)
                for row, found in zip(rows, angle.tolist(), strict=True):
                    angles[row] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angles, pa.list_(pa.float64()))], schema=schema)

    return run


def _cells(classes: DataFrame, counts: DataFrame, tile: int) -> DataFrame:
    """classes with cell and angles. Pivots are a bounded number of vectors, by a hash, of a bounded number of large labels."""
    from pyspark.sql.pandas.types import to_arrow_schema

    large = counts.where(F.col("n") > tile).orderBy(F.desc("n"), "label", "dim").limit(PIVOT_LABELS)
    first = Window.partitionBy("label", "dim").orderBy(F.xxhash64("k1"), "k1", "k2")
    chosen = classes.join(F.broadcast(large), ["label", "dim"]).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= PIVOTS)
    pivots: dict[tuple, list] = {}
    tiles: dict[tuple, int] = {}
    for row in chosen.select("label", "dim", "n", "embedding").collect():  # at most PIVOT_LABELS * PIVOTS vectors
        pivots.setdefault((row["label"], row["dim"]), []).append(row["embedding"])
        tiles[row["label"], row["dim"]] = -(-row["n"] // tile)
    unit = {key: (np.array(own) / np.linalg.norm(own, axis=1)[:, None], tiles[key]) for key, own in pivots.items()}
    extra = classes.sparkSession.createDataFrame([], "cell int, angles array<double>").schema
    schema = type(extra)([*classes.schema.fields, *extra.fields])
    return stored(classes.mapInArrow(_angled(unit, to_arrow_schema(schema, prefers_large_types=False)), schema))


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, tile, pairs): the pairs (s, t) that a tile is in, without those whose angles to some pivot differ too much. tiles: label, dim, tile, low, high."""
    reach = float(np.arccos(threshold)) + 1e-6
    one, two = tiles.select("label", "dim", F.col("tile").alias("s"), F.col("low").alias("low_s"), F.col("high").alias("high_s")), tiles.select("label", "dim", F.col("tile").alias("t"), F.col("low").alias("low_t"), F.col("high").alias("high_t"))
    apart = F.exists(F.arrays_zip("low_s", "high_s", "low_t", "high_t"), lambda x: (x["low_s"] - x["high_t"] > reach) | (x["low_t"] - x["high_s"] > reach))
    near = one.join(two, ["label", "dim"]).where("s <= t").where(~apart).select("label", "dim", "s", "t")
    both = near.select("label", "dim", F.explode(F.array_distinct(F.array("s", "t"))).alias("tile"), F.struct("s", "t").alias("p"))
    return both.groupBy("label", "dim", "tile").agg(F.collect_list("p").alias("pairs"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared if their labels (not null) and lengths are equal, by cosine in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, link
    with nothing. n_links counts the other vectors linked directly, component_id is the smallest vec_id
    reachable, kept says that it is the row's own. Repeated rows count once as a partner and get the same
    result; other columns are ignored; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    keyed = rows.withColumn("k1", F.when(sound, F.xxhash64("embedding"))).withColumn("k2", F.when(sound, F.xxhash64(F.reverse("embedding"))))
    once = keyed.where("k1 is not null").dropDuplicates(["vec_id", "label", "k1", "k2"])
    classes = stored(once.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")))
    counts = stored(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    placed = _cells(classes, counts, tile)
    size = stored(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    before = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell, at most PIVOTS of a label
    size = size.withColumn("from", F.coalesce(F.sum("tiles").over(before), F.lit(0)).cast("int"))
    size = F.broadcast(size) if size.count() <= 100_000 else size
    dealt = placed.join(size, ["label", "dim", "cell"]).withColumn("tile", (F.col("from") + F.pmod(F.xxhash64("k1", "k2"), "tiles")).cast("int")).drop("cell", "tiles", "from")
    extreme = lambda of, name: F.array_compact(F.array(*(of(F.get("angles", F.lit(k))) for k in range(PIVOTS)))).alias(name)
    tiles = stored(dealt.groupBy("label", "dim", "tile").agg(extreme(F.min, "low"), extreme(F.max, "high")))
    pairs = stored(_tile_pairs(tiles, threshold))
    pairs = F.broadcast(pairs) if pairs.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0] <= 1_000_000 else pairs
    dealt = dealt.drop("angles").join(pairs, ["label", "dim", "tile"])
    dealt = dealt.select("label", "dim", "k1", "k2", "rep", "copies", "embedding", "tile", F.explode("pairs").alias("p")).select("*", "p.s", "p.t").drop("p")
    shape = f"label {classes.schema['label'].dataType.simpleString()}, k1 long, k2 long, rep long, links long, root long"
    found = stored(dealt.groupBy("label", "dim", "s", "t").applyInArrow(_tile_pair(threshold), shape))
    links = found.groupBy("label", "k1", "k2").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.select("label", "k1", "k2", "rep", "copies").join(links, ["label", "k1", "k2"], "left").join(joined, "rep", "left")
    out = keyed.select("vec_id", "label", "k1", "k2").join(known, ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors of the table, cosine 0.93 or more within a label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLE_SQL = {
    "op3_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, c.m = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
}
