"""Merkle manifest of a table: one digest that every row can be proved against.

Leaves are hashed where the rows are read, sorted into runs by source and doc_id, and numbered. A node is a row
at a coordinate: level, source, place. The nodes of a level are written as Parquet, ordered by coordinate; the
next level reads them, joins every 16 neighbours, and is written in turn. The digests of the sources are the
leaves of a last tree of the same kind. Proofs come from merging each level with the one above it, from the
root down: a node's path is its run and the path of its parent, so a path is held once for 16 leaves, and the
leaves of a source, however many, are spread by coordinate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import new_path

#: Nodes of a run.
FAN = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One step of a path: the node's place in its run, and the digests of the whole run.
_PATH = "array<struct<place:int,run:array<string>>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the five values, each `-` if null, else its UTF-8 bytes' count, a colon and the value."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _joined(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def _kept(df: DataFrame, folder: str, level: str) -> DataFrame:
    """A level of the node store: written below the folder, and read again."""
    path = f"{folder}/level={level}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(rows: DataFrame, tree: str, order: list[str], folder: str, level: str) -> DataFrame:
    """rows, sorted by tree and order, with `place`, their number from 0 within their tree, and `n`, the rows of the tree; stored.

    Sorted runs are written with ids that ascend through them; a place is an id less the first of its tree in its
    run, plus the rows of the tree in the runs before. So no tree is sorted or numbered by a single task.
    """
    runs = _kept(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_id", F.monotonically_increasing_id()), folder, f"{level}-runs")
    runs = runs.withColumn("_run", F.shiftright("_id", 33)).withColumn("_tree", F.coalesce(F.concat(F.lit("="), tree), F.lit("")))
    # A row for each run and one more for each tree.
    parts = runs.groupBy("_tree", "_run").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_tree").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_tree", "_run", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("_tree")).alias("n"))
    return _kept(runs.join(parts, ["_tree", "_run"]).withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_run", "_shift"), folder, level)


def _climb(nodes: DataFrame, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the tops of all trees, each as runs (_tree, parent, run), and the tops (_tree, digest, height).

    nodes: _tree, place, digest, n. The height of a tree is its number of levels; one with a single node is its own top.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("_tree", "digest", F.lit(0).alias("height"))
    while most > 1:
        runs = nodes.where("n > 1").groupBy("_tree", F.floor(F.col("place") / FAN).alias("parent"), F.ceil(F.col("n") / FAN).alias("n")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        levels.append(_kept(runs.select("_tree", "parent", "n", F.col("run.digest").alias("run")), folder, f"{name}{len(levels)}"))
        nodes, most = levels[-1].select("_tree", F.col("parent").alias("place"), _joined(F.col("run")).alias("digest"), "n"), -(-most // FAN)
        tops = tops.unionAll(nodes.where("n = 1").select("_tree", "digest", F.lit(len(levels)).alias("height")))
    return [x.drop("n") for x in levels], tops


def _step(at: str, run: str) -> Column:
    return F.array(F.struct(F.col(at).cast("int").alias("place"), F.col(run).alias("run")))


def _descend(placed: DataFrame, levels: list[DataFrame], tops: DataFrame, folder: str, name: str) -> DataFrame:
    """placed, with the path of each node through its own tree and then that of its tree, and the other columns of tops.

    tops: _tree, height, path (of the tree's top), and columns that all nodes of a tree share.
    """
    shared = [c for c in tops.columns if c not in ("_tree", "height", "path")]
    start = lambda heights: tops.where(heights).select("_tree", F.lit(0).cast("long").alias("parent"), "path", (F.col("height") == 0).alias("alone"), *shared)
    paths = None
    for k in range(len(levels) - 1, 0, -1):
        above = start(F.col("height") == k + 1)
        runs = levels[k].join(above if paths is None else above.unionAll(paths), ["_tree", "parent"])
        each = runs.select("_tree", "parent", "path", "run", "alone", *shared, F.posexplode("run").alias("at", "digest"))
        paths = _kept(each.select("_tree", (F.col("parent") * FAN + F.col("at")).alias("parent"), F.concat(_step("at", "run"), "path").cast(_PATH).alias("path"), "alone", *shared), folder, f"{name}{k}")
    above = start(F.col("height") <= 1)
    own = [c for c in placed.columns if c not in ("_tree", "place", "n")]
    runs = placed.groupBy("_tree", F.floor(F.col("place") / FAN).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", *own))).alias("own"))
    runs = runs.join(above if paths is None else above.unionAll(paths), ["_tree", "parent"])
    each = runs.select("_tree", "path", "alone", *shared, F.col("own.digest").alias("run"), F.posexplode("own").alias("at", "node"))
    path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(_step("at", "run"), "path")).cast(_PATH)
    return each.select(*(F.col(f"node.{c}") for c in own), path.alias("path"), *shared)


def _proof(path: Column) -> Column:
    """The siblings of all steps, level by level, left to right, as one text."""
    others = F.transform(path, lambda step: F.array_join(F.concat(F.slice(step["run"], 1, step["place"]), F.slice(step["run"], step["place"] + 2, FAN)), ""))
    return F.array_join(others, "")


def _folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    rise = lambda node, step: F.sha2(F.concat(F.array_join(F.slice(step["run"], 1, step["place"]), ""), node, F.array_join(F.slice(step["run"], step["place"] + 2, FAN), "")), 256)
    return F.aggregate(path, leaf, rise)


def manifest(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, leaf, subroot, root, path (array of place and run, leaf first), other_leaf.

    documents: doc_id, source, lang, n_chars, text, and `other_text` where a row is to be proved with another text
    than its own (other_leaf is its leaf with that; null without one). Leaves of a source ascend by doc_id (null
    first), repeated ids by leaf, so repeated rows have a leaf each. A null source is a source of its own, before
    all others; sources are in order of their UTF-8 bytes. Nulls in any column and empty texts have their own
    digests. Texts are read whole, once. Other columns are ignored. An empty table gives no rows.
    """
    folder = new_path(documents.sparkSession)
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(F.col("other_text").isNotNull(), leaf_digest(*values, F.col("other_text"))) if "other_text" in documents.columns else F.lit(None)
    leaves = documents.select("doc_id", F.col("source").cast("string").alias("source"), leaf_digest(*values, F.col("text")).alias("digest"), other.cast("string").alias("other_leaf"))
    placed = _numbered(_kept(leaves, folder, "leaves"), "source", ["doc_id", "digest"], folder, "0")
    levels, subroots = _climb(placed.select("_tree", "place", "digest", "n"), folder, "own")
    # The sources' tops are the nodes of one more tree, in the order of their names: null first, `=` before the rest.
    subroots = _kept(subroots.select(F.lit("").alias("tree"), F.col("_tree").alias("name"), "digest", "height"), folder, "subroots")
    roots = _numbered(subroots, "tree", ["name"], folder, "1").drop("tree")
    upper, root = _climb(roots.select("_tree", "place", "digest", "n"), folder, "upper")
    root = root.select("_tree", "height", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    roots = _descend(roots.withColumnRenamed("height", "own_height"), upper, root, folder, "up")
    tops = _kept(roots.select(F.col("name").alias("_tree"), F.col("own_height").alias("height"), "path", F.col("digest").alias("subroot"), "root"), folder, "roots")
    rows = _descend(placed, levels, tops, folder, "down")
    return rows.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "path", "other_leaf")


def audited(manifest_rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's other leaf, else its own, held against the root."""
    folded = _folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    return manifest_rows.select("doc_id", "leaf", "subroot", "root", F.sha2(_proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents; where 5 divides the CRC-32 of the doc_id, the text to be proved has its A-Z in lower case."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", _UPPER, _LOWER))
    return audited(manifest(documents.withColumn("other_text", changed)))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
#: crc32 as of zlib, over the characters of a number.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::BIGINT for _ in range(8)]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))"""
_SQL_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_FIELDS = " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || "
#: All levels of all trees: a run's nodes meet until a tree has one.
_SQL_TREE = """
SELECT tree, 0 AS level, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {0}
UNION ALL
SELECT tree, level + 1, place, digest, count(*) OVER (PARTITION BY tree) FROM (
  SELECT tree, level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {1} WHERE n > 1 GROUP BY tree, level, place // 16)
"""
#: Up from each leaf: the siblings so far, and the node that the tampered leaf gives.
_SQL_WALK = """
SELECT {0}
UNION ALL
SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.place // 16, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after)
FROM {1} w JOIN (
  SELECT tree, level, place, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {2} WHERE n > 1) s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place
"""
ORACLE_SQL = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_SQL_FIELDS}{_SQL_FIELD.format("text")}) AS leaf,
    CASE WHEN xor({_CRC.format("doc_id::VARCHAR")}, 4294967295::BIGINT) % 5 = 0 THEN sha256({_SQL_FIELDS}{_SQL_FIELD.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other
  FROM documents),
placed AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS ({_SQL_TREE.format("placed", "nodes")}),
tops AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1),
upper_nodes AS ({_SQL_TREE.format("tops", "upper_nodes")}),
walk AS ({_SQL_WALK.format("doc_id, leaf, tree, 0 AS level, place, '' AS proof, coalesce(other, leaf) AS folded FROM placed", "walk", "nodes")}),
own AS (SELECT w.doc_id, w.leaf, t.place, t.digest AS subroot, w.proof, w.folded FROM walk w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.place = w.place AND n.n = 1 JOIN tops t ON t.name = w.tree),
rise AS ({_SQL_WALK.format("doc_id, struct_pack(leaf := leaf, subroot := subroot) AS leaf, '' AS tree, 0 AS level, place, proof, folded FROM own", "rise", "upper_nodes")})
SELECT r.doc_id, r.leaf.leaf AS leaf, r.leaf.subroot AS subroot, n.digest AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = n.digest AS verified
FROM rise r JOIN upper_nodes n ON n.tree = '' AND n.level = r.level AND n.place = r.place AND n.n = 1
"""
}
