"""Benchmark decontamination: an FM-index of every training shard, searched for the test phrases.

A shard is a run of whole documents of about 2 MB inside a Spark task, so building, searching and
merging need no shuffle. The alphabet of the index is the vocabulary of the phrases; any run of other
words is one separator. Phrases are searched backwards through wavelet-matrix ranks, occurrences are
located by sampled suffix positions, and overlapping occurrences are merged to removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._fm import FMIndex
from quarry.llm._shared import new_path, small_batches, stored
from quarry.llm._words import ALNUM, chunks, split

#: Characters of benchmark text whose phrases travel together; a larger benchmark is searched in more passes, each of
#: which reads what the one before it has written, so that the driver holds one block's phrases and a plan one pass.
BLOCK_CHARS = 4 << 20
#: Bytes of text in a shard, about; a longer text is a shard by itself.
SHARD_BYTES = 2 << 20
_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class Phrases:
    """All distinct windows of n words of some items; an item with fewer words is one window."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        words = split(pa.array([text for _, text in items], pa.large_string()), ALNUM, lower=True)
        self.vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        name_of = np.array([-1 if name is None else place[name] for name, _ in items], np.int64)
        count = np.diff(words.first)
        times = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), times)
        begin = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)
        lengths = np.minimum(count[item], n)
        padded = np.concatenate([symbols + 1, np.zeros(n, np.int64)]).astype(np.int32)
        rows = np.where(np.arange(n) < lengths[:, None], padded[begin[:, None] + np.arange(n)], 0) if len(item) else np.zeros((0, n), np.int32)
        _, first, which = np.unique(np.ascontiguousarray(rows, np.int32).view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
        self.patterns, self.lengths = rows[first].astype(np.int64), lengths[first]
        # The items of each window, one after the other.
        pairs = np.unique(np.stack([which, name_of[item]], 1)[name_of[item] >= 0], axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.of, self.of_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its number of words, merged hit spans in words, and the items found."""
        words = split(texts, ALNUM, lower=True)
        count = np.diff(words.first)
        spans: list[list[tuple[int, int]]] = [[] for _ in count]
        items: list[list[str]] = [[] for _ in count]
        if not len(self.lengths) or not len(words.starts):
            return count, spans, items
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        text_of = words.text_of_word()
        line = np.zeros(len(hashes) + len(count), np.int64)  # one separator after each text
        line[np.arange(len(hashes)) + text_of] = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        kept = np.flatnonzero((line > 0) | np.concatenate([[False], line[:-1] > 0]))
        if not len(kept):
            return count, spans, items
        index = FMIndex(line[kept], len(self.vocabulary) + 1)
        lo, hi = index.find(self.patterns, self.lengths)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return count, spans, items
        times = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        place, which = kept[index.locate(rows)], np.repeat(found, times)
        text = np.searchsorted(words.first + np.arange(len(words.first)), place, "right") - 1
        word = place - text
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, word, 1)
        np.add.at(change, word + self.lengths[which], -1)
        hit = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(hashes) + 1, bool)
        edge[words.first] = True
        begins = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
        stops = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
        for k, begin, stop in zip(text_of[begins], begins, stops, strict=True):
            spans[k].append((int(begin - words.first[k]), int(stop - words.first[k])))
        for code in np.unique(text * len(self.lengths) + which):
            window = code % len(self.lengths)
            items[code // len(self.lengths)].extend(self.of[self.of_at[window] : self.of_at[window + 1]].tolist())
        return count, spans, [[self.names[x] for x in sorted(set(own))] for own in items]


def _merged(old: list[dict] | None, new: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for begin, stop in sorted([(x["start"], x["end"]) for x in old or []] + new):
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], stop)
        else:
            out.append({"start": begin, "end": stop})
    return out


def _pass(phrases: Phrases, schema: pa.Schema, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0], SHARD_BYTES):
                count, spans, items = phrases.scan(part.column(schema.names[0]))
                if first:
                    own, out = part.columns, ([_merged([], x) for x in spans], items)
                else:
                    own = part.columns[:-3]
                    out = ([_merged(*x) for x in zip(part.columns[-2].to_pylist(), spans, strict=True)], [sorted({*a, *b}) for a, b in zip(part.columns[-1].to_pylist(), items, strict=True)])
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*own, pa.array(count), pa.array(out[0], schema.types[-2]), pa.array(out[1], schema.types[-1])], schema.types, strict=True)], schema=schema)

    return run


def find_passages(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents (text and any other columns) with the benchmark passages in each.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is n consecutive words
    of an item; an item of fewer words, but not none, is one window. New columns, before which columns
    of the same names give way: n_words; spans, the merged hits as word ranges (end exclusive); items,
    the ids found, as sorted strings. Null or empty texts have no words; null and empty items have no
    windows; an item without an id marks words but is not named; items of one id count once; repeated
    rows are each answered; empty tables give empty results or no hits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    keyed = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("text is not null")
    others = [c for c in documents.columns if c not in ("text", "n_words", "spans", "items")]
    out = small_batches(documents).select("text", *others)
    shape = spark.createDataFrame([], _FOUND).schema
    target = type(shape)([*out.schema.fields, *shape.fields])
    paths = [new_path(spark), new_path(spark)] if blocks > 1 else []
    for block in range(blocks):
        items = keyed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # at most about block_chars characters
        out = out.mapInArrow(_pass(Phrases([(x["id"], x["text"]) for x in items], n), to_arrow_schema(target, prefers_large_types=False), block == 0), target)
        if blocks > 1:
            out = stored(out, paths[block % 2])
    return out


def _cut(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0]):
                texts, spans = part.column(0), part.column(part.schema.get_field_index("spans"))
                hit = [k for k, own in enumerate(spans.to_pylist()) if own]
                if hit:
                    words, out = split(texts, ALNUM, lower=True), texts.to_pylist()
                    for k in hit:
                        raw, base, first, done, pieces = out[k].encode(), words.text_at[k], words.first[k], 0, []
                        for span in spans[k].as_py():
                            pieces.append(raw[done : words.starts[first + span["start"]] - base])
                            done = words.ends[first + span["end"] - 1] - base
                        out[k] = b"".join([*pieces, raw[done:]]).decode()
                    texts = pa.array(out, schema.types[0])
                yield pa.RecordBatch.from_arrays([texts.cast(schema.types[0]), *(part.column(name) for name in schema.names[1:])], schema=schema)

    return run


def remove_passages(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """documents without the hit words, from each span's first character to its last; the rest of a text stays.

    A document that has a hit and keeps no word at all goes. n_chars, where there is one, is counted anew.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = ["text", *(c for c in documents.columns if c != "text")]
    found = find_passages(documents, benchmark, n)
    schema = documents.select(*columns).schema
    found = found.where("size(spans) = 0 or aggregate(spans, 0L, (s, x) -> s + x.end - x.start) < n_words")
    out = found.mapInArrow(_cut(to_arrow_schema(schema, prefers_large_types=False)), schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*documents.columns)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document of the table against every item of the benchmark, windows of 10 words."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = find_passages(read("documents").select("doc_id", "text"), read("benchmark"))
    hits = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLE_SQL = {
    "op2_benchmark_decontamination": r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
bw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, md5(array_to_string(w[i:i + 9], ' ')) AS h FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
occ AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.h = md5(array_to_string(dw.w[i:i + dw.n - 1], ' '))),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
}
