"""Substring dedup: matching statistics against compressed FM-indexes of content-routed shards.

Every window of `width` consecutive words is represented by its smallest 8-word hash, its anchor. Equal
windows have equal anchors, so an anchor that occurs in one document only needs no further look, and all
texts around one anchor can meet in one shard. A text around an anchor (a segment) is a run of windows
with that anchor. Per shard, the distinct segments are indexed (BWT in a wavelet matrix, the owners of the
suffixes in a second one, which answers the smallest owner of a suffix range; the suffix order itself is not
kept) and streamed backwards through the index; what is reported are the windows that also
start in a document with a smaller id. Words are matched in the index, but copies are aggregated by hash
before it: of segments with one anchor and one content hash (64 bits each), only the first document's copy
enters, and the others are removed whole; of a crowded anchor's windows with the same two hashes of their
words, the first and the last copy enter, and what they show holds for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._fm import FMIndex, SmallestOwner
from quarry.llm._shared import hot_counts, hot_keys, small_batches, spread_join, stored
from quarry.llm._words import PLAIN, _power_tables, chunks, mix, shingle_hashes, sliding_min, split

#: Words of an anchor; windows in a segment at most; words in a shard's index, about.
ANCHOR, RUN, SHARD_WORDS = 8, 64, 250_000
#: An anchor with more distinct segments is dealt out by single windows instead, two copies of each.
HOT_SEGMENTS = 2000


def _runs(hashes: np.ndarray, text_of: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Start word, words, anchor and content hash of each segment of a chunk."""
    if len(hashes) < width:
        return (np.empty(0, np.int64),) * 4
    low = sliding_min(shingle_hashes(hashes, min(ANCHOR, width)), width - min(ANCHOR, width) + 1)
    at = np.flatnonzero(text_of[: len(low)] == text_of[width - 1 :])
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])
    in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    begin = np.flatnonzero(in_run % RUN == 0)
    start = at[begin]
    n = np.diff(np.append(begin, len(at))) + width - 1
    power, inverse = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return start, n, low[start].view(np.int64), mix((sums[start + n] - sums[start]) * inverse[start]).view(np.int64)


def _segments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"), PLAIN)
                text_of = words.text_of_word()
                start, n, anchor, content = _runs(words.hashes(), text_of, width)
                row = text_of[start] if len(start) else start
                own = [pa.array(anchor), pa.array(content), part.column("doc_id").take(pa.array(row)), part.column("row").take(pa.array(row)), pa.array((start - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(own, names=["anchor", "content", "doc_id", "row", "start", "n"])

    return run


def _windows(width: int):
    """The single windows of the wanted segments, by two hashes of their words; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"), PLAIN)
                hashes = words.hashes()
                h1, h2 = shingle_hashes(hashes, width), shingle_hashes(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), width)
                wanted = part.column("wanted")
                flat = wanted.flatten()
                text_of = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
                start, n, anchor, content = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "anchor", "content"))
                count = n - width + 1
                of = np.repeat(np.arange(len(n)), count)
                at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                begin, row = words.first[text_of[of]] + start[of] + at, pa.array(text_of[of])
                own = [pa.array(h1[begin].view(np.int64)), pa.array(h2[begin].view(np.int64)), pa.array(anchor[of]), pa.array(content[of]), pa.array(at.astype(np.int32)), part.column("doc_id").take(row), part.column("row").take(row), pa.array((start[of] + at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(own, names=["h1", "h2", "anchor", "content", "at", "doc_id", "row", "start"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the wanted segments and single windows."""
    names = ("anchor", "content", "hot")
    for batch in batches:
        for part in chunks(batch):
            words = split(part.column("text"), PLAIN)
            raw = words.data.tobytes()
            wanted = part.column("wanted")
            sizes = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            first = np.repeat(words.first[:-1], sizes) + flat.field("start").to_numpy(zero_copy_only=False)
            last = first + flat.field("n").to_numpy(zero_copy_only=False) - 1
            texts = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True)]
            own = [*(flat.field(c) for c in names), part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), sizes))), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(own, names=[*names, "doc_id", "text"])


def matches(index: FMIndex, smallest: SmallestOwner, line: np.ndarray, first: np.ndarray, n: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, start) of windows that a text with a smaller owner also has; their union covers every such window.

    Each query looks at one window at a time, from its last word backwards. As soon as the suffixes
    that start with what was read all belong to owners not smaller, no window that holds those words
    matches, and the search goes on behind their first one. After a match, the furthest window that
    touches or overlaps it is tried first, then nearer ones.
    """
    last = n - width  # the last window of each query
    at, floor, resume = np.zeros_like(n), np.full_like(n, -1), np.full_like(n, -1)  # floor: -1 when going forward
    read = np.zeros_like(n)
    lo, hi = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    live = np.flatnonzero(last >= 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        place = at[live] + width - 1 - read[live]
        symbol = line[first[live] + place]
        fresh = read[live] == 0
        new_lo, new_hi = index.whole(symbol)
        old = np.flatnonzero(~fresh)
        if len(old):
            new_lo[old], new_hi[old] = index.step(symbol[old], lo[live[old]], hi[live[old]])
        good = new_hi > new_lo
        good[good] = smallest(new_lo[good], new_hi[good]) < owner[live[good]]
        lo[live], hi[live] = new_lo, new_hi
        read[live] += 1
        bad, place = live[~good], place[~good]
        if len(bad):
            read[bad] = 0
            forward = floor[bad] < 0
            one = bad[forward]
            at[one] = place[forward] + 1
            two, where = bad[~forward], place[~forward]
            resume[two] = np.where(resume[two] < 0, where + 1, resume[two])
            at[two] -= 1
            back = two[at[two] == floor[two]]
            at[back], floor[back], resume[back] = resume[back], -1, -1
        full = live[good][read[live[good]] == width]
        if len(full):
            found.append((full, at[full].copy()))
            read[full] = 0
            known = resume[full] >= 0
            one = full[known]
            at[one], floor[one], resume[one] = resume[one], -1, -1
            two = full[~known]
            floor[two] = at[two]
            at[two] = np.where(at[two] >= last[two], last[two] + 1, np.minimum(at[two] + width, last[two]))
        live = live[at[live] <= last[live]]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _shard(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = split(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), PLAIN)
        owner = table.column("doc_id").to_numpy()
        vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        n = np.diff(words.first)
        text_of = words.text_of_word()
        line = np.zeros(len(symbols) + len(n), np.int64)
        line[np.arange(len(symbols)) + text_of] = symbols + 1
        of = np.zeros(len(line), np.int64)
        of[np.arange(len(symbols)) + text_of] = owner[text_of]
        index = FMIndex(line, len(vocabulary) + 1, depth=width)
        smallest, index.order = SmallestOwner(of[index.order]), None
        query, start = matches(index, smallest, line, words.first[:-1] + np.arange(len(n)), n, owner, width)
        of = pa.array(query)
        return pa.table({**{c: table.column(c).take(of) for c in ("anchor", "content", "hot")}, "start": start.astype(np.int32), "stop": (start + width).astype(np.int32)})

    return run


def _kept(schema: pa.Schema):
    """Removes the words in the spans; joins the others by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"), PLAIN)
                total = len(words.starts)
                spans = part.column("spans")
                sizes = np.diff(spans.offsets.to_numpy())
                flat, first = spans.flatten(), np.repeat(words.first[:-1], sizes)
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, first + flat.field("start").to_numpy(zero_copy_only=False), 1)
                np.add.at(change, first + flat.field("stop").to_numpy(zero_copy_only=False), -1)
                keep = np.cumsum(change[:-1]) == 0
                # Each kept word with the byte before it, made a space; the first of a text without.
                begin, end, text_of = words.starts[keep], words.ends[keep], words.text_of_word()[keep]
                size = end - begin + 1
                to = np.concatenate([[0], np.cumsum(size)])
                source = np.repeat(begin - 1 - to[:-1], size) + np.arange(to[-1])
                made = words.data[np.maximum(source, 0)] if len(words.data) else words.data
                made = made.copy()
                made[to[:-1]] = 0x20
                per_text = np.searchsorted(text_of, np.arange(part.num_rows + 1))
                bounds, raw = to[per_text], made.tobytes()
                texts = [raw[a + 1 : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.types[0]), pa.array(n), pa.array(n - np.diff(per_text)), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    return run


def repeated_spans(documents: DataFrame, width: int = 50) -> DataFrame:
    """Word ranges of documents (doc_id, text, row) that are windows of a document with a smaller doc_id: (doc_id, row, spans)."""
    segments = stored(documents.select("doc_id", "row", "text").where("doc_id is not null and text is not null").mapInArrow(_segments(width), "anchor long, content long, doc_id long, row long, start int, n int"))
    shared = segments.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    owned = stored(spread_join(segments, shared, "anchor", "content", hot_keys(segments, "anchor")))
    same_words = F.struct("anchor", "content").alias("words")
    distinct = stored(owned.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("o"), F.count("*").alias("copies")).select("anchor", "content", "o.*", "copies"))
    crowd = stored(distinct.groupBy("anchor").count())
    often = hot_counts(crowd, "anchor")
    hot = stored(crowd.where(F.col("count") > HOT_SEGMENTS).select("anchor"))
    cold = spread_join(distinct, hot, "anchor", "content", often, "left_anti").select("doc_id", "row", "anchor", "content", "start", "n", F.lit(False).alias("hot"))

    def texts(wanted: DataFrame) -> DataFrame:
        own = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*(c for c in wanted.columns if c not in ("doc_id", "row")))).alias("wanted"))
        return documents.select("doc_id", "row", "text").join(own, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")

    # A hot anchor's windows by the hash of their words: however many documents have one, its first and its last copy go to the index.
    windows = stored(texts(spread_join(distinct, hot, "anchor", "content", often).select("doc_id", "row", "anchor", "content", "start", "n")).mapInArrow(_windows(width), "h1 long, h2 long, anchor long, content long, at int, doc_id long, row long, start int"))
    place = F.struct("doc_id", "row", "start")
    twice = stored(windows.groupBy("h1", "h2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("count")).where("x.doc_id < y.doc_id"))
    copies = twice.select(F.explode(F.array("x", "y")).alias("o"), F.col("h1").alias("anchor"), F.col("h2").alias("content")).select("o.doc_id", "o.row", "anchor", "content", "o.start", F.lit(width).alias("n"), F.lit(True).alias("hot"))
    shards = max(1, -(-((cold.agg(F.sum("n")).first()[0] or 0) + 2 * width * twice.count()) // SHARD_WORDS))
    pieces = texts(cold.unionAll(copies)).mapInArrow(_pieces, "anchor long, content long, hot boolean, doc_id long, text string")
    route = F.pmod(F.when(F.col("hot"), F.xxhash64("anchor", "content")).otherwise(F.xxhash64("anchor")), F.lit(shards))
    found = stored(pieces.withColumn("shard", route).groupBy("shard").applyInArrow(_shard(width), "anchor long, content long, hot boolean, start int, stop int"))
    # What the index confirmed holds for each copy in a document after the first.
    window = F.struct("h1", "h2").alias("window")  # one that very many documents have is dealt out
    same = found.where("hot").select(F.col("anchor").alias("h1"), F.col("content").alias("h2")).distinct().join(twice.select("h1", "h2", F.col("x.doc_id").alias("owner")), ["h1", "h2"]).select(window, "owner")
    often = hot_counts(twice.select(window, "count"), "window")
    later = spread_join(windows.withColumn("window", window), same, "window", "doc_id", often).where("doc_id > owner").select("anchor", "content", F.col("at").alias("start"), (F.col("at") + width).alias("stop"))
    ranges = found.where("not hot").select("anchor", "content", "start", "stop").unionAll(later).groupBy("anchor", "content").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    owners = distinct.select("anchor", "content", F.col("doc_id").alias("owner")).join(ranges, ["anchor", "content"], "left").withColumn("words", same_words).drop("anchor", "content")
    often = hot_counts(distinct.select(same_words, F.col("copies").alias("count")), "words")
    moved = F.transform("ranges", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["stop"]).alias("stop")))
    whole = F.array(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))
    covered = spread_join(owned.withColumn("words", same_words), owners, "words", "doc_id", often).withColumn("spans", F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(moved)).where("spans is not null")
    return covered.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(documents: DataFrame, width: int = 50) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_words, n_removed, kept_text.

    Words are [^\\x20\\x09-\\x0D]+; a word goes if a window of `width` words that covers it also starts
    in a document with a smaller doc_id; kept words are joined by one space. Null and empty texts have
    no words. A row without doc_id is neither source nor changed. Repeated rows of one doc_id are one
    document and get the same result; other columns are ignored; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keyed = small_batches(documents).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row"))
    spans = repeated_spans(keyed, width)
    joined = keyed.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"))
    schema = documents.sparkSession.createDataFrame([], "doc_id long, n_words long, n_removed long, kept_text string").schema
    return joined.mapInArrow(_kept(to_arrow_schema(schema)), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 50 words over all documents."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM pos),
owner AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN owner USING (h), range(50) r(k) WHERE first < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text FROM word LEFT JOIN hit USING (doc_id, p) WHERE hit.doc_id IS NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
}
