"""N-gram Jaccard join by parity sketches.

A document's distinct shingles are XOR-hashed into a bit sketch whose length follows its size band. Each
shingle toggles one bit, so the Hamming distance of two sketches is a lower bound of their sets' symmetric
difference, and a sketch cut into parts has at most that many parts that differ. Two sets of n and m
shingles with Jaccard similarity t differ in at most (n + m)(1 - t)/(1 + t) <= n(1 - t)/t shingles. By the
pigeonhole principle they agree on one of the first floor(n(1 - t)/t) + 1 non-zero parts, counted from
either side, so those parts are the join keys; with a few parts more on each side they agree on more, and
a pair must share as many keys as follows from its sizes. Candidates pass the Hamming bound, then the
exact test.

No group is expanded to all its pairs: documents of one key are first compared with a few centres of the
key; what these verified links connect is never compared again, and only members of one key that are
still apart are paired: by counting shared keys where few have a key, tile by tile by their sketches
where many do, without the pairs of tiles within one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import components, components_with, hot_counts, hot_keys, small_batches, spread_join, stored
from quarry.llm._words import PLAIN, chunks, mix, shingle_hashes, split

#: Orders in which a key's centre is chosen; parts beyond those that are needed; members up to which pairs of a
#: key are counted; members of a tile; pairs and bytes of text verified together; ids that may be broadcast.
ORDERS, EXTRA, FEW, TILE, VERIFY_PAIRS, VERIFY_BYTES, BROADCAST_IDS = 2, 3, 64, 512, 2000, 8 << 20, 500_000
#: Documents from which frequent shingles and crowded keys are learned; bits of the table of shingles.
SAMPLE_DOCS, COMMON_BITS = 5000, 1 << 24
#: Sampled documents that make a key crowded; tasks that such a key is dealt to; more centres for keys whose many members are still apart.
CROWDED, SALTS, CENTRES = 25, 32, 8


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words has one shingle."""
    words = split(texts, PLAIN, lower=True)
    hashes = words.hashes()
    grams = shingle_hashes(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = grams[a : b - k + 1] if b - a >= k else shingle_hashes(hashes[a:b], b - a) if b > a else grams[:0]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def _parts(level: int) -> int:
    """Parts of a size band's sketch: as few, hence as telling, as leave enough non-zero ones."""
    return 2 << level if level < 5 else (2 << level) * 9 // 20 if level < 7 else (2 << level) * 5 // 16


def _slots(own: np.ndarray) -> np.ndarray:
    return ((own >> np.uint64(20)) & np.uint64(COMMON_BITS - 1)).astype(np.int64)


def join_keys(own: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each how many of its band there are.

    Any two sets of that similarity share at least one key, and in some band no fewer than the smaller
    of their numbers less the shingles in which they may differ.
    """
    n = len(own)
    if not n:
        return own, own.astype(np.int32)
    slots = _slots(own)
    rare = 1 - ((common[slots >> 3] >> (slots & 7)) & 1)
    level, most = n.bit_length() - 1, n * (100 - percent) // percent
    out, counts = [], []
    for band in (level, level + 1) if n * 100 // percent >= 2 << level else (level,):
        seed = mix(np.array([band + 1], np.uint64))[0]
        sketch = np.zeros(_parts(band), np.uint64)
        place = ((own >> np.uint64(6)) % np.uint64(len(sketch))).astype(np.int64)
        np.bitwise_xor.at(sketch, place, mix(own + seed))
        count = np.bincount(place, minlength=len(sketch))
        part = np.flatnonzero(count)
        if len(part) <= most:  # too few parts to be sure: sets of which both are so thin share a shingle
            out.append(mix(own ^ seed ^ np.uint64(0x5555)))
            counts.append(np.zeros(n, np.int32))
        # First the parts with most shingles that are not frequent, then the fullest: what lies in a part that
        # two sets agree on is the same in both, so the order is one that they share, and rare keys lead it.
        full = np.bincount(place, rare, len(sketch))[part] * (n + 1) + count[part]
        part = part[np.argsort(-full, kind="stable")][: most + 1 + EXTRA]
        out.append(mix(sketch[part] + part.astype(np.uint64)))
        counts.append(np.full(len(part), len(part), np.int32))
    return np.concatenate(out), np.concatenate(counts)


def compact_sketch(own: np.ndarray) -> bytes:
    """The parity sketch as bits, two to four times as many as shingles; XOR of its halves is the shorter sketch."""
    bits = max(64, 4 << (max(1, len(own)).bit_length() - 1))
    return np.packbits(np.bincount(((own >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)[:bits] & 1, bitorder="little").tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _profiles(k: int):
    """One row per document: size, 128-bit hash of the set, bytes of the text, compact sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), k)
                total = lambda x: int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([total(x) for x in sets], pa.int64()), pa.array([total(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))) for x in sets], pa.int64()), pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()), pa.array([compact_sketch(x) if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "size", "sketch"],
                )

    return run


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))], names=["gram"])

    return run


def _sample(documents: DataFrame) -> DataFrame:
    ids = documents.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    return documents.where("text is not null").join(F.broadcast(ids), "doc_id")  # at most SAMPLE_DOCS ids


def frequent_shingles(sample: DataFrame, k: int) -> np.ndarray:
    """A bit table of the shingles that two of a bounded sample of documents have. It only orders keys; no result depends on it."""
    grams = sample.select("text").mapInArrow(_grams(k), "gram long")
    twice = grams.groupBy("gram").count().where("count > 1").select(F.shiftrightunsigned("gram", 20).bitwiseAND(COMMON_BITS - 1).cast("int").alias("slot")).distinct()
    table = np.zeros(COMMON_BITS, bool)
    table[twice.toArrow().column("slot").to_numpy()] = True
    return np.packbits(table, bitorder="little")


def _keyed(k: int, percent: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # copies within a task bring nothing new: their first stands for them
        for batch in batches:
            for part in chunks(batch):
                ids, sizes, keys, counts, own_ids = part.column("doc_id").to_numpy(), [], [], [], []
                for doc, own in zip(ids.tolist(), shingle_sets(part.column("text"), k), strict=True):
                    if len(own) and (mark := (int(own.sum(dtype=np.uint64)), len(own))) not in done:
                        done.add(mark)
                        found, count = join_keys(own, percent, common)
                        keys.append(found)
                        counts.append(count)
                        own_ids.append(np.full(len(found), doc))
                        sizes.append(np.full(len(found), len(own), np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own_ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts))], names=["key", "doc_id", "n", "m"])

    return run


def _within_bound(percent: int):
    """Pairs whose sketches differ in no more bits than linked sets of their sizes may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) * (100 + percent) <= (n + m) * (100 - percent))
            yield batch.select(["a", "b", "wa", "wb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(percent: int):
    """Of pairs of tiles of keys: pairs of different components within the Hamming bound."""

    def run(table: pa.Table) -> pa.Table:
        key, s, t, tile, doc, part, n = (table.column(c).to_numpy() for c in ("key", "s", "t", "tile", "doc_id", "component", "n"))
        sketches = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        width = np.array([len(x) for x in sketches])
        by = np.lexsort((tile, t, s, key))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[by]) != 0) | (np.diff(s[by]) != 0) | (np.diff(t[by]) != 0), [True]]))
        out: set[tuple[int, int]] = set()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows = by[a:b]
            left, right = rows[tile[rows] == s[rows[0]]], rows[tile[rows] == t[rows[0]]]
            for u in np.unique(width[left]):
                for v in np.unique(width[right]):
                    w = min(u, v)  # folded to the shorter of the two widths
                    x, y = left[width[left] == u], right[width[right] == v]
                    xs, ys = (np.array([_folded(sketches[r], w) for r in own]) for own in (x, y))
                    for k, r in enumerate(x):
                        fit = (part[y] != part[r]) & (100 * np.minimum(n[y], n[r]) >= percent * np.maximum(n[y], n[r]))
                        near = np.flatnonzero(fit)
                        if len(near):
                            apart = np.bitwise_count(ys[near] ^ xs[k]).sum(axis=1, dtype=np.int64)
                            for q in y[near[apart * (100 + percent) <= (n[y[near]].astype(np.int64) + n[r]) * (100 - percent)]]:
                                out.add((min(int(doc[r]), int(doc[q])), max(int(doc[r]), int(doc[q]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _tiled(members: DataFrame) -> DataFrame:
    """Members (key, doc_id, component) with a tile and the pairs (s, t) of tiles it is compared in.

    A component of TILE members of a key or more has tiles of its own, never paired with one another; the
    members of smaller ones share the first tiles of the key, which are paired with all.
    """
    sizes = stored(members.groupBy("key", "component").agg(F.count("*").alias("own")))
    shared = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("own") < TILE, F.col("own")).otherwise(0)) / TILE).cast("int").alias("shared"), F.sum(F.when(F.col("own") >= TILE, F.ceil(F.col("own") / TILE)).otherwise(0)).cast("int").alias("alone"))
    # At most one row of a key for every TILE of its members is numbered.
    before = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.where(F.col("own") >= TILE).withColumn("count", F.ceil(F.col("own") / TILE).cast("int")).withColumn("from", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("int")).select("key", "component", "count", "from")
    at = sizes.select("key", "component").join(large, ["key", "component"], "left").join(shared, "key")
    at = at.select("key", "component", "shared", F.coalesce(F.col("from") + F.col("shared"), F.lit(0)).alias("from"), F.coalesce("count", "shared").alias("count"), (F.col("shared") + F.col("alone")).alias("tiles"), F.col("count").isNotNull().alias("pure"))
    group = F.struct("key", "component").alias("group")
    members = members.withColumn("group", group)
    own = spread_join(members, at.withColumn("group", group).drop("key", "component"), "group", "doc_id", hot_keys(members, "group")).drop("group")
    own = own.withColumn("tile", (F.col("from") + F.pmod(F.xxhash64("doc_id"), "count")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: ~F.col("pure") | (o < F.col("from")) | (o >= F.col("from") + F.col("count")))
    return own.withColumn("pairs", F.transform(others, lambda o: F.struct(F.least("tile", o).alias("s"), F.greatest("tile", o).alias("t"))))


def _exact(k: int, percent: int):
    """Verifies (centre, member) pairs: rows (a, salt, member, text); the centre comes as a member too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # A group's texts are split a chunk at a time: the working arrays take many times a text's bytes.
        sets = [own for batch in table.to_batches() for part in chunks(batch) for own in shingle_sets(part.column("text"), k)]
        groups: dict[tuple[int, int], list[int]] = {}
        for row, where in enumerate(zip(table.column("a").to_pylist(), table.column("salt").to_pylist(), strict=True)):
            groups.setdefault(where, []).append(row)
        member, out = table.column("member").to_pylist(), set()
        for (a, _), rows in groups.items():
            for x in (r for r in rows if member[r] == a):
                for y in (r for r in rows if member[r] != a):
                    n, m = len(sets[x]), len(sets[y])
                    both = np.sort(np.concatenate([sets[x], sets[y]]))
                    common = int((both[1:] == both[:-1]).sum())
                    if n and m and 100 * common >= percent * (n + m - common):
                        out.add((a, member[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _verified(documents: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b, and the bytes wa and wb of their texts) whose sets are similar enough. A centre with many or long partners is split by salts."""
    pairs = stored(pairs)
    per_a = stored(pairs.groupBy("a").agg(F.count("*").alias("count"), F.max("wa").alias("wa"), F.sum("wb").alias("wb"), F.greatest(F.ceil(F.count("*") / 128), F.ceil(F.sum("wb") / VERIFY_BYTES)).alias("salts")))
    count, size = per_a.agg(F.sum("count"), F.sum(F.col("wb") + F.col("wa") * F.col("salts"))).first()
    if not count:
        return pairs.select("a", "b")
    buckets = max(1, -(-count // VERIFY_PAIRS), -(-size // (2 * VERIFY_BYTES)))
    salted = spread_join(pairs.select("a", "b"), per_a.select("a", F.col("salts").alias("n")), "a", "b", hot_counts(per_a, "a")).withColumn("salt", F.pmod(F.xxhash64("b"), "n"))
    members = stored(salted.select("a", "salt", F.col("b").alias("doc_id")).unionAll(salted.select("a", "salt", F.col("a").alias("doc_id")).distinct()))
    ids = members.select("doc_id").distinct()
    if 2 * count <= BROADCAST_IDS:  # a small id set goes to the documents; otherwise both are shuffled
        ids = F.broadcast(ids)
    texts = documents.join(ids, "doc_id", "left_semi").distinct()
    often = hot_counts(per_a.select(F.col("a").alias("doc_id"), F.col("salts").alias("count")), "doc_id")  # a centre is there once a salt
    rows = spread_join(members, texts, "doc_id", "salt", often).select("a", "salt", F.col("doc_id").alias("member"), "text", F.pmod(F.xxhash64("a", "salt"), F.lit(buckets)).alias("bucket"))
    return stored(rows.groupBy("bucket").applyInArrow(_exact(k, percent), "a long, b long"))


def similarity_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds the distinct shingles of k words, of
    fewer words the whole sequence; without words or text it is empty and linked with nothing. Two rows
    link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable.
    Rows of one doc_id are one node; without doc_id a row links with nothing and component_id is null.
    Other columns are ignored; an empty table gives no rows.
    """
    documents = small_batches(documents).select(F.col("doc_id").cast("long"), "text")
    profiles = stored(documents.mapInArrow(_profiles(k), "doc_id long, n long, h1 long, h2 long, size long, sketch binary"))
    nodes = profiles.where("doc_id is not null and n > 0")
    same = F.struct("n", "h1", "h2").alias("same")
    classes = stored(nodes.groupBy(same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("count")).where("first < last").drop("last"))
    often = hot_counts(classes, "same")
    copies = stored(spread_join(nodes.select("doc_id", same), classes.drop("count"), "same", "doc_id", often).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct())
    sample = _sample(documents)
    keys = _keyed(k, percent, frequent_shingles(sample, k))
    shape = "key long, doc_id long, n int, m int"
    keyed = documents.where("doc_id is not null and text is not null").mapInArrow(keys, shape)
    # Keys of many sampled documents are dealt out; their number is bounded by the sample, and what is missed costs time only.
    crowded = stored(sample.mapInArrow(keys, shape).groupBy("key").agg(F.count("*").alias("crowd")).where(F.col("crowd") >= CROWDED))
    keyed = keyed.join(F.broadcast(crowded), "key", "left").withColumn("salt", F.when(F.col("crowd").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    # The first of a key, in one of a few orders, is its centre; of a crowded key it is found by an aggregate.
    turn = F.xxhash64("doc_id", F.col("key").bitwiseAND(ORDERS - 1))
    in_key = Window.partitionBy("key", "salt").orderBy(turn, "doc_id")
    centre = F.when(F.col("crowd").isNull(), F.first(F.struct("doc_id", "n")).over(in_key))
    more = F.lead("doc_id").over(in_key).isNotNull()
    shared = keyed.withColumn("centre", centre).withColumn("more", more).where("crowd is not null or centre.doc_id <> doc_id or more")
    shared = stored(shared.select("key", "doc_id", "n", "m", F.col("centre.doc_id").alias("c"), F.col("centre.n").alias("cn"), "crowd"))
    # A few more centres of a crowded key, for what its centre leaves apart.
    others = [F.min_by(F.struct("doc_id", "n"), F.struct(F.xxhash64("doc_id", F.lit(ORDERS + k)), "doc_id")) for k in range(CENTRES)]
    centres = stored(shared.where("crowd is not null").groupBy("key").agg(F.min_by(F.struct("doc_id", "n"), F.struct(turn, "doc_id")).alias("centre"), F.array(*others).alias("more")))  # one row of each crowded key
    one = copies.select(F.col("a").alias("id"), F.col("b").alias("first"))  # a copy's first document stands for it

    def first_of(df: DataFrame, column: str) -> DataFrame:
        return df.join(one, F.col(column) == one["id"], "left").withColumn(column, F.coalesce("first", column)).drop("id", "first")

    fits = f"100 * least(n, cn) >= {percent} * greatest(n, cn)"
    star = shared.join(F.broadcast(centres.select("key", "centre")), "key", "left").select("doc_id", "n", F.coalesce("c", "centre.doc_id").alias("c"), F.coalesce("cn", "centre.n").alias("cn"))
    # A document meets the others of its most crowded key only; who shares more keys with it would be met many times.
    once = shared.where("crowd is not null").groupBy("doc_id").agg(F.max_by(F.struct("key", "n"), F.struct("crowd", "key")).alias("x")).select("doc_id", "x.*")
    met = once.join(F.broadcast(centres.select("key", "more")), "key").select("doc_id", "n", F.explode("more").alias("c")).select("doc_id", "n", F.col("c.doc_id").alias("c"), F.col("c.n").alias("cn"))
    star = star.unionAll(met).where(f"c <> doc_id and {fits}").select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct()
    star = first_of(first_of(star, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketches = stored(nodes.select("doc_id", "sketch", "n", "size").distinct())
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("size").alias(f"w{x}"))

    def within(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        one = spread_join(pairs, side("a"), "a", "b", hot_keys(pairs, "a"))
        both = spread_join(one, side("b"), "b", "a", hot_keys(pairs, "b"))
        return both.select("a", "b", "sa", "sb", "na", "nb", "wa", "wb").mapInArrow(_within_bound(percent), "a long, b long, wa long, wb long")

    links = copies.unionAll(_verified(documents, within(star), k, percent))
    found = stored(components(links))
    # Members of one key that are still apart.
    members = stored(first_of(shared.select("key", "doc_id", "n", "m", F.col("crowd").isNotNull().alias("met")), "doc_id").distinct())
    hot = crowded.select("key", F.lit(SALTS).alias("salts"))

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        rows = stored(rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x < y").select("key", "members")
        return stored(spread_join(rows, mixed, "key", "doc_id", hot))

    rest = apart(members, found)
    crowd = rest.where((F.col("members") > TILE) & ~F.col("met"))
    if crowd.limit(1).count():  # keys that the sample missed: each is compared with a few more centres of its key, not with all others
        others = [F.min_by(F.struct("doc_id", "n", "component"), F.struct(F.xxhash64("doc_id", F.lit(ORDERS + k)), "doc_id")) for k in range(CENTRES)]
        more = crowd.groupBy("key").agg(F.array(*others).alias("c"))
        once = stored(crowd.groupBy("doc_id").agg(F.max_by(F.struct("key", "n", "component"), F.struct("members", "key")).alias("x")).select("doc_id", "x.*"))
        met = spread_join(once, more, "key", "doc_id", hot).select("doc_id", "n", "component", F.explode("c").alias("c")).where("component <> c.component").select("doc_id", "n", F.col("c.doc_id").alias("c"), F.col("c.n").alias("cn"))
        met = met.where(fits).select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct()
        found = stored(components_with(found, _verified(documents, within(met), k, percent)))
        rest = apart(rest.drop("component", "members"), found)
    few = rest.where(F.col("members") <= FEW)
    left, right = (few.select("key", *(F.col(c).alias(f"{c}{x}") for c in ("doc_id", "n", "m", "component"))) for x in "ab")
    pairs = left.join(right, "key").where(f"doc_ida < doc_idb and componenta <> componentb and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = pairs.groupBy(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")).agg(F.count("*").alias("common"), F.min(F.least("ma", "mb") - F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent))).alias("least"))
    tiled = _tiled(stored(rest.where(F.col("members") > FEW)))
    dealt = tiled.join(sketches.select("doc_id", "sketch"), "doc_id").select("key", "doc_id", "component", "n", "sketch", "tile", F.explode("pairs").alias("p")).select("*", "p.s", "p.t").drop("p")
    near = dealt.groupBy("key", "s", "t").applyInArrow(_apart(percent), "a long, b long")  # two tiles at most
    late = within(pairs.where("common >= least").select("a", "b").unionAll(near).distinct())
    late = _verified(documents, late, k, percent)
    if late.limit(1).count():
        found = components_with(found, late)
    found = found.withColumnRenamed("node", "doc_id")
    return profiles.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, as it came; rows without doc_id or words stay."""
    found = similarity_components(documents, k, percent)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, shingles of five words, similarity 0.8 or more."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE_SQL = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM pos),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c.m AS component_id FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
}
