"""Quality rules: simple counts of a text, and the perplexity of its characters under a model of its language.

The model is a modified Kneser-Ney model of character n-grams. Spark counts them over every distinct line of all
documents that pass the counts, so neither copies nor boilerplate teach it more than once, and derives the lower
orders, discounts, probabilities and back-off weights by grouping and joining. A language's n-grams that make at least
a millionth of its characters are kept as arrays of 64-bit hashes in order, with their log-probabilities beside them; a
task scores a batch of texts by binary search. Windows of a text that are not among them meet the whole model in joins,
so no n-gram is left out. Each language has a band around the median bits of its documents, as wide as their spread
asks for; documents above or below it are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _words
from quarry.llm._shared import hot_keys, small_batches, spread_join, stored

#: Characters of the longest n-gram, and the share of a language's characters that an n-gram in the tasks' arrays makes.
ORDER, SHARE = 4, 1e-6
#: Base rules: fewest words, most repeated words in percent. A document teaches if it also has at most this percent of symbols to words.
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS = 50, 50, 2
#: Width of the bands in robust standard deviations, and their least widths in bits a character: below the median, above it.
SPREAD, LEAST_BELOW, LEAST_ABOVE = 8.0, 1.0, 1.25
#: n-grams of the languages that are scored in one pass over the documents; bins of a bit for medians.
BLOCK, BINS = 8_000_000, 1024
_SYMBOLS = _words._table(lambda b: b in b"#*$%&|<>")
_LINE = _words._table(lambda b: b != 0x0A)
_KIND = np.zeros(128, np.uint8)
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 1, 2
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a chunk.

    Words are `[^\\x20\\x09-\\x0D]+`; word_chars are their code points; n_symbols counts `#*$%&|<>`; n_dup_lines the
    lines (split at \\n) with a word that equal an earlier line; n_repeat_words the words in windows of three that the
    text holds twice or more, the first included. Words and lines are compared by 64-bit hashes.
    """
    words, texts_n = _words.split(texts, _words.PLAIN), len(texts)
    chars, of = words.chars_before(), words.text_of_word()
    per_text = lambda index, weights=None: np.bincount(index, weights, minlength=texts_n).astype(np.int64)
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOLS[words.data], out=symbols[1:])
    hashes, repeated = words.hashes(), np.zeros(len(of), bool)
    if len(of) > 2:
        at = np.flatnonzero(of[:-2] == of[2:])
        keys = _words.mix(_words.shingle_hashes(hashes, 3)[at] ^ _words.mix(of[at].astype(np.uint64)))
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        for k in range(3):
            repeated[at[n[back] > 1] + k] = True
    lines = _words.split(texts, _LINE)
    spoken = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
    line_of = lines.text_of_word()[spoken]
    keys = _words.mix(lines.hashes()[spoken] ^ _words.mix(line_of.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return {
        "n_words": np.diff(words.first), "word_chars": per_text(of, (chars[words.ends] - chars[words.starts]).astype(np.float64)), "n_symbols": symbols[words.text_at[1:]] - symbols[words.text_at[:-1]],
        "n_dup_lines": per_text(line_of[again]), "n_repeat_words": per_text(of[repeated]),
    }


def _verdicts(stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rules, and which teach the model."""
    failed = (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])
    return failed, ~failed & (100 * stats["n_symbols"] <= MOST_SYMBOLS * stats["n_words"])


def _teaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _words.chunks(batch):
            yield part.filter(pa.array(_verdicts(text_stats(part.column("text")))[1]))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, each text between \\n, and the text of each: white space in a line is one space, lines without words are left out."""
    texts = [x or "" for x in texts]
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.append(0, np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts]))  # the end of a line is its text's
    kind = np.where(codes < 128, _KIND[np.minimum(codes, 127)], 0)
    for gone in (lambda k: (k[1:] == 1) & (k[:-1] == 1), lambda k: (k[1:] == 1) & (k[:-1] == 2), lambda k: (k[1:] == 2) & (k[:-1] == 2)):
        keep = np.ones(len(kind), bool)
        keep[1:] = ~gone(kind)
        codes, of, kind = codes[keep], of[keep], kind[keep]
        if len(kind) > 1:  # a space before a line's end goes too
            keep = np.ones(len(kind), bool)
            keep[:-1] = ~((kind[:-1] == 1) & (kind[1:] == 2))
            codes, of, kind = codes[keep], of[keep], kind[keep]
    return np.where(kind == 1, np.uint32(32), codes), of


def _windows(codes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many characters of its line stand up to each place, its \\n before it included; and hashes of the 1 to `order` characters that end there."""
    place = np.arange(len(codes))
    start = np.maximum.accumulate(np.where(codes == 10, place, 0))
    start[1:] = np.where(codes[1:] == 10, start[:-1], start[1:])  # a \n ends its line, and begins the next
    known, own = place - start + 1, _words.mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    hashes = [own]
    for n in range(1, order):
        longer = hashes[-1].copy()
        longer[n:] = _words.mix(hashes[-1][n:] * np.uint64(0x8CB92BA72F3D8DD7) + own[:-n])
        hashes.append(longer)
    return known, hashes


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of short lines put together to about a chunk, so that an n-gram is counted once for many lines."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("line"))).as_py() or 0
        if size >= _words.CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values' distinct ones: a place of each, which of them each value is, and how often each is there."""
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[which] = np.arange(len(values))
    return place, which, count


def _counted(order: int):
    """lang, gram, n: how often each n-gram of full length, or from a line's start, ends in the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            for part in _words.chunks(batch, "line"):
                langs = part.column("lang").dictionary_encode()
                index, lines = langs.indices.to_numpy(), part.column("line").to_pylist()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    codes, _ = _codes([lines[i] for i in np.flatnonzero(index == k)])
                    known, hashes = _windows(codes, order)
                    size = np.minimum(known, order)
                    size[0] = 0
                    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    for n in range(2, order + 1):
                        at = np.flatnonzero(size == n)
                        if len(at):
                            own, count = _places(hashes[n - 1][at])[::2]
                            ends = at[own] + 1
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ends), pa.string()), pa.array([text[e - n : e] for e in ends.tolist()], pa.string()), pa.array(count)], names=["lang", "gram", "n"])

    return run


def language_model(documents: DataFrame, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """lang, size, gram, logp, backoff, raw, characters: a modified Kneser-Ney model of the characters of each language, in bits.

    documents: lang, text. A document that fails the base rules or is full of symbols teaches nothing; every other
    line counts once, however many documents have it. A null lang is a language of its own. `\\n` begins and ends
    lines. Every n-gram stays; with a `share`, only those that make at least so much of their language's characters,
    and the mass of the others goes to the back-off weights. The empty gram holds the probability of a
    character that no line has. raw: how often an n-gram is there; characters: of its language.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    texts = documents.select(lang, F.col("text").cast("string").alias("text")).where("text is not null")
    lines = small_batches(texts).mapInArrow(_teaching, "lang string, text string").select("lang", F.explode(F.split("text", "\n")).alias("line")).distinct()
    counted = lines.mapInArrow(_counted(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted.withColumn("size", F.length("gram")))
    # Raw counts, and adjusted ones: of how many characters stand before a shorter gram; at a line's start the raw count.
    tables = {order: counted.where(F.col("size") == order).select("lang", "gram", F.col("n").alias("raw"), F.col("n").alias("adj"))}
    for n in range(order - 1, 0, -1):
        shorter = tables[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("adj"))
        starts = counted.where(F.col("size") == n).select("lang", "gram", F.col("n").alias("raw"), F.col("n").alias("adj"))
        tables[n] = stored(shorter.unionAll(starts).groupBy("lang", "gram").agg(F.sum("raw").alias("raw"), F.sum("adj").alias("adj")))
    grams = tables[1].withColumn("size", F.lit(1))
    for n in range(2, order + 1):
        grams = grams.unionAll(tables[n].withColumn("size", F.lit(n)))
    t = [F.count_if(F.col("adj") == k).alias(f"t{k}") for k in range(1, 5)]
    rest = lambda k: F.lit(float(k)) - (k + 1) * F.col("t1") / (F.col("t1") + 2 * F.col("t2")) * F.col(f"t{k + 1}") / F.col(f"t{k}")
    # With too few grams of a count the discount is half of the largest that it could be.
    discount = [F.when((F.col(f"t{k}") > 0) & (F.col("t1") > 0), F.least(F.greatest(rest(k), F.lit(0.05)), F.lit(k - 0.05))).otherwise(k / 2).alias(f"d{k}") for k in (1, 2, 3)]
    totals = tables[1].groupBy("lang").agg(F.sum("raw").alias("characters"), F.count("*").alias("kinds"))
    facts = stored(grams.groupBy("lang", "size").agg(*t).select("lang", "size", *discount).join(totals, "lang"))  # `order` rows per language
    model, below = None, None
    for n in range(1, order + 1):
        context = F.substring("gram", 1, n - 1).alias("context")
        own = tables[n].join(facts.where(F.col("size") == n), "lang")
        cut = F.col("adj") - F.when(F.col("adj") == 1, F.col("d1")).when(F.col("adj") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.select("lang", "gram", context, "adj", cut.alias("cut"), (F.col("raw") >= F.col("characters") * share).alias("stays"), "kinds", "raw", "characters")
        sums = own.groupBy("lang", "context").agg(F.sum("adj").alias("total"), F.sum(F.when(F.col("stays"), F.col("cut")).otherwise(0.0)).alias("given"))
        own = own.where("stays").join(sums, ["lang", "context"]).withColumn("left", 1 - F.col("given") / F.col("total"))
        if n == 1:
            unseen = F.col("left") / (F.col("kinds") + 1)
            now = own.select("lang", "gram", (F.col("cut") / F.col("total") + unseen).alias("p"), "raw", "characters")
            model = own.groupBy("lang").agg(F.first(unseen).alias("p"), F.first("characters").alias("characters")).select("lang", F.lit(0).alias("size"), F.lit("").alias("gram"), "p", F.col("characters").alias("raw"), "characters")
        else:
            own = own.withColumn("gram_below", F.substring("gram", 2, n - 1)).join(below.select("lang", F.col("gram").alias("gram_below"), F.col("p").alias("p_below")), ["lang", "gram_below"])
            now = own.select("lang", "gram", (F.col("cut") / F.col("total") + F.col("left") * F.col("p_below")).alias("p"), "raw", "characters")
            weights = sums.select("lang", F.col("context").alias("gram"), (1 - F.col("given") / F.col("total")).alias("w"))
            below = below.join(weights, ["lang", "gram"], "left")
            model = model.withColumn("w", F.lit(None).cast("double")) if n == 2 else model
            model = model.unionByName(below.select("lang", F.lit(n - 1).alias("size"), "gram", "p", "raw", "characters", "w"))
        below = stored(now)
    model = model.unionByName(below.select("lang", F.lit(order).alias("size"), "gram", "p", "raw", "characters", F.lit(None).cast("double").alias("w")))
    return stored(model.select("lang", "size", "gram", F.log2("p").alias("logp"), F.coalesce(F.log2(F.greatest("w", F.lit(1e-9))), F.lit(0.0)).alias("backoff"), "raw", "characters"))


def _arrays(table: pa.Table, order: int) -> dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of each language and size, hashes in order, log-probabilities and back-off weights; at 0 the unseen character's."""
    out: dict[str, list] = {}
    langs = table.column("lang").combine_chunks().dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = table.filter(pc.equal(langs.indices, k))
        sizes = []
        for n in range(order + 1):
            rows = own.filter(pc.equal(own.column("size"), n))
            logp, backoff = rows.column("logp").to_numpy(), rows.column("backoff").to_numpy()
            if n:
                codes = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                hashes = _gram_hashes(codes)
                place = np.argsort(hashes)
                sizes.append((hashes[place], logp[place].astype(np.float32), backoff[place].astype(np.float32)))
            else:
                sizes.append((None, logp.astype(np.float32), None))
        out[lang] = sizes
    return out


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """As _windows has them: of rows of characters, last one first."""
    own = _words.mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = own[:, -1]
    for n in range(1, codes.shape[1]):
        out = _words.mix(out * np.uint64(0x8CB92BA72F3D8DD7) + own[:, -1 - n])
    return out


def bits(codes: np.ndarray, of: np.ndarray, n_texts: int, sizes: list, order: int, rare: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bits and characters of each text, ends of lines included, and with `rare` its windows that the arrays do not hold: texts, windows, how often; their bits are not in the first."""
    known, hashes = _windows(codes, order)
    known[0] = 0
    # A place's probability is that of its longest n-gram, so each of those is looked up once.
    longest = hashes[order - 1].copy()
    for n in range(1, order):
        at = np.flatnonzero(known == n)
        longest[at] = _words.mix(hashes[n - 1][at] + np.uint64(n))
    place, back_to, _ = _places(longest)
    length, back = known[place], np.zeros(len(place))
    open_, whole = length > 0, np.zeros(len(place), bool)  # whole: found as long as it can be
    logs = np.full(len(place), sizes[0][1][0] if len(sizes[0][1]) else np.float32(-20), np.float64)

    def found(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, wanted = sizes[n][0], hashes[n - 1][at]
        if not len(table):
            return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        spot = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return spot, table[spot] == wanted

    for n in range(order, 0, -1):
        due = np.flatnonzero(open_ & (length >= n))
        spot, hit = found(n, place[due])
        at = due[hit]
        whole[at] = (n == order) | (length[at] == n)
        logs[at] = sizes[n][1][spot[hit]] + back[at]
        open_[at] = False
        if n > 1:  # the context, the n - 1 characters before the last, may have a weight
            due = due[~hit]
            spot, hit = found(n - 1, place[due] - 1)
            back[due[hit]] += sizes[n - 1][2][spot[hit]]
    logs[open_] += back[open_]
    out = logs[back_to]
    told = known > 0
    windows: tuple = (np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64))
    if rare:
        late = np.flatnonzero(told & ~whole[back_to])
        pairs, many = np.unique(of[late] * len(place) + back_to[late], return_counts=True)
        at, which = np.unique(pairs % len(place), return_inverse=True)
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = place[at] + 1
        grams = [text[a:b] for a, b in zip((ends - np.minimum(length[at], order)).tolist(), ends.tolist(), strict=True)]
        windows = pairs // len(place), pa.array(grams, pa.string()).take(pa.array(which)), many
        out[late] = 0.0
    return np.bincount(of[told], -out[told], minlength=n_texts), np.bincount(of[told], minlength=n_texts), windows


def _lists(late: list[pa.Table], n_texts: int) -> pa.ListArray:
    """The windows (row, gram, n) of each text as a list."""
    if not late:
        late = [pa.table({"row": pa.array([], pa.int64()), "gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})]
    table = pa.concat_tables(late).sort_by("row").combine_chunks()
    at = np.searchsorted(table.column("row").to_numpy(), np.arange(n_texts + 1))
    pairs = [pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks else pa.array([], t) for c, t in (("gram", pa.string()), ("n", pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(pairs, ["gram", "n"]))


_SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, teaches boolean, total double, chars long, open array<struct<gram:string,n:long>>"


def _scored(model: dict, others: set, rare: set, order: int):
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array([x in model or x in others for x in batch.column("lang").to_pylist()], pa.bool_()))
            for part in _words.chunks(own):
                langs, texts = np.array(part.column("lang").to_pylist(), object), part.column("text").to_pylist()
                stats, total, chars, late = text_stats(part.column("text")), np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
                for lang in set(langs) & model.keys():
                    rows = np.flatnonzero(langs == lang)
                    codes, of = _codes([texts[i] for i in rows])
                    total[rows], chars[rows], (own, grams, many) = bits(codes, of, len(rows), model[lang], order, lang in rare)
                    late.append(pa.table({"row": rows[own], "gram": grams, "n": many}))
                failed, teaches = _verdicts(stats)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *(pa.array(stats[x]) for x in STATS), pa.array(failed), pa.array(teaches), pa.array(total), pa.array(chars), _lists(late, len(texts))], names=names)

    return run


def _looked_up(windows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """lang, gram, logp of distinct windows (lang, gram) by the whole model: of the longest n-gram that ends a window, after the weights of the contexts that are longer."""
    out = windows.withColumns({"cur": F.col("gram"), "back": F.lit(0.0), "logp": F.lit(None).cast("double")})
    table = lambda n, key, value: model.where(F.col("size") == n).select("lang", F.col("gram").alias(key), F.col(value).alias("_v"))
    for n in range(order, 0, -1):
        due = F.col("logp").isNull() & (F.length("cur") == n)
        out = out.join(table(n, "cur", "logp"), ["lang", "cur"], "left").withColumn("logp", F.coalesce("logp", F.when(due, F.col("_v") + F.col("back")))).drop("_v")
        if n > 1:
            out = out.withColumn("_c", F.when(due, F.substring("cur", 1, n - 1))).join(table(n - 1, "_c", "backoff"), ["lang", "_c"], "left")
            out = out.withColumn("back", F.col("back") + F.coalesce("_v", F.lit(0.0))).drop("_v", "_c")
        out = out.withColumn("cur", F.when(due, F.substring("cur", 2, n)).otherwise(F.col("cur")))
    unseen = model.where("size = 0").select("lang", F.col("logp").alias("_v"))  # a row per language
    return out.join(F.broadcast(unseen), "lang", "left").select("lang", "gram", F.coalesce("logp", F.col("_v") + F.col("back")).alias("logp"))


def scores(documents: DataFrame, model: DataFrame, order: int = ORDER, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """doc_id, lang, STATS, base_failed, teaches and bits of each document; stored. bits is null where the language has no model.

    The driver sends the arrays of at most `block` n-grams and one more language to the tasks, of n-grams that make at
    least `share` of their language's characters (1/share of each size at most); with more, the documents are read once
    for each block of languages. What a text has beside them is looked up in the whole model by joins.
    """
    named = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    common = F.col("raw") >= F.col("characters") * share
    sizes = named.groupBy("lang").agg(F.lit(1).alias("one")).join(model.groupBy("lang").agg(F.count_if(common).alias("count"), F.count_if(~common).alias("others")), "lang", "left")
    running = F.sum(F.coalesce("count", F.lit(0)) + 1).over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row per language
    blocks = stored(sizes.select("lang", F.floor((running - 1) / block).alias("block"), F.coalesce(F.col("others") > 0, F.lit(False)).alias("rare")))
    out, any_rare = None, False
    for number in sorted(x["block"] for x in blocks.select("block").distinct().collect()):
        langs = {x["lang"]: x["rare"] for x in blocks.where(F.col("block") == number).select("lang", "rare").collect()}  # at most `block`
        rare = {x for x, has in langs.items() if has}
        any_rare = any_rare or bool(rare)
        table = model.where(common).join(F.broadcast(blocks.where(F.col("block") == number).select("lang")), "lang").toArrow()
        part = small_batches(named).mapInArrow(_scored(_arrays(table, order), set(langs), rare, order), _SCORED)
        out = part if out is None else out.unionAll(part)
    kept = [x.split()[0] for x in _SCORED.split(", ")[:-3]]
    bits_ = F.when(F.col("chars") > 1, F.col("total") / F.col("chars")).alias("bits")
    if not any_rare:
        return stored((out if out is not None else named.sparkSession.createDataFrame([], _SCORED)).select(*kept, bits_))
    out = stored(out.withColumn("_row", F.monotonically_increasing_id()))
    late = out.select("_row", "lang", F.explode("open").alias("x")).select("_row", F.struct("lang", "x.gram").alias("window"), "x.n")
    found = _looked_up(late.select("window.*").distinct(), model, order).select(F.struct("lang", "gram").alias("window"), "logp")
    more = spread_join(late, found, "window", "_row", hot_keys(late, "window")).groupBy("_row").agg(F.sum(-F.col("n") * F.col("logp")).alias("more"))
    return stored(out.join(more, "_row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).select(*kept, bits_))


def _median(histogram: DataFrame, value: str) -> DataFrame:
    """lang, median of `value` by the rows' weights n: the least value that half of the weight is at or below."""
    order = Window.partitionBy("lang").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("lang")
    rows = histogram.groupBy("lang", value).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(every))
    return rows.where("2 * upto >= all").groupBy("lang").agg(F.min(value).alias("median"))


def bands(scored: DataFrame) -> DataFrame:
    """lang, lower, upper: bits between which a document of the language is kept, from the documents that teach.

    The median less and plus SPREAD robust standard deviations (1.4826 of the median distance from it), and
    LEAST_BELOW and LEAST_ABOVE at least. Medians are of an exact histogram in bins of 1/BINS of a bit, so a
    language is as many rows as it has bins.
    """
    histogram = stored(scored.where("teaches and bits is not null").groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("n")))
    middle = _median(histogram, "bin")
    far = histogram.join(middle, "lang").withColumn("far", F.abs(F.col("bin") - F.col("median")))
    width = SPREAD * 1.4826 * F.col("median") / BINS
    spread = _median(far.select("lang", "far", "n"), "far").select("lang", width.alias("width"))
    centre = (F.col("median") + 0.5) / BINS
    both = middle.join(spread, "lang")
    return both.select("lang", (centre - F.greatest("width", F.lit(LEAST_BELOW))).alias("lower"), (centre + F.greatest("width", F.lit(LEAST_ABOVE))).alias("upper"))


def quality(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, STATS, base_failed, kept, bits (a character), lower, upper.

    A null or empty text has no words and fails the base rules. A null lang is a language of its own. A document in a
    language that no document teaches, or whose bits are in the band of its language, is kept unless it fails the base
    rules. Repeated rows each have a row; texts are read whole; other columns are ignored; an empty table gives no
    rows.
    """
    scored = scores(documents, language_model(documents))
    out = spread_join(scored.withColumn("_row", F.monotonically_increasing_id()), bands(scored), "lang", "_row", hot_keys(scored, "lang"), "left")
    fits = F.coalesce((F.col("bits") >= F.col("lower")) & (F.col("bits") <= F.col("upper")), F.lit(True))
    return out.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & fits).alias("kept"), "bits", "lower", "upper")


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, the model learned from all of them."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_quality_rules": op11_quality_rules}
