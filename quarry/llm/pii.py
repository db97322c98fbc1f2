"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns give the seed entities. The two words before an entity are its lexical pattern. Patterns
and instances form a graph: a pattern is as reliable as the instances it introduces, an instance as
reliable as the patterns that introduce it, starting from the seeds at 1 and all other identifiers at 0.
After a few rounds, identifiers behind reliable patterns with enough different seeds are found too.

Positions come from cutting a text by the same pattern that extracts the matches: the lengths of pieces
and matches add up to code point offsets. Quantifiers are possessive where what follows cannot match what
they took, so no text makes the regular expressions recurse or go back. Running values over a text's matches
are taken by blocks of matches, so many matches in one text cost little more than in many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import hot_keys, spread_join, stored

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: A match can only start where a run of its first characters starts, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Runs of letters, digits, _ and -, of six or more with a digit.
IDENTIFIER = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
_CONTEXT = r"(?<!\p{L})(\p{L}++[^\p{L}\p{N}]{1,3}\p{L}++[^\p{L}\p{N}]{0,3})$"
#: Rounds of scoring; confidence and different seeds that a pattern needs.
ROUNDS, CONFIDENCE, SEEDS = 3, 0.8, 3
#: Matches of a block.
BLOCK = 64
_PLACED = "array<struct<start:long,end:long,found:string,context:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Array of (piece, found): what stands before a pattern's match, and the match; the piece behind the last has none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(matches) > 0, F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("found"))).otherwise(F.array())


def running(xs: Column, zero: Column, step, row) -> Column:
    """Array of row(state, x) for each x, state being zero after the steps of all before it.

    An array that grows by one element is copied each time, so the states are taken block by block.
    """
    return F.get(F.transform(F.array(xs), lambda own: _running(own, zero, step, row)), F.lit(0))  # a lambda's variable, so that xs is made once


def _running(xs: Column, zero: Column, step, row) -> Column:
    empty = F.transform(F.slice(xs, 1, 0), lambda x: row(zero, x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
    starts = F.aggregate(
        blocks, pair(zero, F.slice(F.array(zero), 1, 0)), lambda done, block: pair(F.aggregate(block, done["state"], step), F.concat(done["out"], F.array(done["state"]))), lambda done: done["out"]
    )
    within = lambda block, state: F.aggregate(block, pair(state, empty), lambda done, x: pair(step(done["state"], x), F.concat(done["out"], F.array(row(done["state"], x)))), lambda done: done["out"])
    return F.flatten(F.zip_with(blocks, starts, within))


def _placed(pairs: Column) -> Column:
    """Adds up the lengths of pieces and matches; the context of a match ends at the match before it of the same kind."""
    sized = F.transform(
        F.filter(pairs, lambda x: x["found"].isNotNull()),
        lambda x: F.struct(F.length(x["piece"]).cast("long").alias("gap"), F.length(x["found"]).cast("long").alias("size"), x["found"].alias("found"), F.lower(F.regexp_extract(x["piece"], _CONTEXT, 1)).alias("context")),
    )
    place = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["found"].alias("found"), x["context"].alias("context"))
    return running(sized, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["size"], place)


def _apart(others: Column, base: Column) -> Column:
    """Those of others, by start, that touch none of base: no base span before one reaches into it, none begins inside it."""
    event = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["found"].alias("found"), x["context"].alias("context"))
    events = F.array_sort(F.concat(F.transform(base, lambda x: event(x, False)), F.transform(others, lambda x: event(x, True))))
    with_flag = lambda free: lambda edge, x: F.struct(*(x[c].alias(c) for c in ("start", "own", "end", "found", "context")), free(edge, x).alias("free"))
    ahead = running(events, F.lit(0).cast("long"), lambda edge, x: F.when(x["own"], edge).otherwise(F.greatest(edge, x["end"])), with_flag(lambda edge, x: edge <= x["start"]))
    back = running(F.reverse(F.filter(ahead, lambda x: x["free"] | ~x["own"])), F.lit(1 << 62), lambda edge, x: F.when(x["own"], edge).otherwise(x["start"]), with_flag(lambda edge, x: edge >= x["end"]))
    kept = F.reverse(F.filter(back, lambda x: x["own"] & x["free"]))
    return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "found", "context"))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _passing(kind: str, placed: Column) -> Column:
    return F.filter(placed, lambda x: _valid(kind, x["found"]))


def _named(k: int, kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"), x["context"].alias("context")))


_HINT = {"email": "@", "phone": "+"}


def scan(documents: DataFrame) -> DataFrame:
    """documents with base (start, number of the kind, end, kind, found, context) by start, and identifiers (start, end, found, context)."""
    text = F.coalesce("text", F.lit(""))
    out = documents
    for kind, pattern in PATTERNS.items():
        pairs = _spans(text, pattern)
        if kind in _HINT:
            pairs = F.when(F.contains(text, F.lit(_HINT[kind])), pairs).otherwise(F.array())
        out = out.withColumn(f"_{kind}", pairs)
        out = out.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, _passing(kind, _placed(F.col(f"_{kind}")))).otherwise(F.array().cast(_PLACED)))
    out = out.withColumn("_other", _spans(text, IDENTIFIER))
    out = out.withColumn("_other", F.when(F.size("_other") > 0, _placed(F.col("_other"))).otherwise(F.array().cast(_PLACED)))
    out = out.withColumn("base", F.array_sort(F.concat(*(_named(k, kind) for k, kind in enumerate(KINDS)))))
    apart = F.when((F.size("base") > 0) & (F.size("_other") > 0), _apart(F.col("_other"), F.col("base"))).otherwise(F.col("_other"))
    return out.withColumn("identifiers", apart).drop("_other", *(f"_{kind}" for kind in KINDS))


def reliable_patterns(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(pattern, kind) of the lexical patterns worth trusting, by mutual scoring of patterns and instances."""
    seed = scanned.select(F.explode("base").alias("x")).select(F.col("x.context").alias("pattern"), F.lower("x.found").alias("instance"), F.col("x.kind").alias("kind"))
    other = scanned.select(F.explode("identifiers").alias("x")).select(F.col("x.context").alias("pattern"), F.lower("x.found").alias("instance"), F.lit(None).cast("string").alias("kind"))
    edges = stored(seed.unionAll(other).where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    named = edges.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.mode("kind", True).alias("p_kind")).where(F.col("seeds") > 0)
    edges = stored(spread_join(edges, named, "pattern", "instance", hot_keys(edges, "pattern")))  # only patterns that introduce some seed can become reliable
    hot_pattern, hot_instance = hot_keys(edges, "pattern"), hot_keys(edges, "instance")
    score = edges.select("instance", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        patterns = spread_join(edges, score, "instance", "pattern", hot_instance).groupBy("pattern").agg(F.avg("score").alias("p"))
        # Noisy or over an instance's patterns; seeds stay sure.
        trust = F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("p") * F.col("p"), F.lit(0.999999)))))
        score = stored(spread_join(edges, patterns, "pattern", "instance", hot_pattern).groupBy("instance").agg(F.when(F.count("kind") > 0, 1.0).otherwise(trust).alias("score")))
    patterns = spread_join(edges, score, "instance", "pattern", hot_instance).groupBy("pattern", "seeds", "p_kind").agg(F.avg("score").alias("p"))
    return patterns.where((F.col("p") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", F.col("p_kind").alias("kind"))


def find_pii(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id and spans, an array of (start, k, end, kind) in code points.

    k is 0 to 3 for the base kinds email, ip, card and phone, 4 for like_<kind>: identifiers found by
    their context. Sorted by start, then k. A null text is empty; rows without doc_id are answered too;
    repeated rows get the same spans; other columns are ignored; an empty table gives no rows.
    """
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("row"))
    scanned = stored(scan(keyed).drop("text"))
    trusted = stored(reliable_patterns(scanned))
    others = scanned.select("doc_id", "row", F.explode("identifiers").alias("x")).withColumn("pattern", F.col("x.context")).where("pattern <> ''")
    found = spread_join(others, trusted, "pattern", "row", hot_keys(others, "pattern"))
    found = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct(F.col("x.start").alias("start"), F.lit(4).alias("k"), F.col("x.end").alias("end"), F.concat(F.lit("like_"), "kind").alias("kind"))).alias("more"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "more")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    joined = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return joined.select("doc_id", F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more"))).alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document of the table."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in KINDS), F.sha2(named(F.filter("spans", lambda x: x["k"] < 4)), 256).alias("base_sha256"), named("spans").alias("spans"))


QUERIES = {"op9_pii": op9_pii}
