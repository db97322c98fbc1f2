"""Token counts: one exact histogram of encoded lengths answers every question about context limits.

Documents are encoded once, in Arrow batches; each batch sends a row per distinct length. Counts below
and above each length are prefix sums over the histogram, taken in two levels so that no task holds it all.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import small_batches
from quarry.llm._words import chunks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's texts are cut before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (as \\s of the pattern has it) of a length at which a run is cut out before encoding.
RUN = 1000
_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}+")
_loaded: dict = {}


def _encoding(ranks: bytes, pattern: str):
    if (key := (len(ranks), hash(ranks), pattern)) not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _loaded[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def n_tokens(text: str, encoding, pattern: str) -> int:
    """Encoded length of a text.

    The tokenizer's matcher backtracks over a run of white space and fails on very long ones. By PATTERN such
    a run is one piece but for its last character, which belongs to what follows; at the end all of it is.
    """
    if pattern != PATTERN or len(text) < RUN:
        return len(encoding.encode_ordinary(text))
    total = done = 0
    for m in _RUN.finditer(text):
        stop = m.end() - (m.end() < len(text))
        total += len(encoding.encode_ordinary(text[done : m.start()])) + len(encoding._encode_single_piece(text[m.start() : stop]))
        done = stop
    return total + len(encoding.encode_ordinary(text[done:]))


def _lengths(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            for part in chunks(batch):
                lengths = np.array([n_tokens(x, encoding, pattern) if x else 0 for x in part.column("text").to_pylist()], np.int64)
                length, n = np.unique(lengths, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], names=["n_tokens", "n_docs"])

    return run


def length_histogram(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """n_tokens, n_docs: how many texts have each encoded length. The driver reads the vocabulary file and sends it along."""
    with open(tokenizer, "rb") as file:
        ranks = file.read()
    return small_batches(documents).select("text").mapInArrow(_lengths(ranks, pattern), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """For each length that occurs, taken as a context limit: totals, rank and what truncation keeps and cuts.

    n_docs: texts of just that length; n_fit: of at most that length; n_over: of more; share_fit: n_fit of
    all, so the smallest n_tokens with share_fit >= q is the q-quantile; tokens_fit: tokens of the texts that
    fit; tokens_kept: tokens left if every text is cut to the limit; tokens_cut: tokens lost; tokens_all.
    """
    from quarry.llm._shared import stored

    rows = stored(histogram.withColumn("bucket", F.floor(F.col("n_tokens") / width)))
    tokens = F.col("n_docs") * F.col("n_tokens")
    sums = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # One row per bucket of lengths: a longest text of a million tokens makes a thousand.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("bucket", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"))
    within = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, "bucket").withColumn("n_fit", F.col("d0") + F.sum("n_docs").over(within)).withColumn("tokens_fit", F.col("t0") + F.sum(tokens).over(within))
    out = out.withColumn("n_over", F.col("docs_all") - F.col("n_fit")).withColumn("tokens_kept", F.col("tokens_fit") + F.col("n_over") * F.col("n_tokens"))
    return out.select("n_tokens", "n_docs", "n_fit", "n_over", (F.col("n_fit") / F.col("docs_all")).alias("share_fit"), "tokens_fit", "tokens_kept", (F.col("tokens_all") - F.col("tokens_kept")).alias("tokens_cut"), "tokens_all")


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """n_tokens, n_fit, n_over, tokens_fit, tokens_kept, tokens_cut for any limits, from the table of context_limits.

    What fits a limit is what fits the largest length at or below it; of the others each keeps the limit.
    One row a limit, also if no length is that small; no rows for a table without any.
    """
    at = [F.max_by(F.struct("n_fit", "tokens_fit"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))).alias(f"at_{k}") for k, limit in enumerate(limits)]
    one = table.agg(F.max("n_fit").alias("docs"), F.max("tokens_all").alias("tokens"), *at).where("docs is not null")
    rows = F.array(*(F.struct(F.lit(limit).cast("long").alias("n_tokens"), F.coalesce(F.col(f"at_{k}.n_fit"), F.lit(0)).alias("n_fit"), F.coalesce(F.col(f"at_{k}.tokens_fit"), F.lit(0)).alias("tokens_fit")) for k, limit in enumerate(limits)))
    out = one.select("docs", "tokens", F.explode(rows).alias("r")).select("docs", "tokens", "r.*").withColumn("n_over", F.col("docs") - F.col("n_fit"))
    out = out.withColumn("tokens_kept", F.col("tokens_fit") + F.col("n_over") * F.col("n_tokens"))
    return out.select("n_tokens", "n_fit", "n_over", "tokens_fit", "tokens_kept", (F.col("tokens") - F.col("tokens_kept")).alias("tokens_cut"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the texts fit in, from the table of context_limits."""
    one = table.agg(*(F.min(F.when(F.col("share_fit") >= share, F.col("n_tokens"))).alias(f"q_{k}") for k, share in enumerate(shares)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(share)).alias("share"), F.col(f"q_{k}").alias("n_tokens")) for k, share in enumerate(shares)))).alias("r")).select("r.*").where("n_tokens is not null")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """context_limits of the encoded lengths of documents' texts.

    A null or empty text has 0 tokens and counts as a document; special tokens in a text are ordinary
    text; repeated rows each count; other columns are ignored; an empty table gives no rows.
    """
    return context_limits(length_histogram(documents, tokenizer, pattern))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document, every length that occurs as a context limit."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_token_counts": op4_token_counts}
