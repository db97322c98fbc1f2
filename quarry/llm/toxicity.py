"""Toxicity by a classifier chain.

Linear models predict the label columns one after another; each later model also gets the earlier
probabilities, in training as out-of-fold predictions, so that it learns from probabilities as uncertain
as those it will see. Features are the distinct words of a text and their beginnings of 4 to 6 bytes.
Training takes a bounded sample of labelled rows on the driver; scoring is one pass over all documents.
The tables have one category of toxicity and a quality label, so the chain there has two links, of which only
the second is a category; any number of label columns can be chained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import small_batches, stored
from quarry.llm._words import ALNUM, _power_tables, chunks, mix, split

#: Labelled rows in training at most, and bytes of a text in training; features of a model; folds; rows and standard errors that a feature needs.
SAMPLE_ROWS, TEXT_BYTES, FEATURES, FOLDS, MIN_ROWS, MIN_Z = 6000, 200_000, 3000, 5, 4, 5.0
CHAIN = ("quality", "toxic")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning; features are 32-bit hashes."""
    words = split(texts, ALNUM, lower=True)
    power, inverse = _power_tables(len(words.seen) + 1)
    sums = np.zeros(len(words.seen) + 1, np.uint64)
    np.cumsum((words.seen.astype(np.uint64) + np.uint64(1)) * power[: len(words.seen)], out=sums[1:])
    text_of, size = words.text_of_word(), words.ends - words.starts
    texts_out, found = [], []
    for length in (0, 4, 5, 6):
        own = np.arange(len(size)) if not length else np.flatnonzero(size > length)
        stop = words.ends[own] if not length else words.starts[own] + length
        found.append((mix((sums[stop] - sums[words.starts[own]]) * inverse[words.starts[own]] + np.uint64(length)) >> np.uint64(32)).astype(np.int64))
        texts_out.append(text_of[own])
    return np.concatenate(texts_out), np.concatenate(found)


@dataclass
class Linear:
    """One link of the chain: sorted features, their weights, weights of the earlier probabilities, and a bias."""

    names: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, n: int, text: np.ndarray, feature: np.ndarray, before: np.ndarray) -> np.ndarray:
        margin = np.full(n, self.bias) + (before @ self.earlier if len(self.earlier) else 0)
        if len(self.names) and len(feature):
            at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
            hit = self.names[at] == feature
            code = np.unique(text[hit] * len(self.names) + at[hit])
            margin += np.bincount(code // len(self.names), self.weights[code % len(self.names)], n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Chain:
    labels: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 2.0  # nothing is toxic

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)))
        text, feature = features(texts)
        for k, model in enumerate(self.models):
            out[:, k] = model.probability(len(texts), text, feature, _logit(out[:, :k]))
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_linear(n: int, text: np.ndarray, column: np.ndarray, names: np.ndarray, before: np.ndarray, y: np.ndarray, most: int = FEATURES, steps: int = 250, decay: float = 2e-3) -> Linear:
    """Logistic regression on the features that differ most between the classes, by Adam on the whole sample. column: places in names."""
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    count = np.bincount(column, minlength=len(names))
    positive = np.bincount(column, y[text], len(names)) if len(column) else np.zeros(len(names))
    z = np.abs(positive - count * prior) / np.sqrt(np.maximum(count, 1) * prior * (1 - prior))
    chosen = np.sort(np.argsort(-np.where(count >= MIN_ROWS, z, -1), kind="stable")[:most])
    chosen = chosen[(count[chosen] >= MIN_ROWS) & (z[chosen] >= MIN_Z)]
    place = np.full(len(names) + 1, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0 if len(column) else np.zeros(0, bool)
    row, col = text[keep], place[column[keep]] if len(column) else column
    w, v, b = np.zeros(len(chosen)), np.zeros(before.shape[1]), float(np.log(prior / (1 - prior)))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)], [0.0, 0.0]]
    for step in range(1, steps + 1):
        margin = b + (before @ v if len(v) else 0) + (np.bincount(row, w[col], n) if len(row) else np.zeros(n))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / max(n, 1)
        slopes = [(np.bincount(col, error[row], len(w)) if len(row) else np.zeros_like(w)) + decay / 200 * w, before.T @ error + decay * v, float(error.sum())]
        moved = []
        for (m, s), g in zip(moments, slopes, strict=True):
            moved.append((0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g))
        moments = [list(x) for x in moved]
        w, v, b = (x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9) for x, (m, s) in zip((w, v, b), moments, strict=True))
    return Linear(names[chosen], w, v, float(b))


def fit_chain(rows: list[np.ndarray], y: np.ndarray, labels: tuple[str, ...], fold: np.ndarray) -> Chain:
    """rows: each text's distinct features; y: a column of 0/1 per label; fold: of each row."""
    n = len(rows)
    if not n or len(set(y[:, -1].tolist())) < 2:
        return Chain(labels)
    text, feature = np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate(rows)
    names, column = np.unique(feature, return_inverse=True)
    chain, held = Chain(labels), np.zeros((n, len(labels)))
    for k in range(len(labels)):
        before = _logit(held[:, :k])
        for own in np.unique(fold):
            train = fold != own
            number = np.cumsum(train) - 1
            use = train[text]
            model = fit_linear(int(train.sum()), number[text[use]], column[use], names, before[train], y[train, k])
            test = ~train
            number = np.cumsum(test) - 1
            use = test[text]
            held[test, k] = model.probability(int(test.sum()), number[text[use]], feature[use], before[test])
        chain.models.append(fit_linear(n, text, column, names, before, y[:, k]))
    # The cut with the best F1 out of fold, in the middle of the gap it lies in.
    p, truth = held[:, -1], y[:, -1]
    order = np.argsort(-p, kind="stable")
    f1 = 2 * np.cumsum(truth[order]) / (np.arange(1, n + 1) + truth.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    at = int(np.argmax(f1))
    lower = p[order][at + 1] if at + 1 < n else 0.0
    chain.threshold = float(_middle(p[order][at], lower))
    return chain


def _middle(a: float, b: float) -> float:
    return 1 / (1 + np.exp(-(_logit(np.array([a]))[0] + _logit(np.array([b]))[0]) / 2))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            text, feature = features(part.column("text"))
            codes = np.unique((text << 32) | feature)
            at = np.searchsorted(codes >> 32, np.arange(part.num_rows + 1))
            own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), own], names=[*(c for c in part.schema.names if c != "text"), "features"])


def _telling(rows: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """f: the features that fit_linear may choose in some model of the chain: with one fold left out, or none, MIN_ROWS rows have them and their classes differ by MIN_Z.

    rows: a row per text with labels, fold and features. A little below MIN_Z counts too, for sums of doubles come in any order.
    """
    known = {x["fold"]: x for x in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in chain)).collect()}  # FOLDS rows
    folds = sorted(known)
    per = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in folds] + [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in folds for c in chain]
    counted = rows.select("fold", *chain, F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *per)
    test = F.lit(False)
    for out in (None, *folds):
        own = [k for k in folds if k != out]
        size, n = sum(known[k]["n"] for k in own), sum((F.col(f"n{k}") for k in own), F.lit(0))
        for c in chain if size else ():
            prior = float(np.clip(sum(known[k][c] for k in own) / size, 1e-3, 1 - 1e-3))
            apart = F.abs(sum((F.col(f"{c}{k}") for k in own), F.lit(0.0)) - n * prior)
            test = test | ((n >= MIN_ROWS) & (apart >= (MIN_Z - 1e-6) * F.sqrt(n * prior * (1 - prior))))
    return counted.where(test).select("f")


def train(documents: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, sample_rows: int = SAMPLE_ROWS, text_bytes: int = TEXT_BYTES) -> Chain:
    """A chain from at most sample_rows labelled documents of at most text_bytes, chosen by a hash of doc_id.

    Rows of labels with a null in doc_id or a label are left out; several rows of one doc_id count as their
    largest labels, several documents of one doc_id as the first text. Copies of a text are in one fold. Only
    features that some model may choose reach the driver (see _telling). Without rows or with one class only,
    the chain finds nothing toxic.
    """
    documents = small_batches(documents)
    known = labels.select("doc_id", *chain).na.drop().groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in chain))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes).join(F.broadcast(known), "doc_id")  # at most sample_rows rows
    texts = texts.groupBy("doc_id", *chain).agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long"), *chain, F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), "text")
    rows = stored(texts.mapInArrow(_features_of, "doc_id long, " + ", ".join(f"{c} double" for c in chain) + ", fold long, features array<int>"))
    own = rows.select("doc_id", F.explode("features").alias("f")).join(_telling(rows, chain), "f").groupBy("doc_id").agg(F.collect_list("f").alias("features"))
    table = rows.drop("features").join(own, "doc_id", "left").toArrow().sort_by("doc_id")
    features_ = [np.sort(np.asarray(x.values, np.int64) & 0xFFFFFFFF) if x.is_valid else np.empty(0, np.int64) for x in table.column("features")]
    y = np.array([table.column(c).to_numpy() for c in chain]).T
    return fit_chain(features_, y, tuple(chain), table.column("fold").to_numpy())


def _scored(chain: Chain, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0]):
                p = chain.probabilities(part.column(0))
                new = [*(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= chain.threshold)]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*part.columns, *new], schema.types, strict=True)], schema=schema)

    return run


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """documents with p_<label> for each label of the chain and is_toxic; columns of these names give way.

    A null or empty text has no features and gets the prior; repeated rows are each scored; an empty table
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = [f"p_{c}" for c in chain.labels]
    base = small_batches(documents).select("text", *(c for c in documents.columns if c not in ("text", "is_toxic", *new)))
    extra = documents.sparkSession.createDataFrame([], ", ".join(f"{c} double" for c in new) + ", is_toxic boolean").schema
    schema = type(extra)([*base.schema.fields, *extra.fields])
    return base.mapInArrow(_scored(chain, to_arrow_schema(schema)), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Trained on the table's labels; every document scored."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(documents.select("doc_id", "text"), chain)
    return out.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CHAIN), "is_toxic")


QUERIES = {"op10_toxicity": op10_toxicity}
