"""Quality rules: counts and the whole model against plain versions, odd rows, and planted junk."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quarry.llm import quality_rules as q

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def base_failed(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def plain_model(texts, order):
    """p(gram) by recursion over counters, without pruning."""
    lines = {line for t in texts for line in t.split("\n")}
    lines = ["\n" + " ".join(WORD.findall(x)) + "\n" for x in lines if WORD.search(x)]
    tables = {order: collections.Counter(x[k : k + order] for x in lines for k in range(len(x) - order + 1))}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
        if n > 1:
            tables[n].update(x[:n] for x in lines if len(x) >= n)

    def cut(n):
        t = collections.Counter(tables[n].values())
        out = {}
        for k in (1, 2, 3):
            ok = t[k] and t[1]
            out[k] = min(max(k - (k + 1) * t[1] / (t[1] + 2 * t[2]) * t[k + 1] / t[k], 0.05), k - 0.05) if ok else k / 2
        return out
    cuts = {n: cut(n) for n in tables}
    totals, left = collections.Counter(), collections.Counter()
    for n, table in tables.items():
        for g, c in table.items():
            totals[n, g[:-1]] += c
            left[n, g[:-1]] += cuts[n][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        n = len(g)
        total = totals[n, g[:-1]]
        if not total:
            return p(g[1:])
        c = tables[n][g]
        return (c - cuts[n][min(c, 3)] if c else 0) / total + left[n, g[:-1]] / total * p(g[1:])

    def score(text):
        got, chars = 0.0, 0
        for x in text.split("\n"):
            if WORD.search(x):
                x = "\n" + " ".join(WORD.findall(x)) + "\n"
                for k in range(1, len(x)):
                    got -= math.log2(p(x[max(0, k - order + 1) : k + 1]))
                    chars += 1
        return got / chars

    return score


def prose(r, words=120, syllables=("ra", "ne", "tio", "lem", "sor", "ing", "ä")):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + ("\n" if r.random() < 0.1 else "") for _ in range(words))


@pytest.mark.parametrize("order", [2, 4])
def test_model_against_plain(spark, order):
    r = random.Random(3)
    rows = [(k, prose(r), "en" if k % 3 else None, "s", 1) for k in range(40)] + [(100, prose(r).replace("\n", " \t\n \n"), "en", "s", 1), (101, "short text", "en", "s", 1), (102, prose(r) + " #?!\U0001f600", "en", "s", 1)]
    frame = spark.createDataFrame(rows, SHAPE)
    got = {x.doc_id: x for x in q.scores(frame, q.language_model(frame, order, 0.0), order).collect()}
    for lang in ("en", None):
        own = [x for x in rows if x[2] == lang]
        teach = [x[1] for x in own if not base_failed(s := stats(x[1])) and 50 * s[2] <= s[0]]
        score = plain_model(teach, order)
        for doc_id, text, *_ in own:
            assert got[doc_id].bits == pytest.approx(score(text), rel=1e-4), doc_id


def test_pruned_model_sums_to_one(spark):
    r = random.Random(4)
    frame = spark.createDataFrame([(k, prose(r, 300), "en", "s", 1) for k in range(20)], SHAPE)
    model = {row.gram: row for row in q.language_model(frame, 3, 0.002).collect()}
    assert any(len(g) == 3 for g in model) and len(model) < 600
    alphabet = [g for g in model if len(g) == 1]

    def p(g):
        if g in model and g:
            return 2 ** model[g].logp
        return 2 ** model[""].logp if len(g) < 2 else p(g[1:]) * 2 ** (model[g[:-1]].backoff if g[:-1] in model else 0)

    for context in ("", "r", "ra", "\n", "zz", "ti"):
        assert sum(p(context + c) for c in alphabet) + p(context + "☃") == pytest.approx(1, abs=2e-3), context


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, prose(r), f"l{k % 3}", "s", 1) for k in range(30)] + [(1, None, "l1", "a", 1), (2, "", None, None, None), (None, prose(r), None, "s", 0), (50, "x" * 400_000, "l0", "s", 1), (51, "w " * 200_000, "l1", "s", 1), (52, " \n\t\n", "l2", "s", 4), (0, prose(r), "l0", "s", 1), (60, prose(r), "alone", "s", 1)]
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'x' AS bits", "1 AS gram", "2 AS line", "3 AS teaches")
    model = q.language_model(frame)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.n_words, x.word_chars)
    whole = sorted(q.scores(frame, model).collect(), key=key)
    assert whole == sorted(q.scores(frame, model, block=10).collect(), key=key) and len(whole) == len(rows)
    got = q.quality(frame).collect()
    assert sorted(tuple(x[c] for c in q.STATS) for x in got) == sorted(stats(x[1]) for x in rows)
    for x in got:
        s = tuple(x[c] for c in q.STATS)
        assert x.base_failed == base_failed(s) and x.kept == (not base_failed(s)), x
    assert q.quality(spark.createDataFrame([], SHAPE)).collect() == []


def test_copies_teach_once_and_junk_goes(spark):
    r = random.Random(6)
    one = prose(r, 80)
    rows = [(k, prose(r, 150), "en", "s", 1) for k in range(60)] + [(k, one, "en", "s", 1) for k in range(100, 190)]
    rows += [(k, " | ".join(prose(r, 90).split()), "en", "s", 1) for k in range(200, 210)] + [(k, "".join(r.choice("0123456789:;=@^~{}") + r.choice("qxzj ") for _ in range(900)), "en", "s", 1) for k in range(210, 220)]
    kept = {x.doc_id for x in q.quality(spark.createDataFrame(rows, SHAPE)).collect() if x.kept}
    assert kept == {x[0] for x in rows if x[0] < 200}


def test_table(spark):
    """Counts of every document as in the plain version, and verdicts against the labels."""
    d = "/root/testdata/sf0.01"
    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {x.doc_id: x for x in q.op11_quality_rules(spark, d).collect()}
    assert got.keys() == rows.keys()
    for doc_id, x in got.items():
        s = stats(rows[doc_id])
        assert tuple(x[c] for c in q.STATS) == s and x.base_failed == base_failed(s) and not (x.kept and x.base_failed), doc_id
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    passed = [x for x in got.values() if not x.base_failed and x.doc_id in labels]
    assert np.mean([x.kept for x in passed if labels[x.doc_id] == 1]) > 0.99
    assert np.mean([x.kept for x in passed if labels[x.doc_id] == 0]) < 0.05
