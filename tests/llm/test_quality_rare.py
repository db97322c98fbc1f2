"""Scores hold for n-grams too rare for the tasks' arrays."""

import random

import pyarrow as pa
import pytest
from quarry.llm import quality_rules as q
from test_quality import SHAPE, plain_model, prose


def test_rare_ngrams_are_looked_up(spark):
    r = random.Random(8)
    rows = [(k, prose(r), "en" if k % 3 else None, "s", 1) for k in range(30)] + [(100, "".join(r.choice("qxzjk ☃e\n") for _ in range(400)), "en", "s", 1), (101, "", "en", "s", 1), (102, prose(r), "alone", "s", 1)]
    frame = spark.createDataFrame(rows, SHAPE)
    model = q.language_model(frame)
    assert any(x.size == 4 and x.raw < 0.005 * x.characters for x in model.collect())
    key = lambda x: x.doc_id
    got, whole = (sorted(q.scores(frame, model, share=share).collect(), key=key) for share in (0.005, 0.0))
    assert len(got) == len(rows) and [x[:-1] for x in got] == [x[:-1] for x in whole]
    assert [x.doc_id for x in got if x.bits is None] == [101]
    assert [x.bits or 0 for x in got] == pytest.approx([x.bits or 0 for x in whole], rel=1e-5)
    for lang in ("en", None, "alone"):
        own = [x for x in rows if x[2] == lang]
        score = plain_model([x[1] for x in own if {y.doc_id: y.teaches for y in whole}[x[0]]], 4)
        for doc_id, text, *_ in own:
            if text:
                assert {x.doc_id: x.bits for x in got}[doc_id] == pytest.approx(score(text), rel=1e-4), doc_id


def test_no_ngram_is_left_out(spark):
    """In a language of over a million characters too: n-grams that are there once stay."""
    letters = [chr(0x4E00 + k) for k in range(3000)]
    r = random.Random(9)
    rows = [(k, " ".join("".join(r.choices(letters, k=5)) for _ in range(1000)), "zh", "s", 1) for k in range(180)]
    model = q.language_model(spark.createDataFrame(rows, SHAPE))
    assert model.where("size = 4 and raw = 1 and characters > 1000000").limit(1).count() == 1


def test_lines_of_small_batches_are_counted_together():
    """An n-gram is one row for many batches of a task, with the sum of its counts."""
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "line": ["abc ab"]}) for _ in range(50)]
    got = [x for batch in q._counted(3)(iter(batches)) for x in batch.to_pylist()]
    assert len({x["gram"] for x in got}) == len(got)
    assert {x["gram"]: x["n"] for x in got} == {g: 50 for g in ("\na", "\nab", "abc", "bc ", "c a", " ab", "ab\n")}
