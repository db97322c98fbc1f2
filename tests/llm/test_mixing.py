"""Operator 7 against earliest deadline first over all sources, slot by slot."""

import hashlib
from math import sqrt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import mixing


def plain_schedule(weights):
    """(source, block) of each slot of a period: of the released blocks the one due first, then the first source."""
    period, done, slots = sum(weights), [0] * len(weights), []
    for slot in range(period):
        due = [(-(-(done[s] + 1) * period // w), s) for s, w in enumerate(weights) if done[s] < w and done[s] * period // w <= slot]
        source = min(due)[1]
        slots.append((source, done[source]))
        done[source] += 1
    return slots


def root_weights(sizes):
    total = sum(sqrt(sizes[name]) for name in sorted(sizes))
    return {name: max(1, int(mixing.PERIOD * sqrt(size) / total + 0.5)) for name, size in sizes.items()}


def all_slots(weights):
    """The slots as the operator finds them: heavy sources simulated, light ones by their number."""
    heavy = [s for s, w in enumerate(weights) if w > 1]
    found = mixing.schedule([(weights[s], sum(w == 1 for w in weights[:s])) for s in heavy], weights.count(1))
    slots = {slot: (heavy[s], number) for s, number, slot in found}
    free = (slot for slot in range(sum(weights)) if slot not in slots)
    return [x for _, x in sorted((slots | {next(free): (s, 0) for s, w in enumerate(weights) if w == 1}).items())]


@given(st.lists(st.one_of(st.just(1), st.integers(1, 30)), min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_slots_are_those_of_the_plain_schedule(weights):
    slots = all_slots(weights)
    assert slots == plain_schedule(weights)
    done, period = [0] * len(weights), sum(weights)
    for slot, (source, _) in enumerate(slots):
        done[source] += 1
        assert all(abs(n - w * (slot + 1) / period) < 1 for n, w in zip(done, weights, strict=True))


def wanted(rows, weights, block):
    period, names = sum(weights.values()), sorted(weights)
    slot = {(names[s], number): at for at, (s, number) in enumerate(plain_schedule([weights[name] for name in names]))}
    out = {}
    for name in names:
        own = sorted((doc for doc, source in rows if source == name), key=lambda doc: (hashlib.md5(str(doc).encode()).hexdigest(), doc))
        for rank, doc in enumerate(own):
            n = rank // block
            out[doc] = (n, n // weights[name] * period + slot[name, n % weights[name]], rank % block)
    return out


def test_many_small_sources_beside_large_ones(spark):
    rows = [(k, f"t{k}" if k % 4 == 0 else f"u{k % 3}" if k % 4 == 1 else "a") for k in range(1200)]
    sizes = {}
    for _, source in rows:
        sizes[source] = sizes.get(source, 0) + 1
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block=4).collect()
    assert {r.doc_id: (r.block, r.slot, r.place) for r in got} == wanted(rows, root_weights(sizes), 4) and len(got) == len(rows)


def test_given_weights_by_their_common_divisor(spark):
    rows = [(k, "ab"[k % 2]) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(frame, {"a": 3_000_000_000, "b": 1_000_000_000, "c": 0}, block=2).collect()
    assert {r.doc_id: (r.block, r.slot, r.place) for r in got} == wanted(rows, {"a": 3, "b": 1}, 2)
    with pytest.raises(ValueError, match="smaller"):
        mixing.mix_sources(frame, {"a": 3_000_000_001, "b": 1_000_000_000})


def test_two_hundred_thousand_sources_keep_within_a_block(spark):
    many, large = 200_000, 40_000
    name = F.when(F.col("id") < large, "m").otherwise(F.concat(F.lit("s"), (F.col("id") % many).cast("string")))
    frame = spark.range(many + large).select(F.col("id").alias("doc_id"), name.alias("source"))
    got = mixing.mix_sources(frame, block=16).toPandas()
    first = got[got.place == 0]
    assert len(got) == many + large and first.slot.is_unique
    small = first[first.source != "m"]
    own = np.sort(first[first.source == "m"].slot.to_numpy())
    assert (small.block == 0).all() and small.source.nunique() == many
    # The only source of several blocks has one a period, as its share asks, and the small ones all of the other slots.
    period = many + 1
    assert len(own) == large // 16 and (own // period == np.arange(len(own))).all() and small.slot.max() < period
