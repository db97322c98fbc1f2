"""The pipeline against plain versions of its stages on a small table."""

import hashlib
import re

import corpus_pipeline
import pyarrow as pa

from quarry.llm import mixing, secrets, toxicity
from test_mixing import plain_schedule, root_weights

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def not_copies(rows):
    sets, parent = {}, {}
    for doc, (text, _) in rows.items():
        own = SPACED.findall((text or "").translate(LOW))
        sets[doc], parent[doc] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set(), doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {doc: row for doc, row in rows.items() if root(doc) == doc}


def without_passages(rows, items):
    windows = set()
    for text in items:
        own = ALNUM.findall((text or "").translate(LOW))
        windows |= {tuple(own[at : at + 10]) for at in range(max(1, len(own) - 9) if own else 0)}
    out = {}
    for doc, (text, source) in rows.items():
        found = list(ALNUM.finditer((text or "").translate(LOW)))
        own, hit = [m[0] for m in found], [False] * len(found)
        for n in set(map(len, windows)):
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) in windows:
                    hit[at : at + n] = [True] * n
        if hit and all(hit):
            continue
        for k in reversed(range(len(hit))):
            if hit[k]:
                stop = found[k].end() if k + 1 == len(hit) or not hit[k + 1] else found[k + 1].start()
                text = text[: found[k].start()] + text[stop:]
        out[doc] = (text, source)
    return out


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    chain = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    rows = {doc: row for doc, row in rows.items() if chain.probabilities(pa.array([row[0]], pa.string()))[0, -1] < chain.threshold}
    assert len(rows) < documents.count()
    rows = without_passages(not_copies(rows), [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    formats = secrets.learn_formats(spark.createDataFrame([(doc, text) for doc, (text, _) in rows.items()], "doc_id long, text string"))
    rows = {doc: (text and secrets.masked(text, secrets.secret_spans(text, formats), "[secret]"), source) for doc, (text, source) in rows.items()}
    assert {r.doc_id: (r.text, r.source) for r in got} == rows and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    by_source = {}
    for doc in sorted(rows, key=lambda doc: (hashlib.md5(str(doc).encode()).hexdigest(), doc)):
        by_source.setdefault(rows[doc][1] or "", []).append(doc)
    names = sorted(by_source)
    weights = root_weights({name: len(own) for name, own in by_source.items()})
    slot = {(names[source], number): at for at, (source, number) in enumerate(plain_schedule([weights[name] for name in names]))}
    period = sum(weights.values())
    wanted = {}
    for name, own in by_source.items():
        for rank, doc in enumerate(own):
            block = rank // mixing.BLOCK
            wanted[doc] = (block, block // weights[name] * period + slot[name, block % weights[name]], rank % mixing.BLOCK)
    assert {r.doc_id: (r.block, r.slot, r.place) for r in got} == wanted
