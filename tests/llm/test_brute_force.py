"""Each query against a plain version on a small table."""

import collections
import hashlib
import re

import numpy as np
import pytest

from quarry.llm import registry

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def result(spark, sf_dir, name, key="doc_id"):
    return {row[key]: row for row in registry.queries()[name](spark, sf_dir).collect()}


def test_op1(spark, sf_dir, documents):
    got, first, words = result(spark, sf_dir, "op1_substring_dedup"), {}, {}
    for row in sorted(documents, key=lambda r: r.doc_id):
        own = words[row.doc_id] = SPACED.findall(row.text or "")
        for at in range(len(own) - 49):
            first.setdefault(tuple(own[at : at + 50]), row.doc_id)
    removed = 0
    for doc, own in words.items():
        gone = [False] * len(own)
        for at in range(len(own) - 49):
            if first[tuple(own[at : at + 50])] < doc:
                gone[at : at + 50] = [True] * 50
        removed += sum(gone)
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(own), sum(gone), sha(kept)), doc
    assert removed > 0 and len(got) == len(documents)


def test_op2(spark, sf_dir, documents):
    got, windows = result(spark, sf_dir, "op2_benchmark_decontamination"), collections.defaultdict(set)
    for item in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        own = ALNUM.findall((item.text or "").translate(LOW))
        for at in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[at : at + 10])].add(str(item.item_id))
    hits = 0
    for row in documents:
        own, items = ALNUM.findall((row.text or "").translate(LOW)), set()
        hit = [False] * len(own)
        for n in set(map(len, windows)):
            for at in range(len(own) - n + 1):
                if found := windows.get(tuple(own[at : at + n])):
                    hit[at : at + n] = [True] * n
                    items |= found
        hits += sum(hit)
        r = got[row.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(own), sum(hit), len(items), sha(",".join(sorted(items))), any(hit))
    assert hits > 0


def test_op4(spark, sf_dir, documents):
    import base64

    import tiktoken

    from quarry.llm.token_counts import PATTERN, TOKENIZER

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    lengths = np.array([len(tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(r.text or "")) for r in documents[:1]] or [0])
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.array([len(encoding.encode_ordinary(r.text or "")) for r in documents])
    got = result(spark, sf_dir, "op4_token_counts", "n_tokens")
    assert sorted(got) == sorted(set(lengths.tolist()))
    for n, row in got.items():
        assert (row.n_docs, row.n_fit, row.n_over) == ((lengths == n).sum(), (lengths <= n).sum(), (lengths > n).sum())
        kept = np.minimum(lengths, n).sum()
        assert (row.tokens_fit, row.tokens_kept, row.tokens_cut, row.tokens_all) == (lengths[lengths <= n].sum(), kept, lengths.sum() - kept, lengths.sum())


def by_start(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2]))))


def test_op5(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables with secrets
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got, total = result(spark, sf_dir, "op5_secret_scans"), 0
    kinds = ("assign", "access", "hex")
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for row in documents:
        text = row.text or ""
        spans = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        total += len(spans)
        r = got[row.doc_id]
        assert r.base_sha256 == sha(by_start(spans, kinds))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for *_, k in spans) for kind in kinds)
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for a, b, k in spans)
    assert total > 0


def test_op6(spark, sf_dir, documents):
    sets = {}
    for row in documents:
        own = SPACED.findall((row.text or "").translate(LOW))
        sets[row.doc_id] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, links = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    links += 1
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    got = result(spark, sf_dir, "op6_ngram_jaccard_join")
    assert links > 0
    for doc in ids:
        assert (got[doc].n_shingles, got[doc].component_id) == (len(sets[doc]), root(doc)), doc


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_op9(spark, sf_dir, documents):
    got, kinds, total = result(spark, sf_dir, "op9_pii"), ("email", "ip", "card", "phone"), 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    for row in documents:
        spans = [(m.start(), m.end(), kind) for kind, (pattern, fits) in tests.items() for m in re.finditer(pattern, row.text or "") if fits(m[0])]
        total += len(spans)
        r = got[row.doc_id]
        assert r.base_sha256 == sha(by_start(spans, kinds)), row.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in spans) for kind in kinds)
    assert total > 0


def test_op10(spark):
    """Held-out accuracy: trained on half of the labels, tested on the others."""
    from quarry.llm import toxicity

    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(documents, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(documents, chain).join(labels.where("doc_id % 2 = 1").drop("quality"), "doc_id").select("is_toxic", "toxic").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.9
    assert hit / max(1, sum(r.is_toxic for r in rows)) > 0.95


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = registry.queries()[name](spark, sf_dir)
    relation = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({registry.oracle_sql()[name]})")
    assert sorted(map(repr, relation.fetchall())) == sorted(repr(tuple(r)) for r in frame.collect())
