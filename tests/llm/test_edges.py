"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, embedding_dedup, html_extraction, jaccard_join, mixing, pii, secrets, substring_dedup, token_counts, toxicity

LONG = " ".join(f"w{k}" for k in range(60_000))
ROWS = [
    (1, "alpha beta gamma", "en", "a", 16), (1, "alpha beta gamma", "en", "a", 16), (2, "", "en", None, 0), (3, None, None, "b", None), (None, "alpha beta gamma", "en", "a", 16),
    (4, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (6, "x" * 300_000, "en", "b", 300_000), (7, " \n\t ", "en", "b", 4), (8, "password: hunter2hunter2 AKIA" + "A" * 14 + " a@b.example", "en", "b", 60),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SHAPE)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def by_id(rows, column):
    out = {}
    for row in rows:
        out.setdefault(row.doc_id, []).append(row[column])
    return out


def test_substring_dedup(documents, nothing):
    rows = substring_dedup.dedup_substrings(documents.withColumn("n_words", F.lit("x"))).collect()
    removed = by_id(rows, "n_removed")
    assert len(rows) == len(ROWS) and removed[5] == [60_000] and removed[4] == [0] and removed[1] == [0, 0] and removed[3] == [0]
    assert by_id(rows, "kept_text")[5] == [""] and by_id(rows, "kept_text")[4] == [LONG] and removed[None] == [0]
    assert substring_dedup.dedup_substrings(nothing).collect() == []


def test_substring_dedup_of_a_hot_anchor_with_other_white_space(spark, monkeypatch):
    """Windows of a passage in many documents, each wrapped in another way, meet whatever shard they are dealt to."""
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 2)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    passage = [f"p{k}" for k in range(60)]
    gaps = [" ", "\n", "  ", "\r\n", "\t"]
    texts = [f"x{d} y{d} " + "".join(w + gaps[(k * d + d) % 5] for k, w in enumerate(passage)) + f" z{d}" for d in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert got.pop(0)[0] == 0
    assert got == {d: (60, f"x{d} y{d} z{d}") for d in range(1, 20)}


def test_substring_dedup_of_a_passage_in_many_documents_keeps_shards_small(spark, monkeypatch):
    """No shard's index grows with the number of documents that share a window."""
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 10)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 1000)
    plain = substring_dedup._shard

    def watched(width):
        inner = plain(width)

        def run(table):
            assert sum(len(x.split()) for x in table.column("text").to_pylist()) <= 5000
            return inner(table)

        return run

    monkeypatch.setattr(substring_dedup, "_shard", watched)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"x{d} y{d} {passage} z{d}" for d in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert got.pop(0)[0] == 0
    assert got == {d: (60, f"x{d} y{d} z{d}") for d in range(1, 400)}


def test_decontamination(spark, documents, nothing):
    items = spark.createDataFrame([(1, "Alpha, beta GAMMA"), (1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21"), (2, None), (None, "password"), (3, "")], "item_id long, text string")
    for block in (1 << 20, 10):  # one pass, and several
        rows = decontamination.find_passages(documents.withColumn("spans", F.lit(1)), items, block_chars=block).collect()
        spans, found = by_id(rows, "spans"), by_id(rows, "items")
        assert len(rows) == len(ROWS) and found[1] == [["1"], ["1"]] and found[3] == [[]] and found[8] == [[]]
        assert [(x.start, x.end) for x in spans[4][0]] == [(10, 22)] and [(x.start, x.end) for x in spans[8][0]] == [(0, 1)]
    assert decontamination.find_passages(nothing, items).collect() == []
    assert all(r.spans == [] for r in decontamination.find_passages(documents, items.limit(0)).collect())
    left = by_id(decontamination.remove_passages(documents, items).collect(), "text")
    assert 1 not in left and left[3] == [None] and left[8][0].startswith(": hunter2") and left[4][0].split()[9:12] == ["w9", "w22", "w23"]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, None], 1), (10, [1.0], 1), (11, [1.0, 0.1], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x")).withColumn("kept", F.lit(1))
    got = {}
    for row in embedding_dedup.near_duplicates(frame, tile=2).collect():
        got.setdefault(row.vec_id, []).append((row.n_links, row.component_id, row.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] * 2 and got[11] == [(3, 1, False)] and got[12] == [(3, 1, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 10, 13)) and got[None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_embeddings_of_different_vectors_with_one_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.02], 1), (4, [0.01, 1.0], 1)]
    got = {}
    for row in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(row.vec_id, []).append((row.n_links, row.component_id))
    assert sorted(got[1]) == [(1, 1), (2, 1)] and got[2] == [(2, 1)] and got[3] == [(2, 1)] and got[4] == [(1, 1)]


def test_embeddings_leave_out_only_pairs_of_tiles_without_a_link(spark):
    """Clusters in many tiles, with pivots: the same links as all pairs, from fewer pairs of tiles."""
    import numpy as np

    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 16))
    x = centres[np.arange(400) % 8] + r.normal(size=(400, 16)) * 0.18
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = (unit @ unit.T >= 0.93) & ~np.eye(400, dtype=bool)
    frame = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {row.vec_id: row for row in embedding_dedup.near_duplicates(frame, tile=10).collect()}
    assert close.any() and [got[k].n_links for k in range(400)] == close.sum(axis=1).tolist()
    tiles = spark.createDataFrame([("a", 2, 0, [0.0], [0.1]), ("a", 2, 1, [0.3], [0.4]), ("a", 2, 2, [1.0], [1.1])], "label string, dim int, tile int, low array<double>, high array<double>")
    pairs = {(p.s, p.t) for row in embedding_dedup._tile_pairs(tiles, 0.93).collect() for p in row.pairs}
    assert pairs == {(0, 0), (1, 1), (2, 2), (0, 1)}


def test_token_counts(documents, nothing):
    rows = {r.n_tokens: r for r in token_counts.token_counts(documents.withColumn("n_tokens", F.lit("x"))).collect()}
    assert rows[0].n_docs == 2 and max(rows) > 60_000 and sum(r.n_docs for r in rows.values()) == len(ROWS)
    assert token_counts.token_counts(nothing).collect() == []


def test_token_counts_of_long_white_space(spark):
    """Runs that the tokenizer's own matcher fails on, with the lengths that their pieces have."""
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", None, "a b"]
    table = token_counts.token_counts(spark.createDataFrame([(x,) for x in texts], "text string"))
    assert sorted(r.n_tokens for r in table.collect()) == [0, 2, 500_003, 1_000_000]


def test_white_space_is_cut_where_the_pattern_cuts_it(monkeypatch):
    import random
    import re

    encoding = token_counts._encoding(open(token_counts.TOKENIZER, "rb").read(), token_counts.PATTERN)
    monkeypatch.setattr(token_counts, "RUN", 0)
    monkeypatch.setattr(token_counts, "_RUN", re.compile(token_counts._RUN.pattern.replace("1000", "4")))
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "b1", " ", "  \n", "\t", "é", "!", " " * r.randint(1, 30), "\u2003" * 3]) for _ in range(r.randint(0, 30)))
        assert token_counts.n_tokens(text, encoding, token_counts.PATTERN) == len(encoding.encode_ordinary(text)), text


def test_limits_and_quantiles(spark):
    table = token_counts.context_limits(spark.createDataFrame([(2, 3), (5, 1), (9, 4)], "n_tokens long, n_docs long"), width=4)
    lengths = [2] * 3 + [5] + [9] * 4
    for row in token_counts.at_limits(table, [0, 1, 2, 4, 7, 100]).collect():
        n = row.n_tokens
        kept = sum(min(x, n) for x in lengths)
        assert tuple(row) == (n, sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(x for x in lengths if x <= n), kept, sum(lengths) - kept)
    assert [tuple(r) for r in token_counts.quantiles(table, [0.1, 0.5, 0.51, 1.0]).collect()] == [(0.1, 2), (0.5, 5), (0.51, 9), (1.0, 9)]
    assert token_counts.at_limits(table.limit(0), [5]).collect() == []


def test_secrets(documents, nothing):
    rows = by_id(secrets.find_secrets(documents.withColumn("secrets", F.lit("x")), secrets.Formats({}, [])).collect(), "secrets")
    assert [x.kind for x in rows[8][0]] == ["assign", "access"] and rows[3] == [[]] and rows[1] == [[], []]
    masked = by_id(secrets.redact(documents).collect(), "text")
    assert masked[8] == ["[secret] [secret] a@b.example"] and masked[3] == [None] and masked[4] == [LONG]
    assert secrets.find_secrets(nothing).collect() == []


def test_secrets_of_many_matches_in_one_text():
    import time

    text = " ".join(f"token={k:012d} {'ab' * 20} word{k}longer" for k in range(100_000))
    began = time.time()
    spans = secrets.secret_spans(text, secrets.Formats({"hex": secrets.infer(["a" * 40] * 9)}, []))
    assert len(spans) >= 200_000 and time.time() - began < 30
    assert secrets.masked(text, spans, "#").startswith("# # word0longer # # word1longer")
    assert secrets.masked("abcdef", [(0, 2, "x"), (1, 4, "y"), (5, 6, "x")], "#") == "#e#" and secrets.masked("ab", [], "#") == "ab"


def test_learned_formats_on_held_out_credentials(spark):
    """Credentials of half of the documents, without what names them, against the tokens of the others."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    formats = secrets.learn_formats(documents.where("doc_id % 2 = 0"))
    hit = total = wrong = ordinary = 0
    for row in documents.where("doc_id % 2 = 1").select("text").collect():
        base = secrets.base_spans(row.text or "")
        for _, _, _, token in base:
            total += 1
            hit += formats.kind_of(token) is not None
        for m in secrets.apart(row.text or "", base):
            ordinary += 1
            wrong += formats.kind_of(m[0]) is not None
    assert total > 100 and hit >= 0.95 * total and ordinary > 100_000 and wrong <= 0.0001 * ordinary


def test_formats_are_learned_from_all_documents_and_whole_texts(spark):
    """A kind that few documents have is learned, however few documents are read for ordinary tokens."""
    words = " ".join(f"ordinary{chr(97 + k)}" for k in range(26)) + " atthevery/end"
    texts = [words] * 400 + [f"key AKIA{'QWERTYUIOPASDFGH'[k:]}{'ZXCVBNM'[:k]}7777" for k in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secrets.learn_formats(frame, sample_docs=5)
    assert set(formats.kinds) == {"access"}
    assert any("/" in step for automaton in formats.ordinary for step in automaton.step)


def test_learned_formats_find_unseen_tokens():
    import random

    r = random.Random(1)
    make = lambda: "ghp_" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(8, 20))) for _ in range(300)]
    formats = secrets.Formats({"assign": secrets.infer([secrets.shape(make()) for _ in range(200)])}, [secrets.infer([secrets.shape(w) for w in words])])
    assert all(formats.kind_of(make()) == "assign" for _ in range(50))
    assert not any(formats.kind_of(w) for w in words)


def test_jaccard(documents, nothing):
    rows = jaccard_join.similarity_components(documents.withColumn("component_id", F.lit("x"))).collect()
    component, size = by_id(rows, "component_id"), by_id(rows, "n_shingles")
    assert len(rows) == len(ROWS) and component[5] == [4] and component[1] == [1, 1] and component[2] == [2] and component[None] == [None]
    assert size[2] == [0] and size[3] == [0] and size[1] == [1, 1] and size[4] == [59_996] and size[7] == [0]
    kept = by_id(jaccard_join.keep_first(documents).collect(), "lang")
    assert 5 not in kept and len(kept[1]) == 2 and None in kept and 3 in kept
    assert jaccard_join.similarity_components(nothing).collect() == []


def test_jaccard_of_many_near_copies(spark):
    """More members of a key than are counted pair by pair, linked only in a chain."""
    base = [f"t{k}" for k in range(300)]
    texts = [" ".join(base[:k] + [f"n{k}"] * 2 + base[k:]) for k in range(0, 300, 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.similarity_components(frame).collect()} == {0}


def test_jaccard_of_a_crowded_key_deals_bounded_tables(spark, monkeypatch, tmp_path):
    """Of a key that one large component and a few other documents have, each table compared is bounded."""
    for name, value in {"TILE": 16, "FEW": 4, "CROWDED": 20, "SALTS": 3}.items():
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    plain, log = jaccard_join._apart, str(tmp_path / "rows")

    def watched(percent):
        inner = plain(percent)

        def run(table):
            with open(log, "a") as out:
                out.write(f"{table.num_rows}\n")
            return inner(table)

        return run

    monkeypatch.setattr(jaccard_join, "_apart", watched)
    base = [f"t{k}" for k in range(300)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k:]) for k in range(5, 295)]
    texts += [" ".join(base[:200] + [f"o{j}x{k}" for k in range(100)]) for j in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(frame).collect()}
    assert got == {d: 0 if d < 290 else d for d in range(300)}
    rows = [int(x) for x in open(log)]
    assert rows and max(rows) <= 500, (max(rows), sum(rows))


def test_jaccard_tiles_pair_all_but_one_component_with_itself(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    component = {d: 0 if d < 40 else 40 if d < 50 else d for d in range(57)}
    frame = spark.createDataFrame([(1, d, c) for d, c in component.items()], "key long, doc_id long, component long")
    rows = jaccard_join._tiled(frame).collect()
    assert sum(len(r.pairs) for r in rows) < 57 * 15 * 2 / 3  # 15 tiles
    for a in rows:
        for b in rows:
            if a.component != b.component:
                assert (min(a.tile, b.tile), max(a.tile, b.tile)) in {tuple(p) for p in a.pairs} & {tuple(p) for p in b.pairs}


def test_mixing(documents, nothing):
    rows = mixing.mix_sources(documents.withColumn("slot", F.lit("x")).withColumn("place", F.lit("y")), block=2).collect()
    assert len(rows) == len(ROWS) and len({(r.slot, r.place) for r in rows}) == len(ROWS)
    assert mixing.mix_sources(nothing).collect() == []
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix_sources(documents, {"a": 1})


def test_html(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
        "<article><h1>Head &amp; line</h1><p>The first of the paragraphs is long enough to be decided by the words that are in it.</p><p>Short  \n one.</p><aside>More</aside><form><p>Sign up</p></form>"
        "<script>var a = '</p><p>no</p>';</script><p>The last of the paragraphs has <b>bold</b> and <a href='#'>linked</a> words in the middle of it all.</p></article>"
        "<section class='comments'><p>I think that this is the best of all the articles that are on the site.</p></section><footer>&copy; Site</footer></body></html>"
    )
    frame = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<article>" + "<p>word and the other</p>" * 20_000 + "</article>")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {}
    for row in html_extraction.extract_text(frame).collect():
        got.setdefault(row.page_id, []).append(row.text)
    wanted = "Head & line\nThe first of the paragraphs is long enough to be decided by the words that are in it.\nShort one.\nThe last of the paragraphs has bold and linked words in the middle of it all."
    assert got[1] == [wanted, wanted] and got[2] == [""] and got[3] == [""] and got[None] == [""] and got[4][0].count("\n") == 19_999
    assert html_extraction.extract_text(frame.limit(0)).collect() == []


PROSE = "<p>The first of the paragraphs is long enough to be decided by the words that are in it.</p>"


@pytest.mark.parametrize(("page", "lines"), [
    (f"<div style='overflow:hidden'>{PROSE}</div>", 1), (PROSE.replace("<p>", "<p title='hidden gem'>"), 1), (f"<div class='content with-sidebar'>{PROSE * 3}</div>", 3),
    (f"<div id='page' class='no-sidebar'><nav><a href='/'>Home</a></nav>{PROSE * 3}<footer>Of the site</footer></div>", 3), (f"<article>{PROSE}<section id='related-work'><h2>Related work</h2>{PROSE}</section></article>", 3),
    (f"<form id='whole'><div class='site-header'>Site</div><article>{PROSE}</article><div class='comments'>{PROSE * 5}</div></form>", 1), (f"<article>{PROSE}</article><section id='comments'><article class='comment'>{PROSE * 9}</article></section>", 1),
    (f"<article>{PROSE}<div hidden>{PROSE}</div><div class='ad'>{PROSE}</div><p>Short.</p></article>", 2), (f"<article>{PROSE * 2}</article>{PROSE * 2}".replace("The first", "A first", 2), 4), ("<article><p>Short.</p><div class='ad'>Buy</div><p>Short, too.</p></article>", 2),
    ("<a href=\"x>text</a><p>lost</p>", 0), ("x &lt; y <a \"> z</a>", 1), ("<p>a <b", 1), ("", 0), (f"<nav><a href='/'>Home</a></nav><h1>Head</h1>{PROSE}<p>Short.</p>", 3),
])
def test_html_names_do_not_decide_alone(page, lines):
    assert len(html_extraction.article_text(page).splitlines()) == lines


@pytest.mark.parametrize("page", ["<article>" + "<p>Short one</p>" * 100_000 + "</article>", "<div>" * 100_000 + "text", '<a "' * 100_000, '<a x=" > " ' * 50_000, "<svg>" * 100_000, "<div class='ad'>" * 50_000 + "word", "<div>" * 50_000 + "</p>" * 50_000])
def test_html_of_very_long_pages(page):
    import time

    began = time.time()
    html_extraction.article_text(page)
    assert time.time() - began < 20


def test_pii_of_many_matches_in_one_text(spark):
    n = 20_000
    text = " ".join(f"server 10.0.{k // 250}.{k % 250} code AB-{k:06d}" for k in range(n))
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [text[x.start : x.end] for x in spans if x.kind == "ip"] == [f"10.0.{k // 250}.{k % 250}" for k in range(n)]


def test_pii_learned_patterns(spark):
    """Unseen identifiers behind contexts that seeds have, and behind others: precision and recall."""
    seen, plain = ("client number", "write to", "login from"), ("order code", "part size", "room name")
    texts = []
    for k in range(120):
        for j, context in enumerate(seen):
            texts.append(f"Here {context} 10.{j}.0.{k} was used.")
        texts.append(f"Then {seen[k % 3]} ID-{k:05d}X was used.")
        texts.append(f"Then {plain[k % 3]} ID-{k:05d}Y was used.")
    found = [texts[row.doc_id][x.start : x.end] for row in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for x in row.spans if x.kind.startswith("like_")]
    assert sorted(found) == [f"ID-{k:05d}X" for k in range(120)]


def test_pii_contexts_are_whole(spark):
    """A long context is not cut, and one ends at the match before it."""
    long = "a" * 70
    frame = spark.createDataFrame([(1, f"{long} {long}: 10.0.0.1, 10.0.0.2")], "doc_id long, text string")
    base = pii.scan(frame).first().base
    assert [x.context for x in base] == [f"{long} {long}: ", ""]


def test_pii(spark, documents, nothing):
    spans = by_id(pii.find_pii(documents.withColumn("spans", F.lit("x"))).collect(), "spans")
    assert [x.kind for x in spans[8][0]] == ["email"] and spans[3] == [[]] and spans[1] == [[], []] and spans[None] == [[]]
    assert pii.find_pii(nothing).collect() == []
    # one pattern introduces several seeds, and then an identifier that no base pattern knows
    texts = [(k, f"Words here. client number {ip} is known") for k, ip in enumerate(["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", "10.0.0.5", "10.0.0.6", "10.0.0.7", "10.0.0.8", "10.0.0.9"])] + [(99, "Words here. client number AB-123456 is known")]
    found = by_id(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect(), "spans")
    assert [(x.kind, x.start, x.end) for x in found[99][0]] == [("like_ip", 26, 35)]


def test_toxicity_of_repeated_documents(spark):
    words = "alpha beta gamma delta".split()
    texts = [(k, f"{words[k % 4]} common words {'awful insult' if k % 3 == 0 else 'kind praise'}") for k in range(120)]
    frame = spark.createDataFrame(texts * 3 + [(200, "x " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)] + [(200, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(frame, labels)
    assert all(r.is_toxic == (r.doc_id % 3 == 0) for r in toxicity.score(frame, chain).collect() if r.doc_id != 200)


def test_toxicity(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(documents, labels)
    rows = toxicity.score(documents.withColumn("is_toxic", F.lit("x")), chain).collect()
    assert len(rows) == len(ROWS) and not any(r.is_toxic for r in rows)
    assert toxicity.score(nothing, toxicity.train(nothing, labels.limit(0))).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, documents, nothing, sf_dir, tmp_path, empty):
    docs = (nothing if empty else documents).withColumn("block", F.lit("x")).withColumn("is_toxic", F.lit("y"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = number == len(corpus_pipeline.STAGES) - 1
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if not last:
            assert after.columns == docs.columns
        docs = after
    rows = docs.collect()
    assert {"block", "slot", "place", "is_toxic"} <= set(docs.columns)
    # Of the two long copies the first stays; the two rows of document 1 stay, and the secrets are masked.
    assert sorted((r.doc_id or 0 for r in rows)) == ([] if empty else [0, 1, 1, 2, 3, 4, 6, 7, 8])
    assert [r.text for r in rows if r.doc_id == 8] == ([] if empty else ["[secret] [secret] a@b.example"])
