"""The manifest against a plain version, on a table with every odd case, and at other fans."""

import collections
import hashlib
import random
import zlib

import pytest

from quarry.llm import merkle_manifest as m

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def climb(nodes, fan):
    """The top of a list of nodes, and the siblings before and after each, level by level."""
    where, walks = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[k : k + fan] for k in range(0, len(nodes), fan)]
        for leaf_at, at in enumerate(where):
            run = runs[at // fan]
            walks[leaf_at].append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
            where[leaf_at] = at // fan
        nodes = [h(*run) for run in runs]
    return nodes[0], walks


def plain(rows, fan):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = {}, collections.Counter()
    for name in names:
        by[name].sort(key=lambda x: x[:3])
        tops[name] = climb([x[2] for x in by[name]], fan)
    root, upper = climb([tops[name][0] for name in names], fan)
    for name, above in zip(names, upper, strict=True):
        for (_, _, own, row), walk in zip(by[name], tops[name][1], strict=True):
            text, steps = row[1], walk + above
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for before, after in steps:
                node = h(before, node, after)
            out[row[0], own, tops[name][0], root, h(*(b + a for b, a in steps)), node, node == root] += 1
    return out


ROWS = [(1, "Alpha", "en", "a", 5), (1, "Alpha", "en", "a", 5), (2, "", "en", None, 0), (3, None, None, "b", None), (None, "alpha", "en", "a", 16), (4, "X" * 300_000, "en", "b", 4), (5, "ÄB c\n", "", "", 3), (7, "é", "en", "é", 1), (8, "E", "en", "z", 1)]
MANY = [(k * 3 - 50, random.Random(k).choice(["Text A", "text", None, "ÉCOLE Z"]), "en", random.Random(k).choice(["hot", "hot", "hot", f"s{k % 40}", None]), k) for k in range(700)]


@pytest.mark.parametrize("rows, fan", [(ROWS, 16), (ROWS, 2), (MANY, 16), (MANY, 3), (ROWS[:1], 16), (MANY[:17] * 2, 16)])
def test_manifest(spark, tmp_path, monkeypatch, rows, fan):
    monkeypatch.setattr(m, "FAN", fan)
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS place", "2 AS n", "'x' AS digest", "'y' AS _tree")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert collections.Counter(map(tuple, m.op12_merkle_manifest(spark, str(tmp_path)).collect())) == plain(rows, fan)


def test_nothing_and_paths(spark):
    nothing = spark.createDataFrame([], SHAPE)
    assert m.audited(m.manifest(nothing)).collect() == []
    rows = m.manifest(spark.createDataFrame(MANY, SHAPE)).collect()
    assert len(rows) == len(MANY) and all(step.run[step.place] == row.leaf for row in rows for step in row.path[:1] if row.subroot != row.leaf)
