"""Repair of conversations against a plain version: every edit sequence by a search over whole audits."""

import collections
import functools
import hashlib
import random
import re
import zlib

from quarry.llm import conversation_repair as c

SHAPE = "conv_id long, turn long, role string, text string"
MOVE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text, k) for k in range(0 if rule == 0 else 2 if rule == 3 else 1)]
    return out


def best(rows, faults):
    """(cost, audit, repaired lines), least in that order: from the end, over whole strings."""

    @functools.cache
    def go(at, state, inserted):
        found = [(0, "", ())] if at == len(rows) and state in (0, 3) else []
        if inserted < 3:
            for r in "ua":
                if (state, r) in MOVE:
                    cost, audit, lines = go(at, MOVE[state, r], inserted + 1)
                    found.append((cost + 5, "I" + audit, (f"{FULL[r]}:",) + lines))
        if at < len(rows):
            role, text = rows[at][2], rows[at][3]
            cost, audit, lines = go(at + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[at] in ("", "truncated"):
                late = 5 * (faults[at] == "truncated")
                if (state, role[:1]) in MOVE:
                    cost, audit, lines = go(at + 1, MOVE[state, role[:1]], 0)
                    found.append((cost + late, "K" + audit, (f"{role}:{text}",) + lines))
                for r in "ua":
                    if (state, r) in MOVE:
                        cost, audit, lines = go(at + 1, MOVE[state, r], 0)
                        found.append((cost + 1 + late, "R" + audit, (f"{FULL[r]}:{text}",) + lines))
        return min(found, default=(10**9, "~", ()))

    for at in range(len(rows), -1, -1):  # from the end, so that no call is deep
        for state in range(4):
            go(at, state, 0)
    return go(0, 0, 0)


def plain(rows):
    by, out = collections.defaultdict(list), {}
    for row in damage(rows):
        by[row[0]].append(row)
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest(), r[4]))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            words = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = best(tuple(own), tuple(faults))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)), lines
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in c.repair(c.damaged(spark.createDataFrame(rows, SHAPE).selectExpr("*", "'x' AS at", "1 AS run", "'y' AS sign"))).collect()}
    wanted = plain(rows)
    assert got.keys() == wanted.keys()
    assert {k: (got[k], v) for k, v in wanted.items() if got[k] != v} == {}


def test_any_conversations(spark):
    r = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?  \n", "ä ", "Long. " * 50, "same.", "same."]
    rows = []
    for conv in range(700):
        roles = r.choice(["su" + "au" * 5, "uauauaua", "saua", "aauuss", "xyz", "ua"])
        for turn in range(r.randint(1, 12)):
            role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "y": "", "z": None}[roles[turn % len(roles)] if r.random() < 0.7 else r.choice("suaxyz")]
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn // 2, None]), role, r.choice(texts)))
    check(spark, rows)


def test_one_long_conversation_and_many_alike(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(6)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "the same text." if t % 3 else f"text {t}.") for t in range(900)]
    rows += [(conv, t, r.choice(["user", "assistant"]) if t > 1 else "user", f"text {t}." * 9) for conv in range(2, 400) for t in range(3)]
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_nothing_and_layers(spark):
    check(spark, [(0, 0, "user", "Hi."), (0, 0, "user", "Hi."), (3, 5, "assistant", "A." * 200_000), (4, 0, "system", "S.")])
    assert c.repair(c.damaged(spark.createDataFrame([], SHAPE))).collect() == []


def test_table(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
