"""Repair of conversations: the cheapest edits that give each the turns of an optional system, then user and assistant.

A conversation is put in order by a distributed sort, so that a long one is many short runs; each row becomes one
sign, its role's initial and its first fault, and the signs of a conversation in order are its signature. Distinct
signatures, sorted, are paths of a prefix trie: a task walks it with the layers of the current path on a stack, so
what signatures share at their start is computed once; at the end of a signature the cheapest edits are read
off, of equally cheap ones the least in ASCII. The edits then meet the rows in a stream, which hashes what is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import hot_keys, small_batches, spread_join, stored

#: White space between words, as characters.
SPACE = " \t\n\x0b\f\r"
#: The costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Initials of roles, and faults: none, blank, duplicate, truncated. A sign is a letter for each pair of them.
_INITIALS, _FAULTS = "sua?", "-bdt"
_SIGNS = "ABCDEFGHIJKLMNOP"
#: States while rows are read: nothing yet, after system, after user, after assistant; a row that is read moves them so.
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)
_FAR = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, by the rule of op13: a row drops out, loses its text or its stops, comes twice or gets the role user.

    The rule is the CRC-32 of `conv_id:turn` modulo 20; null values count as one space, in it and in role and text.
    A row that drops out stays with a null copy, so that its conversation is known; others have copy 0, or 0 and 1.
    """
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", words("role").alias("role"), words("text").alias("text"), rule.alias("rule"))
    text = F.when(F.col("rule") == 1, F.lit("")).when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("rule") == 0, F.array(F.lit(None).cast("int"))).when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("rule") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with `at`, ascending through each conversation, and the run (task of the sort) that each is in; stored."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy"]
    rows = rows.withColumn("digest", F.sha2("text", 256))
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)))


def _signed(rows: DataFrame) -> DataFrame:
    """conv_id, run, at, sign of each row: its role's initial and its first fault."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    key = ["conv_id", "role", "digest"]
    own = rows.select("conv_id", "run", "at", "role", "digest", last.alias("last"), F.xxhash64(*key).alias("key"))
    first = own.groupBy("key", *key).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").groupBy("key").agg(F.collect_list(F.struct(*key, "first")).alias("firsts"))
    # Texts that a conversation has twice are few keys, and one of them may be most of its rows.
    own = spread_join(own, first, "key", "at", hot_keys(own, "key"), "left")
    same = F.exists("firsts", lambda x: x["conv_id"].eqNullSafe(F.col("conv_id")) & (x["role"] == F.col("role")) & (x["digest"] == F.col("digest")) & (x["first"] < F.col("at")))
    fault = F.when(F.col("last") == "", 1).when(F.coalesce(same, F.lit(False)), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return own.select("conv_id", "run", "at", F.substring(F.lit(_SIGNS), (kind * 4 + fault + 1), F.lit(1)).alias("sign"))


def _layer(before: list[int], sign: str) -> list[int]:
    """Least costs of the states after one more row, inserts behind it included."""
    initial, fault = _INITIALS[_SIGNS.index(sign) // 4], _FAULTS[_SIGNS.index(sign) % 4]
    after = [x + DELETE for x in before]
    if fault in "-t":
        late = TRUNCATED * (fault == "t")
        for role in "sua":
            price = late + (KEEP if role == initial else REROLE if role in "ua" else _FAR)
            for state, to in _MOVES[role].items():
                after[to] = min(after[to], before[state] + price)
    return _inserted(after)


def _inserted(layer: list[int]) -> list[int]:
    for _ in range(2):
        for role in "ua":
            for state, to in _MOVES[role].items():
                layer[to] = min(layer[to], layer[state] + INSERT)
    return layer


_START = _inserted([0, _FAR, _FAR, _FAR])


#: In each state one role may come next, but for a system row that is kept at the start.
_NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}


def _edits(signature: str, at: int, state: int) -> Iterator[tuple[str, int, int, int, str]]:
    """Edits possible at a place and state, by letter: letter, cost, next place, next state, and what it does to the rows.

    What it does: k keeps a row, d deletes it, u and a give it that role, U and A insert a row.
    """
    role, to = _NEXT[state], _MOVES[_NEXT[state]][state]
    initial, fault = (_INITIALS[_SIGNS.index(signature[at]) // 4], _FAULTS[_SIGNS.index(signature[at]) % 4]) if at < len(signature) else ("", "")
    if fault:
        yield "D", DELETE, at + 1, state, "d"
    yield "I", INSERT, at, to, role.upper()
    if fault and fault in "-t":
        late = TRUNCATED * (fault == "t")
        if initial in _MOVES and state in _MOVES[initial]:
            yield "K", KEEP + late, at + 1, _MOVES[initial][state], "k"
        yield "R", REROLE + late, at + 1, to, role


def _cheapest(signature: str, layers: list[list[int]]) -> tuple[int, str, str]:
    """Cost, audit and acts of the cheapest edits, by the costs of the layers; of ties the least audit in ASCII.

    A letter leads from a state to one other, so the least audit is the least letter at each step that stays on a cheapest way.
    """
    n = len(signature)
    cost = min(layers[n][state] for state in _ENDS)
    good = bytearray(n + 1)  # of each place the states on a cheapest way, as bits
    good[n] = sum(1 << state for state in _ENDS if layers[n][state] == cost)
    stays = lambda at, state: (x for x in _edits(signature, at, state) if good[x[2]] >> x[3] & 1 and layers[x[2]][x[3]] == layers[at][state] + x[1])
    for at in range(n, -1, -1):
        for _ in range(3):  # inserts lead to states of the same place
            for state in range(4):
                if layers[at][state] < _FAR and any(stays(at, state)):
                    good[at] |= 1 << state
    at = state = 0
    audit, acts = [], []
    while not (at == n and state in _ENDS and layers[n][state] == cost):
        letter, _, at, state, act = next(stays(at, state))
        audit.append(letter)
        acts.append(act)
    return cost, "".join(audit), "".join(acts)


_SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, acts string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of sorted signatures: the stack holds the layers of the path to the current one."""
    path, layers = "", [_START]
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            shared = _common(path, signature)
            del layers[shared + 1 :]
            for sign in signature[shared:]:
                layers.append(_layer(layers[-1], sign))
            path = signature
            faults = [sum(signature.count(_SIGNS[4 * kind + fault]) for kind in range(4)) for fault in (1, 2, 3)]
            initials = "".join(_INITIALS[_SIGNS.index(sign) // 4] for sign in signature)
            legal = initials.count("su") + initials.count("ua") + initials.count("au")
            rows.append((signature, *faults, max(0, len(signature) - 1) - legal, *_cheapest(signature, layers)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in _SOLVED.split(", ")])


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


_DIGEST = "conv_key string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation. Its acts come first, then its rows in order; they are hashed as they come."""
    key = acts = digest = None
    done = lines = 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        lines += 1

    def inserts() -> None:
        nonlocal done
        while done < len(acts) and acts[done] in "UA":
            line("user" if acts[done] == "U" else "assistant", "")
            done += 1

    for batch in batches:
        out = []
        for own, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "at", "role", "text")), strict=True):
            if at < 0:
                if key is not None:
                    inserts()
                    out.append((key, digest.hexdigest()))
                key, acts, digest, done, lines = own, text, hashlib.sha256(), 0, 0
                continue
            inserts()
            act = acts[done]
            done += 1
            if act != "d":
                line({"k": role, "u": "user", "a": "assistant"}[act], text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_key", "repaired_sha256"])
    if key is not None:
        inserts()
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["conv_key", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text, copy, as of damaged(); rows with a null copy only say that a conversation is
    there. Rows are in order of turn (null first), then role, the SHA-256 of the text, and copy. Null conv_ids are one
    conversation. A null role or text counts as one space, as does a role that starts with none of s, u and a: its row
    can be deleted or get another role. Rows without any text but white space are blank and never duplicates.
    Texts of any length are hashed as they come. A conversation without rows has zeros, an empty audit and the hash
    of nothing. Other columns are ignored; an empty table gives no rows. A conversation's own audit is one value, so
    one that holds most rows must fit in a string of a character per row, and its final hash is one task's stream.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copy")
    ordered = _in_order(rows)
    live = ordered.where("copy is not null")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv_key")
    turns = F.when(F.col("copy").isNotNull(), F.col("turn"))
    gaps = F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0)).cast("long")
    every = ordered.groupBy("conv_id").agg(gaps.alias("gaps")).select("conv_id", "gaps", key)
    # A run's signs are at most the rows of one task of the sort; the runs of a conversation are joined in order.
    pieces = _signed(live).groupBy(key, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sign"))), lambda x: x["sign"]), "").alias("signs"))
    whole = pieces.groupBy("conv_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "signs"))), lambda x: x["signs"]), "").alias("signature"))
    whole = stored(every.join(whole, "conv_key", "left").withColumn("signature", F.coalesce("signature", F.lit(""))))
    distinct = whole.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    solved = stored(distinct.mapInArrow(_solve, _SOLVED))
    named = whole.withColumn("sign_key", F.xxhash64("signature"))
    # A signature may be that of most conversations.
    by_key = solved.withColumn("sign_key", F.xxhash64("signature")).groupBy("sign_key").agg(F.collect_list(F.struct("*")).alias("found"))
    found = spread_join(named, by_key, "sign_key", "conv_key", hot_keys(named, "sign_key")).withColumn("found", F.filter("found", lambda x: x["signature"] == F.col("signature"))[0])
    found = stored(found.select("conv_id", "conv_key", "gaps", "found.*").drop("signature"))
    acts = found.select("conv_key", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("acts").alias("text"))
    stream = acts.unionAll(live.select(key, "at", "role", "text")).repartition("conv_key").sortWithinPartitions("conv_key", "at")
    digests = small_batches(stream).mapInArrow(_digests, _DIGEST)
    return found.join(digests, "conv_key").drop("conv_key", "acts")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
