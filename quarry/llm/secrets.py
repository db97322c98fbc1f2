"""Secret scans: base patterns, and formats learned by grammar inference.

The base patterns' matches in all documents, a bounded number of each kind by a hash, are labelled credentials. From each kind a
prefix tree of character classes is built, and states whose outgoing frequencies are compatible (Hoeffding
bound) are merged to a probabilistic automaton (ALERGIA, Carrasco and Oncina 1994). All tokens that touch no
base match and have as many characters as the shortest credential may have (8) are scored, whatever they are:
likelihood under each credential automaton against those of ordinary tokens without and with a digit.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import small_batches, stored
from quarry.llm._words import chunks

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_DIGIT = re.compile(r"[0-9]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that are scored.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Documents read for ordinary tokens; strings of a kind, at least and at most, and characters of one, from which formats are learned; Hoeffding risk; log-likelihood ratio a character and in all.
SAMPLE_DOCS, LEAST_STRINGS, SAMPLE_STRINGS, STRING_CHARS, RISK, PER_CHAR, IN_ALL = 5000, 5, 300, 256, 0.05, 0.5, 12.0
#: Character classes: digits, a-f, other lower case, A-F, other upper case; any other character is its own.
_CLASSES = str.maketrans({c: k for k, own in {"0": "0123456789", "a": "abcdef", "l": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in own})


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, the credential itself) of the base patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def shape(token: str) -> str:
    return token.translate(_CLASSES)


@dataclass
class Automaton:
    """A probabilistic automaton: per state, the log probability of each symbol and of ending."""

    step: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    end: list[float] = field(default_factory=list)
    floor: float = math.log(1e-3)

    def log_likelihood(self, word: str) -> float:
        """A symbol that a state never saw costs floor and leaves the state as it is."""
        at, total = 0, 0.0
        for c in word:
            at, p = self.step[at].get(c, (at, self.floor))
            total += p
        return total + self.end[at]


def infer(words: list[str], risk: float = RISK) -> Automaton:
    """ALERGIA: merges blue states into compatible red ones, in order of the prefixes."""
    visits, ends, children = [0], [0], [{}]  # of the prefix tree, then of the merged automaton
    counts: list[dict[str, int]] = [{}]
    for word in sorted(words):
        at = 0
        visits[0] += 1
        for c in word:
            counts[at][c] = counts[at].get(c, 0) + 1
            if c not in children[at]:
                children[at][c] = len(visits)
                visits.append(0)
                ends.append(0)
                children.append({})
                counts.append({})
            at = children[at][c]
            visits[at] += 1
        ends[at] += 1
    width = math.sqrt(0.5 * math.log(2 / risk))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            x, y = waiting.pop()
            if not visits[x] or not visits[y]:
                continue
            if differ(ends[x], visits[x], ends[y], visits[y]):
                return False
            for c in counts[x].keys() | counts[y].keys():
                if differ(counts[x].get(c, 0), visits[x], counts[y].get(c, 0), visits[y]):
                    return False
                if c in children[x] and c in children[y] and children[x][c] != children[y][c]:
                    waiting.append((children[x][c], children[y][c]))
        return True

    def fold(into: int, tree: int) -> None:
        waiting = [(into, tree)]
        while waiting:
            x, y = waiting.pop()
            visits[x] += visits[y]
            ends[x] += ends[y]
            for c, n in counts[y].items():
                counts[x][c] = counts[x].get(c, 0) + n
                if c in children[x]:
                    waiting.append((children[x][c], children[y][c]))
                else:
                    children[x][c] = children[y][c]

    red = [0]
    blue = [(0, c) for c in sorted(children[0])]
    while blue:
        parent, symbol = blue.pop(0)
        state = children[parent][symbol]
        if state in red:
            continue
        for old in red:
            if compatible(old, state):
                children[parent][symbol] = old
                fold(old, state)
                break
        else:
            red.append(state)
        blue = [(r, c) for r in red for c in sorted(children[r]) if children[r][c] not in red]
    number = {state: k for k, state in enumerate(red)}
    out = Automaton()
    for state in red:
        total = visits[state] + 1
        out.step.append({c: (number[children[state][c]], math.log(n / total)) for c, n in counts[state].items()})
        out.end.append(math.log((ends[state] + 0.5) / total))
    return out


@dataclass
class Formats:
    """Learned automata."""

    kinds: dict[str, Automaton]
    ordinary: list[Automaton]
    known: dict[str, str | None] = field(default_factory=dict)  # kinds of shapes already scored; emptied when it is large

    def kind_of(self, token: str) -> str | None:
        """The likeliest credential format of a token, or None if an ordinary token is about as likely."""
        word = shape(token)
        if word not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[word] = self._scored(word)
        return self.known[word]

    def _scored(self, word: str) -> str | None:
        if not self.kinds:
            return None
        other = max((automaton.log_likelihood(word) for automaton in self.ordinary), default=len(word) * math.log(1 / 16))
        best, kind = max((automaton.log_likelihood(word), kind) for kind, automaton in self.kinds.items())
        return kind if best - other >= max(IN_ALL, PER_CHAR * len(word)) else None


def apart(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[re.Match]:
    """Tokens of 8 characters and more that touch no base span: one sweep over both, by start."""
    at, end = 0, 0
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            end = max(end, base[at][1])
            at += 1
        if end <= m.start():
            yield m


def secret_spans(text: str, formats: Formats | None) -> list[tuple[int, int, str]]:
    """Base spans, and like_<kind> spans of tokens that touch none of them."""
    base = base_spans(text)
    out = [(a, b, kind) for a, b, kind, _ in base]
    if formats is not None and formats.kinds:
        out += [(m.start(), m.end(), f"like_{kind}") for m in apart(text, base) if (kind := formats.kind_of(m[0]))]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]]))


_ORDER = {kind: k for k, kind in enumerate((*KINDS, *(f"like_{kind}" for kind in KINDS)))}


def _order(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _lowest(kind: str, tokens: set[str], most: int) -> list[tuple[int, str, str]]:
    return heapq.nsmallest(most, ((_order(token), token, kind) for token in tokens))


def _examples(own: bool, most: int, chars: int):
    """(h, token, kind) of credentials or, as kinds 'word' and 'number', of ordinary tokens without and with a digit, of 8 to chars characters: those of the lowest hashes of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found: dict[str, set[str]] = {}
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    if own:
                        for _, _, kind, token in base:
                            if len(token) <= chars:
                                found.setdefault(kind, set()).add(token)
                    else:
                        for m in apart(text or "", base):
                            if m.end() - m.start() <= chars:
                                found.setdefault("number" if _DIGIT.search(m[0]) else "word", set()).add(m[0])
                rows = [row for kind, tokens in found.items() for row in _lowest(kind, tokens, most)]
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["h", "token", "kind"])

    return run


def learn_formats(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS, string_chars: int = STRING_CHARS, least_strings: int = LEAST_STRINGS) -> Formats:
    """Automata of the sample_strings distinct credentials of a kind, by a hash, over all documents.

    As many ordinary tokens without a digit, and with one, by the same hash, are from the whole texts of
    sample_docs documents, by a hash of doc_id.
    Only strings of at most string_chars characters are learned from; a kind with fewer than least_strings
    of them has no automaton, so that nothing is found like it.
    """
    ids = documents.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    texts = small_batches(documents).join(F.broadcast(ids), "doc_id").select("text")  # at most sample_docs ids
    shape_of = "h long, token string, kind string"
    examples = lambda df, own: df.mapInArrow(_examples(own, sample_strings, string_chars), shape_of)
    rows = stored(examples(documents.select("text"), True).unionAll(examples(texts, False)).distinct())
    learned: dict[str, Automaton] = {}
    for kind in (*KINDS, "word", "number"):  # each the lowest of what every task sends, so no task gets all of a kind
        words = [row["token"] for row in rows.where(F.col("kind") == kind).orderBy("h", "token").limit(sample_strings).collect()]
        if len(words) >= least_strings:
            learned[kind] = infer([shape(word) for word in words])
    ordinary = [learned.pop(kind) for kind in ("word", "number") if kind in learned]
    return Formats(learned, ordinary)


def _found(formats: Formats, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0]):
                spans = [[{"start": a, "end": b, "kind": kind} for a, b, kind in secret_spans(text, formats)] if text else [] for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*part.columns, pa.array(spans, schema.types[-1])], schema.types, strict=True)], schema=schema)

    return run


def find_secrets(documents: DataFrame, formats: Formats | None = None) -> DataFrame:
    """documents with secrets, an array of (start, end, kind) in code points, end exclusive; a column of that name gives way.

    formats: as learned, by default from documents. A null text has no secrets; repeated rows are each
    answered; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    formats = learn_formats(documents) if formats is None else formats
    base = small_batches(documents).select("text", *(c for c in documents.columns if c not in ("text", "secrets")))
    extra = documents.sparkSession.createDataFrame([], "secrets array<struct<start:long,end:long,kind:string>>").schema
    schema = type(extra)([*base.schema.fields, *extra.fields])
    return base.mapInArrow(_found(formats, to_arrow_schema(schema)), schema)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """text with what the spans cover, by start, replaced by mask; spans that overlap or touch are one."""
    out, done, open_ = [], 0, False
    for a, b, _ in spans:
        if not open_ or a > done:
            out += [text[done:a], mask]
            open_ = True
        done = max(done, b)
    return "".join([*out, text[done:]])


def _redacted(formats: Formats, mask: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0]):
                texts = [text and masked(text, secret_spans(text, formats), mask) for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()).cast(schema.types[0]), *(x.cast(t) for x, t in zip(part.columns[1:], schema.types[1:], strict=True))], schema=schema)

    return run


def redact(documents: DataFrame, formats: Formats | None = None, mask: str = "[secret]") -> DataFrame:
    """documents with every secret replaced by mask; overlapping spans are one. n_chars, where there is one, is counted anew.

    Null and empty texts stay as they are; repeated rows are each masked; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    formats = learn_formats(documents) if formats is None else formats
    base = small_batches(documents).select("text", *(c for c in documents.columns if c != "text"))
    out = base.mapInArrow(_redacted(formats, mask, to_arrow_schema(base.schema)), base.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(documents.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*documents.columns)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every document of the table; formats learned from its base matches."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in KINDS), F.sha2(named(base), 256).alias("base_sha256"), named("secrets").alias("spans"))


QUERIES = {"op5_secret_scans": op5_secret_scans}
