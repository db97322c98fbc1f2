"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a whole chunk of texts at once: a byte
table says which bytes belong to words, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk by itself.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(word_byte) -> np.ndarray:
    return np.array([word_byte(b) for b in range(256)], bool)


#: Words are runs of anything but white space: [^\x20\x09-\x0D]+
PLAIN = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and all non-ASCII characters (after lower-casing).
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result can be used."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of a chunk: byte spans into ``data``, and for each text its range of words."""

    data: np.ndarray  # bytes as stored
    seen: np.ndarray  # bytes as compared (lower-cased if asked for)
    text_at: np.ndarray  # texts + 1 byte offsets
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # texts + 1 word offsets

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.seen)
        if not n:
            return np.empty(0, np.uint64)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.seen.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def chars_before(self) -> np.ndarray:
        """For each byte offset, the code points before it in the chunk."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def split(column: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """Split every text of a string column; null texts have no words."""
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    if column.null_count:  # bytes below a null slot do not count
        lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if lengths.sum() != at[-1]:
            return split(pa.array(["" if x is None else x for x in column.to_pylist()], pa.large_string()), word_bytes, lower)
    seen = _LOWER[data] if lower else data
    inside = word_bytes[seen]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, seen, at, starts, ends, np.searchsorted(starts, at))


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; whole rows only."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    total = np.cumsum(lengths)
    row = 0
    while row < batch.num_rows:
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x8CB92BA72F3D8DD7) + words[j : j + len(out)]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by block prefix and suffix minima."""
    n = len(values)
    if n < width or width < 2:
        return values if width < 2 else values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[: n - width + 1], down[width - 1 : n])
