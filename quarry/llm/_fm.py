"""A compressed full-text index of one shard: BWT in a wavelet matrix, plus sampled suffix positions.

Symbols are integers from 0 to sigma - 1; 0 separates texts and never matches. All searches run many
patterns in lockstep, one backward step of every live pattern at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, sigma: int, depth: int | None = None) -> np.ndarray:
    """Suffixes in order, by prefix doubling over what is still tied.

    A comparison ends at a separator; ties there go by position. With ``depth``, suffixes that agree
    on that many symbols may come in any order, which is enough to count patterns up to that length.
    """
    n = len(symbols)
    bits, place = max(1, int(sigma - 1).bit_length()), n.bit_length()
    packed = max(1, (62 - place) // bits)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(packed):
        here = np.zeros(n, np.int64)
        here[: max(0, n - j)] = symbols[j:]
        key = (key << bits) | np.where(live, here, 0)
        live &= here != 0
    key = (key << place) | np.where(live, 0, np.arange(n))
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n + 1, bool)
    head[1:n] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    tied = np.flatnonzero(~(head[:n] & head[1:]))
    h = packed
    while len(tied) and (depth is None or h < depth):
        suffix = order[tied]
        after = suffix + h
        key = (rank[suffix] << (place + 1)) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[tied] = suffix
        head = np.ones(len(tied) + 1, bool)
        head[1:-1] = key[1:] != key[:-1]
        rank[suffix] = tied[np.maximum.accumulate(np.where(head[:-1], np.arange(len(tied)), 0))]
        tied = tied[~(head[:-1] & head[1:])]
        h *= 2
    return order


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32 if n < 2**31 else np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """symbols: the shard's texts, each followed by 0. sample: distance of the kept suffix positions, 0 for none.

    With depth, order is the whole suffix order, for the caller to draw from and drop.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int | None = None, sample: int = 16):
        symbols = np.asarray(symbols, np.int64)
        order = suffix_order(symbols, sigma, depth)
        self.n, self.sigma = len(symbols), sigma
        self.levels: list[tuple[Bits, int, int]] = []
        now = symbols[order - 1]
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            zeros = now[~bit]
            self.levels.append((Bits(bit), len(zeros), level))
            now = np.concatenate([zeros, now[bit]])
        self.start = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=self.start[1:])
        every = np.arange(sigma)
        self.base = self._down(every, np.zeros(sigma, np.int64))
        self.order = None
        if depth is not None:
            self.order = order
        elif sample:
            # the first position of each text as well: separators sort by position, so no walk may cross one
            kept = (order % sample == 0) | (symbols[order - 1] == 0)
            self.marks, self.positions = Bits(kept), order[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, zeros, level in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with symbol and go on as those in [lo, hi)."""
        n = len(symbol)
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])).astype(np.int64)
        offset = self.start[symbol] - self.base[symbol]
        return both[:n] + offset, both[n:] + offset

    def whole(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[symbol], self.start[symbol + 1]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of whole patterns: row i holds lengths[i] symbols, none of them 0."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, (int(lengths.max()) if len(lengths) else 0) + 1):
            live = np.flatnonzero((lengths >= back) & (hi > lo))
            lo[live], hi[live] = self.step(patterns[live, lengths[live] - back], lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        rows, walked = np.array(rows, np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_ := open_[self.marks.get(rows[open_]) == 0]):
            at, symbol = rows[open_], np.zeros(len(open_), np.int64)
            for bits, zeros, level in self.levels:
                bit, ones = bits.get(at).astype(np.int64), bits.rank(at)
                symbol |= bit << level
                at = np.where(bit, zeros + ones, at - ones)
            rows[open_] = at + self.start[symbol] - self.base[symbol]
            walked[open_] += 1
        return (self.positions[self.marks.rank(rows)] + walked) % self.n


class SmallestOwner:
    """The least owner among the suffixes of a range: the owners in suffix order, as ranks, in a wavelet matrix of their own."""

    def __init__(self, owners: np.ndarray):
        self.values, now = np.unique(owners, return_inverse=True)
        self.levels: list[tuple[Bits, int]] = []
        for level in range(max(1, int(len(self.values) - 1).bit_length()) - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            zeros = now[~bit]
            self.levels.append((Bits(bit), len(zeros)))
            now = np.concatenate([zeros, now[bit]])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of [lo, hi), which must not be empty: at each level the half with a zero bit, if there is any."""
        rank = np.zeros(len(lo), np.int64)
        for bits, zeros in self.levels:
            a, b = bits.rank(lo), bits.rank(hi)
            up = (b - a) == (hi - lo)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
            rank = (rank << 1) | up
        return self.values[rank]
