"""An FM-index over integer symbols: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text, a suffix position is kept.
SAMPLE = 8
_WORD = 64


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq must end in its only smallest symbol, so suffixes differ."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k, top = 1, int(rank.max()) + 1
    order = np.argsort(rank, kind="stable")
    while top < n:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        top = int(rank[order[-1]]) + 1
        k *= 2
    return order


class Bits:
    """A bitmap with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, b = at // _WORD, (at % _WORD).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at // _WORD] >> (at % _WORD).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: one bitmap for each bit of the symbols, zeros before ones from level to level."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.levels, self.zeros, self.depth = [], [], depth
        for level in range(depth):
            bit = (seq >> (depth - 1 - level)) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(seq) - self.levels[-1].ones)
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for level in range(self.depth):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            lo1, hi1 = self.levels[level].rank(lo), self.levels[level].rank(hi)
            lo = np.where(one, self.zeros[level] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[level] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each position's symbol, and how often it stands before there."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.depth):
            one = self.levels[level].get(at)
            a1, l1 = self.levels[level].rank(at), self.levels[level].rank(lo)
            at = np.where(one, self.zeros[level] + a1, at - a1)
            lo = np.where(one, self.zeros[level] + l1, lo - l1)
            symbol = symbol << 1 | one
        return symbol, at - lo


class FMIndex:
    """Over seq, of symbols 1 to sigma - 1; 0 is put behind it as its end."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.append(np.asarray(seq, np.int64), 0)
        order = suffix_array(seq)
        self.wavelet = Wavelet(seq[order - 1], max(1, int(sigma - 1).bit_length()))
        counts = np.bincount(seq, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        kept = order % sample == 0
        self.kept, self.positions, self.n = Bits(kept), order[kept], len(seq)

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that begin with each pattern (rows of one length), found backwards."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.first[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walked back to a sampled one."""
        out, steps, left, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(left):
            hit = self.kept.get(at)
            out[left[hit]] = self.positions[self.kept.rank(at[hit])] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            if len(left):
                symbol, rank = self.wavelet.access(at)
                at = self.first[symbol] + rank
        return out
