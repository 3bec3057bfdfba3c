"""A compressed full-text index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet matrix."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class BitVector:
    """Bits in 64-bit words with a running count per word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """One bit vector for each bit of a symbol, high bits first; zeros go before ones at each level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        row = symbols
        for shift in range(self.bits - 1, -1, -1):
            ones = ((row >> shift) & 1).astype(bool)
            self.levels.append(BitVector(ones))
            self.zeros.append(int(len(row) - ones.sum()))
            row = np.concatenate((row[~ones], row[ones]))
        every = np.arange(n_symbols, dtype=np.int64)
        self.first = self._down(every, np.zeros(n_symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - depth)) & 1
            ones = level.rank(at)
            at = np.where(one == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.first[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & ONE).astype(np.int64)
            ones = level.rank(at)
            symbol = (symbol << 1) | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; each 0 is a separator unlike any other, so no match crosses one.

    After a round only suffixes still tied with another are sorted again."""
    n = len(symbols)
    gaps = symbols == 0
    n_gaps = int(gaps.sum())
    rank = symbols.astype(np.int64) + n_gaps
    rank[gaps] = np.arange(n_gaps)
    order = np.argsort(rank, kind="stable")
    rank = _heads(rank[order])[_inverse(order)]
    step = 1
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        ahead = who + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1) + 1
        key = rank[who] * (n + 1) + second
        local = np.argsort(key, kind="stable")
        order[at] = who[local]
        key = key[local]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[who[local]] = heads
        step *= 2


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For a sorted array, each entry's first position among its equals."""
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


class FMIndex:
    """Backward search and location over symbols 1..n_symbols-1; 0 separates texts and ends the last one."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8, keep_order: bool = False):
        order = suffix_array(symbols)
        self.size = len(symbols)
        last = symbols[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols))))
        self.last = WaveletMatrix(last, n_symbols)
        # A walk back from any position stops at a sampled one, at the latest where its text starts.
        sampled = (order % sample == 0) | (last == 0)
        self.sampled = BitVector(sampled)
        self.positions = order[sampled].astype(np.int64)
        self.order = order if keep_order else None

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes start with symbol before what low and high hold."""
        base = self.before[symbol]
        return base + self.last.rank(symbol, low), base + self.last.rank(symbol, high)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (one in each row, all of one length); empty where there is none."""
        low, high = self.start(len(patterns))
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            a, b = self.extend(patterns[live, column], low[live], high[live])
            low[live], high[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in the given rows, walking back to sampled ones."""
        out = np.empty(len(rows), dtype=np.int64)
        at, who, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(who):
            here = self.sampled.rank(at + 1) - self.sampled.rank(at) == 1
            out[who[here]] = self.positions[self.sampled.rank(at[here])] + steps
            at, who = at[~here], who[~here]
            symbol = self.last.get(at)
            at = self.before[symbol] + self.last.rank(symbol, at)
            steps += 1
        return out
