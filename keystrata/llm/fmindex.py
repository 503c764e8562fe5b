"""An FM-index over integer sequences in numpy: suffix array, wavelet matrix, backward search of many
patterns at once, and location by sampled suffixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; text holds non-negative integers, and a shorter suffix sorts first."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, k = _ranks(text[order], order), 1
    while n and rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        if k < n:
            after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank, k = _ranks(key[order], order), 2 * k
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))[: len(order)])
    return rank


class WaveletMatrix:
    """Rank and access over symbols below 2**levels; each level keeps the zeros before each place."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros, self.total = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = symbols >> level & 1
            before = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            self.total.append(int(before[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where a place falls on the last level for a symbol; differences of these are ranks."""
        for k in range(self.levels):
            zeros = self.zeros[k][place]
            place = np.where(symbol >> (self.levels - 1 - k) & 1, self.total[k] + place - zeros, zeros)
        return place

    def symbol_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place falls on the last level."""
        symbol = np.zeros(len(place), dtype=np.int64)
        for k in range(self.levels):
            zeros = self.zeros[k][place]
            one = self.zeros[k][place + 1] == zeros
            place = np.where(one, self.total[k] + place - zeros, zeros)
            symbol = symbol << 1 | one
        return symbol, place


class FMIndex:
    """text: symbols 1 .. sigma-1; 0 separates sequences and occurs in no pattern. Each separator
    counts as a symbol of its own when suffixes are sorted, so comparisons end there."""

    STEP = 8

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        apart = text == 0
        wide = text.astype(np.int64) + int(apart.sum())
        wide[apart] = np.arange(int(apart.sum()))
        suffixes = suffix_array(wide)
        last = text[suffixes - 1].astype(np.int64)  # of place 0 the one before is the last separator
        self.n = n
        self.matrix = WaveletMatrix(last, max(1, int(sigma - 1).bit_length()))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.base = self.matrix.descend(np.arange(sigma), np.zeros(sigma, dtype=np.int64))
        sampled = (suffixes % self.STEP == 0) | (last == 0)
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))
        self.sample = suffixes[sampled]

    def _back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.matrix.descend(symbol, place) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one row each, all of one length. The range of suffixes that start with each."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            a, b = self._back(symbol, low[live]), self._back(symbol, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the text of each row of the suffix order."""
        found, steps, at, which = np.empty(len(rows), dtype=np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(at):
            done = self.sampled_before[at + 1] > self.sampled_before[at]
            found[which[done]] = self.sample[self.sampled_before[at[done]]] + steps
            at, which = at[~done], which[~done]
            symbol, place = self.matrix.symbol_at(at)
            at, steps = self.below[symbol] + place - self.base[symbol], steps + 1
        return found
