"""FM-index of a sequence of small whole numbers, on numpy arrays; all searches work on many patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE_STEP = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. The last symbol must be smaller than all others.

    Suffixes are first sorted by as many symbols as a 63-bit key holds; then groups that are still equal are
    sorted by the rank of what follows, doubling the depth, with only those groups touched.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: max(0, n - i)] |= symbols[i:]
    order = np.argsort(key)
    starts = _starts(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = starts
    del key
    # Places in the array whose group has more than one member.
    active = np.flatnonzero(np.diff(np.append(starts, n)) == 0)
    active = np.union1d(active, active + 1)
    while len(active):
        at = order[active]
        after = at + depth
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[active] = at
        new = active[_starts(key)]
        rank[at] = new
        ends = np.append(new[1:] != new[:-1], True)
        alone = (new == active) & ends
        active = active[~alone]
        depth *= 2
    return order


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with the same value."""
    first = np.append(True, ordered[1:] != ordered[:-1])
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


class Wavelet:
    """Wavelet tree with its levels laid end to end: ``rank`` counts a symbol before a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            right = (symbols >> bit) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(right, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            right = right.astype(bool)
            symbols = np.concatenate([symbols[~right], symbols[right]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        at = [np.zeros_like(places[0]), *places]
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            right = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = [np.where(right, zeros + ones[p], p - ones[p]) for p in at]
        return [p - at[0] for p in at[1:]]


class FmIndex:
    def __init__(self, symbols: np.ndarray, step: int = SAMPLE_STEP):
        """``symbols``: whole numbers from 1; 0 is kept for the end mark."""
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.bits = max(1, int(text.max()).bit_length())
        self.last = text[order - 1]  # order 0 looks at the end mark
        self.tree = Wavelet(self.last, self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.sampled = order % step == 0
        self.nth = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffixes that begin with each pattern (one per row), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        live = np.flatnonzero((patterns < 1 << self.bits).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), live, assume_unique=True)] = 0
        for i in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, i]
            a, b = self.tree.rank(symbol, low[live], high[live])
            low[live], high[live] = self.before[symbol] + a, self.before[symbol] + b
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array: steps back until a sampled suffix is met."""
        found, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[at]
            found[todo[hit]] = self.samples[self.nth[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol = self.last[at]
                at = self.before[symbol] + self.tree.rank(symbol, at)[0]
            steps += 1
        return found
