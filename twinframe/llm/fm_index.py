"""An FM-index over sequences of small numbers: wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many text positions, the position of a suffix is kept.
SAMPLE = 16


class Wavelet:
    """Ranks over a sequence of numbers, one bit level after the other (most significant first)."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = levels
        self.zeros, self.splits = [], []
        for level in range(levels):
            bit = (values >> (levels - 1 - level)) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            self.splits.append(int(before[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        low = np.zeros_like(at)
        for level, (before, split) in enumerate(zip(self.zeros, self.splits)):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(one, split + at - before[at], before[at])
            low = np.where(one, split + low - before[low], before[low])
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), np.int64)
        for before, split in zip(self.zeros, self.splits):
            one = before[at + 1] == before[at]
            found = found * 2 + one
            at = np.where(one, split + at - before[at], before[at])
        return found


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by prefix doubling; zeros end a suffix and rank by position, before all else."""
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())
    step = 1
    while True:
        later = np.zeros(len(text), np.int64)
        later[: max(0, len(text) - step)] = rank[step:] + 1
        key = rank * (len(text) + int(text.max(initial=0)) + 2) + np.where(ends, 0, later)
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(text), np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        step *= 2


class FMIndex:
    """Search in sequences joined as one text of positive numbers, each sequence closed by a zero."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.last = Wavelet(text[order - 1], max(1, symbols.bit_length()))
        self.first = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.first[1:])
        # the walk back may not cross the start of a sequence, so starts are kept too
        kept = np.arange(len(text)) % SAMPLE == 0
        kept[0] = True
        kept[1:] |= text[:-1] == 0
        self.kept = kept[order]
        self.before = np.concatenate([[0], np.cumsum(self.kept)])
        self.sample = order[self.kept]
        self.size = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each pattern; patterns are rows padded at the front."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a kept one."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        while True:
            open_ = np.flatnonzero(~self.kept[rows])
            if not len(open_):
                return self.sample[self.before[rows]] + steps
            symbol = self.last.symbol(rows[open_])
            rows[open_] = self.first[symbol] + self.last.rank(symbol, rows[open_])
            steps[open_] += 1
