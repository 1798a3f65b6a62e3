"""Byte and word arithmetic on numpy buffers, used inside tasks."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

#: Bytes per buffer on which prefix hashes are taken at once.
BUFFER = 1 << 16

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def worker_cache(key: str, make):
    """One object per Python worker process.

    Functions travel to the workers by value, so module globals would be new in
    every task; the object hangs on a module of its own instead.
    """
    home = sys.modules.setdefault("twinframe_worker_cache", types.ModuleType("twinframe_worker_cache"))
    if not hasattr(home, key):
        setattr(home, key, make())
    return getattr(home, key)


def texts_of(column) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that every bit depends on all."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any slice of a sequence of 64-bit numbers from prefix sums.

    The prefix hash is sum(v[i] * base**i) mod 2**64 with an odd base, which has
    an inverse; so the hash of v[s:e] is (C[e] - C[s]) * base**-s.
    """

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.base = np.uint64(int(random.integers(1 << 62)) * 4 + 3)
        self.table = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BUFFER + 1)
            for name, base in (("powers", self.base), ("backs", self.inverse)):
                steps = np.full(n, base)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(np.take(self.table, data))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.backs[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every slice of ``width``, by its start."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (prefix[width:] - prefix[:n]) * self.backs[:n]


def rolling(seed: int) -> Rolling:
    return worker_cache(f"rolling{seed}", lambda: Rolling(seed))


def word_bounds(data: np.ndarray, space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run without white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def buffers(texts: list[bytes], limit: int = BUFFER):
    """Runs of whole texts joined by a space: (first text, buffer, start of each text and the end).

    A buffer exceeds the limit only where one text does.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < limit):
            size += len(texts[last]) + 1
            last += 1
        joined = b" ".join(texts[first:last]) + b" "
        starts = np.zeros(last - first + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[first:last]], out=starts[1:])
        yield first, np.frombuffer(joined, np.uint8), starts
        first = last


def word_hashes(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a buffer."""
    roll = rolling(seed)
    start, end = word_bounds(data)
    return mix(roll.slices(roll.of_bytes(data), start, end) + (end - start).astype(np.uint64)), start, end
