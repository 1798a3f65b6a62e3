"""Membership questions between chunks of a corpus.

A chunk is a few megabytes of whole documents, worked on in one task. To learn
which of its keys (hashes) occur in other chunks, it sends each bucket of the
key space its sorted distinct keys as one packed row, and gets one bit per key
back. A key reaches a bucket at most once per chunk, however many copies there
are, so no key is hot, and what is shuffled is a few bytes per key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

#: Text per chunk; it grows to MAX_CHUNK_BYTES once there are MANY chunks.
CHUNK_BYTES = 2 << 20
MAX_CHUNK_BYTES = 64 << 20
MANY = 4096

#: Chunks whose keys one bucket holds the like of; a chunk sends one row per bucket.
CHUNKS_PER_BUCKET = 8

ASKED = "bucket int, chunk int, kind int, keys binary"
TOLD = "chunk int, bucket int, kind int, bits binary"


def chunk_count(docs: DataFrame, text_col: str, chunk_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    size = min(max(chunk_bytes, total // MANY), max(chunk_bytes, MAX_CHUNK_BYTES))
    return int(total // size) + 1


def bucket_count(chunks: int) -> int:
    return -(-chunks // CHUNKS_PER_BUCKET)


def by_content(id_col: str, text_col: str, n: int) -> Column:
    """Chunk numbers that spread rows evenly."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")


def by_order(docs: DataFrame, id_col: str, n: int) -> Column:
    """Chunk numbers that rise with the id; a null id is in the last chunk."""
    probabilities = [i / n for i in range(1, n)]
    known = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    cuts = np.unique(np.array(known.approxQuantile("id", probabilities, 0.25 / n) if n > 1 else [], float))

    @pandas_udf("int")
    def place(ids):
        import pandas as pd

        values = ids.to_numpy(dtype=float, na_value=np.inf)
        return pd.Series(np.searchsorted(cuts, values, "left").astype("int32"))

    return place(F.col(id_col).cast("long"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def ask(chunk: int, kind: int, keys: np.ndarray, buckets: int, payload: list[np.ndarray]) -> pa.Table:
    """Rows for sorted distinct ``keys``: per bucket the bytes of each payload array."""
    if not len(keys):
        return empty(ASKED)
    home = bucket_of(keys, buckets)
    cuts = np.searchsorted(home, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed = [b"".join(p[cuts[b] : cuts[b + 1]].tobytes() for p in payload) for b in used]
    n = len(used)
    return pa.table({
        "bucket": pa.array(used.astype(np.int32)), "chunk": pa.array(np.full(n, chunk, np.int32)),
        "kind": pa.array(np.full(n, kind, np.int32)), "keys": pa.array(packed, pa.binary()),
    })


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def answer(asked: DataFrame, deciders: dict[int, Callable]) -> DataFrame:
    """One bit per asked key. A decider gets (payload bytes per row, chunk per row) and gives a flag array per row."""

    def reply(rows):
        kind, chunk = rows.column("kind").to_numpy(), rows.column("chunk").to_numpy()
        payload = rows.column("keys").to_pylist()
        bits = [b""] * len(payload)
        for which, decide in deciders.items():
            at = np.flatnonzero(kind == which)
            if len(at):
                for i, flags in zip(at, decide([payload[i] for i in at], chunk[at])):
                    bits[i] = np.packbits(flags).tobytes()
        return pa.table({
            "chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "kind": rows.column("kind"),
            "bits": pa.array(bits, pa.binary()),
        })

    return asked.groupBy("bucket").applyInArrow(reply, TOLD)


def told(replies: pa.Table, kind: int, keys: np.ndarray, buckets: int, width: int = 1) -> np.ndarray:
    """Flags of a chunk's sorted keys, put together from the buckets' replies.

    With a width over 1 a decider gives that many flags per key, one after the
    other, and the result has a row for each.
    """
    flags = np.zeros((width, len(keys)), bool)
    mine = replies.filter(pa.compute.equal(replies.column("kind"), kind))
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for bucket, bits in zip(mine.column("bucket").to_pylist(), mine.column("bits").to_pylist()):
        a, b = cuts[bucket], cuts[bucket + 1]
        found = np.unpackbits(np.frombuffer(bits, np.uint8), count=width * (b - a))
        flags[:, a:b] = found.reshape(width, b - a)
    return flags if width > 1 else flags[0]


def _cut(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1])


def short_shared(payload: list[bytes], chunk: np.ndarray) -> list[np.ndarray]:
    """32-bit keys that several rows hold; a chance match may be flagged too."""
    parts = [np.frombuffer(p, "<u4") for p in payload]
    _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return _cut(count[back] > 1, [len(p) for p in parts])


def _long_runs(payload: list[bytes], chunk: np.ndarray):
    """Two-word keys sorted with their chunk: (order, run number, chunk in order, sizes)."""
    parts = [np.frombuffer(p, "<u8").reshape(2, -1) for p in payload]
    sizes = [p.shape[1] for p in parts]
    high, low = np.concatenate(parts, axis=1)
    owner = np.repeat(chunk, sizes)
    order = np.lexsort((owner, low, high))
    high, low = high[order], low[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return order, np.cumsum(fresh) - 1, owner[order], sizes


def long_shared(payload: list[bytes], chunk: np.ndarray) -> list[np.ndarray]:
    """128-bit keys that several chunks hold."""
    order, run, _, sizes = _long_runs(payload, chunk)
    flags = np.empty(len(order), bool)
    flags[order] = np.bincount(run)[run] > 1
    return _cut(flags, sizes)


def long_earlier(payload: list[bytes], chunk: np.ndarray) -> list[np.ndarray]:
    """128-bit keys that a chunk of smaller number holds."""
    order, run, owner, sizes = _long_runs(payload, chunk)
    first = owner[np.searchsorted(run, np.arange(run[-1] + 1))]
    flags = np.empty(len(order), bool)
    flags[order] = owner > first[run]
    return _cut(flags, sizes)


def distinct_pairs(high: np.ndarray, low: np.ndarray):
    """Sorted distinct (high, low), and for every input its place among them."""
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return h[fresh], l[fresh], back
