"""Substring dedup on words by difference-cover anchors.

{1, 2, 4} is a difference cover modulo 7: any two word positions have a common
shift of at most 6 that brings both onto cover positions. So of two equal runs
of 13 words, some 7-word anchor lies at a cover position of its own document in
both, and hashing 3 of 7 positions finds every match. Where an anchor occurs in
two documents, the match is extended to the 13-word windows around it, and
these are compared by 128-bit hashes with the windows of earlier documents.

Chunks hold documents in id order. Anchors and windows are compared between
chunks as packed sets (see ``chunks``), inside a chunk directly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm import chunks
from twinframe.llm.tables import table
from twinframe.llm.text import buffers, mix, rolling, texts_of, word_hashes

WINDOW = 13
#: Fixed difference covers modulo their period; any two residues have a common shift into the cover.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
LAST = int(np.iinfo(np.int64).max)
RESULT = "id long, kept string, n_words long, n_removed long"


def _period(window: int) -> int:
    """The period that leaves an anchor of at least half the window, so that few anchors match by chance."""
    return max(p for p in COVERS if window - p + 1 >= (window + 1) // 2)


def _words(data, starts, seed):
    """Word hashes of a buffer with each word's document, index in it and words left in it."""
    hashes, begin, end = word_hashes(data, seed)
    first = np.searchsorted(begin, starts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    at = np.arange(len(begin))
    return hashes, begin, end, doc, at - first[doc], first[doc + 1] - at


def _anchors(texts, ids, window):
    """Key, owner id and place (buffer, word) of every anchor of a chunk."""
    period = _period(window)
    width = window - period + 1
    cover = np.isin(np.arange(period), COVERS[period])
    keys, owners, places = [], [], []
    for first, data, starts in buffers(texts):
        hashes, _, _, doc, index, left = _words(data, starts, 1)
        at = np.flatnonzero(cover[index % period] & (left >= width) & (left + index >= window))
        roll = rolling(2)
        keys.append(mix(roll.slices(roll.prefix(hashes), at, at + width)))
        owners.append(ids[first + doc[at]])
        places.append(at)
    return keys, owners, places


def _in_two(back, owner, n):
    """Which of n keys have two different owners."""
    low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, back, owner)
    np.maximum.at(high, back, owner)
    return low != high


def _joined(parts, kind):
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _chunk(rows):
    """Texts and ids of a chunk in id order; a null id comes last."""
    rows = rows.sort_by("id")
    ids = rows.column("id").fill_null(LAST).to_numpy()
    return texts_of(rows.column("text")), ids, rows


def _candidates(texts, ids, replies, window, buckets):
    """Windows around anchors that occur in two documents: 128-bit hash, owner, place, per buffer."""
    period = _period(window)
    width = window - period + 1
    keys, owners, places = _anchors(texts, ids, window)
    distinct, back = np.unique(_joined(keys, np.uint64), return_inverse=True)
    alive = chunks.told(replies, 1, distinct, buckets) | _in_two(back, _joined(owners, np.int64), len(distinct))
    alive = np.split(alive[back], np.cumsum([len(k) for k in keys])[:-1])
    for (first, data, starts), place, live in zip(buffers(texts), places, alive):
        hashes, begin, end, doc, index, left = _words(data, starts, 1)
        near = np.zeros(len(hashes) + window, np.int64)
        at = place[live]
        np.add.at(near, np.maximum(at - (window - width), 0), 1)
        np.add.at(near, at + 1, -1)
        start = np.flatnonzero((np.cumsum(near)[: len(hashes)] > 0) & (left >= window))
        second = word_hashes(data, 3)[0]
        high, low = (
            mix(rolling(seed).slices(rolling(seed).prefix(h), start, start + window))
            for seed, h in ((4, hashes), (5, second))
        )
        yield first, data, starts, begin, end, doc, start, high, low, ids[first + doc[start]]


def windows_removed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    chunk_bytes: int = chunks.CHUNK_BYTES,
) -> DataFrame:
    """(id, kept, n_words, n_removed) per row of ``docs``.

    Words are runs without ASCII white space. A word goes if some window of
    ``window`` words over it also starts in a document of smaller id; windows
    are judged on the input. ``kept`` joins what is left by one space. Null text
    has no words; a null id counts as the largest; rows of equal id are one
    document for comparing and keep a row each. Other columns are not read. An
    empty table gives an empty table.
    """
    number = chunks.chunk_count(docs, text_col, chunk_bytes)
    n = chunks.bucket_count(number)
    rows = docs.select(
        chunks.by_order(docs, id_col, number).alias("chunk"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
    )

    def anchors(key, rows):
        texts, ids, _ = _chunk(rows)
        keys = np.unique(_joined(_anchors(texts, ids, window)[0], np.uint64))
        return chunks.ask(key[0].as_py(), 1, keys, n, [keys.astype("<u4")])

    def windows(key, rows, replies):
        if not len(rows):
            return chunks.empty(chunks.ASKED)
        texts, ids, _ = _chunk(rows)
        found = list(_candidates(texts, ids, replies, window, n))
        high, low, _ = chunks.distinct_pairs(*(_joined([f[i] for f in found], np.uint64) for i in (7, 8)))
        return chunks.ask(key[0].as_py(), 2, high, n, [high, low])

    def keep(key, rows, replies):
        if not len(rows):
            return chunks.empty(RESULT)
        texts, ids, rows = _chunk(rows)
        found = list(_candidates(texts, ids, replies, window, n))
        high, low, back = chunks.distinct_pairs(*(_joined([f[i] for f in found], np.uint64) for i in (7, 8)))
        owner = _joined([f[9] for f in found], np.int64)
        lowest = np.full(len(high), LAST)
        np.minimum.at(lowest, back, owner)
        repeated = chunks.told(replies, 2, high, n)[back] | (lowest[back] < owner)
        repeated = np.split(repeated, np.cumsum([len(f[6]) for f in found])[:-1])
        kept, words, removed = [], [], []
        for (first, data, starts, begin, end, doc, start, *_), gone in zip(found, repeated):
            cover = np.zeros(len(begin) + 1, np.int64)
            np.add.at(cover, start[gone], 1)
            np.add.at(cover, start[gone] + window, -1)
            covered = np.cumsum(cover)[:-1] > 0
            counts = np.bincount(doc, minlength=len(starts) - 1)
            words.append(counts)
            removed.append(np.bincount(doc[covered], minlength=len(starts) - 1))
            raw, edge = data.tobytes(), np.concatenate([[0], np.cumsum(counts)])
            for d in range(len(starts) - 1):
                a, b = edge[d], edge[d + 1]
                if removed[-1][d] == 0:
                    kept.append(b" ".join(raw[starts[d] : starts[d + 1]].split()))
                else:
                    left = a + np.flatnonzero(~covered[a:b])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(begin[left].tolist(), end[left].tolist())]))
        return pa.table({
            "id": rows.column("id"), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(np.concatenate(words)), "n_removed": pa.array(np.concatenate(removed)),
        })

    by_chunk = rows.groupBy("chunk")
    first = chunks.answer(by_chunk.applyInArrow(anchors, chunks.ASKED), {1: chunks.short_shared})
    asked = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(windows, chunks.ASKED)
    second = chunks.answer(asked, {2: chunks.long_earlier})
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(keep, RESULT)


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = windows_removed(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
