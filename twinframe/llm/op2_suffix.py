"""Byte-substring dedup by a hash-compared suffix sort.

A byte goes when a 200-byte string over it also starts elsewhere. Suffixes that
cannot repeat are put aside first, then the rest is sorted:

1. Every 200-byte string has an anchor, its 64-gram of smallest hash (leftmost
   of equals). Equal strings have equal anchors at equal distance; anchors that
   occur once in the corpus leave the search with all their strings.
2. The strings of one anchor are taken by distance in steps of 32. They share a
   core of 169 bytes: a core that occurs once clears them all. Where every
   occurrence of a core stands in the same surroundings, they all repeat.
3. The strings left lie at the edges of repeated passages. Each chunk sorts them
   by a mergesort whose comparisons are binary searches on prefix hashes (see
   ``suffixes``); equal neighbours are verified byte by byte. The sorted runs of
   all chunks then meet by 128-bit hashes.

Chunks talk through packed sorted sets (see ``chunks``), each distinct key once
per chunk, so that a passage in a third of all documents is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm import chunks
from twinframe.llm.suffixes import sort_suffixes
from twinframe.llm.tables import table
from twinframe.llm.text import buffers, mix, rolling, texts_of

WIDTH = 200
#: Distances of anchored strings that are judged together.
STEP = 32
#: Windows whose anchors are found at once; positions must fit PLACE_BITS.
PART = 1 << 20
PLACE_BITS = 24
RESULT = "id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every slice of ``width``, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _anchored(data, starts, width):
    """(anchor, first string, last string, key) of each run of strings with one anchor, as start positions."""
    gram = min(64, width)
    span = width - gram + 1
    roll = rolling(7)
    hashes = roll.windows(roll.of_bytes(data), gram)
    strings = len(data) - width + 1
    if strings < 1:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    ends = starts[1:] - 1
    fits = ends - starts[:-1] >= width
    turn = np.zeros(strings + 1, np.int8)
    turn[starts[:-1][fits]] += 1
    turn[ends[fits] - width + 1] -= 1
    valid = np.cumsum(turn, dtype=np.int8)[:-1] > 0
    mask = np.uint64((1 << PLACE_BITS) - 1)
    anchor, head, tail = [], [], []
    for low in range(0, strings, PART):
        part = hashes[low : low + PART + span - 1] & ~mask
        part |= np.arange(len(part), dtype=np.uint64)
        least = _sliding_min(part, span)
        here = valid[low : low + len(least)]
        cut = np.ones(len(least) + 1, bool)
        cut[1:-1] = (least[1:] != least[:-1]) | (here[1:] != here[:-1])
        first = np.flatnonzero(cut[:-1] & here)
        anchor.append(low + (least[first] & mask).astype(np.int64))
        head.append(low + first)
        tail.append(low + np.flatnonzero(cut[1:] & here))
    anchor, head, tail = (np.concatenate(x) for x in (anchor, head, tail))
    return anchor, head, tail, mix(hashes[anchor] ^ np.uint64(width))


def _chunk(texts, width):
    """Anchored runs of a chunk, one entry per buffer."""
    found = []
    for first, data, starts in buffers(texts):
        found.append((first, data, starts, *_anchored(data, starts, width)))
    return found


def _split(flags, parts):
    return np.split(flags, np.cumsum([len(p) for p in parts])[:-1])


def _steps(found, replies, width, n):
    """Runs of repeated anchors cut at distances that are multiples of STEP.

    Per buffer: buffer number, anchor, step, nearest and farthest distance, and
    the keys (core, two of the surroundings).
    """
    keys = [f[6] for f in found]
    distinct, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    alive = _split((chunks.told(replies, 1, distinct, n) | (count > 1))[back], keys)
    out = []
    for number, ((_, data, _, anchor, low, high, key), live) in enumerate(zip(found, alive)):
        anchor, low, high, key = anchor[live], low[live], high[live], key[live]
        near, far = anchor - high, anchor - low
        pieces = far // STEP - near // STEP + 1
        at = np.repeat(np.arange(len(anchor)), pieces)
        step = near[at] // STEP + np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        anchor, key = anchor[at], key[at]
        near, far = np.maximum(near[at], step * STEP), np.minimum(far[at], step * STEP + STEP - 1)
        roll, second = rolling(7), rolling(8)
        prefix = roll.of_bytes(data)
        start = anchor - step * STEP
        core = mix(roll.slices(prefix, start, start + width - STEP + 1) ^ mix(key + step.astype(np.uint64)))
        shape = mix((near * (width + 1) + far).astype(np.uint64))
        a, b = anchor - far, anchor - near + width
        high_ = mix(roll.slices(prefix, a, b) + shape)
        low_ = mix(second.slices(second.of_bytes(data), a, b) ^ shape)
        out.append((np.full(len(anchor), number), anchor, step, near, far, core, high_, low_))
    return [np.concatenate([o[i] for o in out]) for i in range(8)]


def _triples(core, high, low):
    """Sorted distinct triples, an input of each, the place of each input among them, how often each occurs."""
    order = np.lexsort((low, high, core))
    c, h, l = core[order], high[order], low[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return (c[fresh], h[fresh], l[fresh]), order[fresh], back, np.bincount(back, minlength=fresh.sum())


def _judge_steps(payload, chunk):
    """Per triple: does its core stand in other surroundings too; do other chunks hold the same triple."""
    parts = [np.frombuffer(p, "<u8").reshape(3, -1) for p in payload]
    core, high, low = np.concatenate(parts, axis=1)
    (c, _, _), _, back, count = _triples(core, high, low)
    _, home, kinds = np.unique(c, return_inverse=True, return_counts=True)
    mixed, shared = (kinds[home] > 1)[back], (count > 1)[back]
    cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
    return [np.concatenate(x) for x in zip(np.split(mixed, cuts), np.split(shared, cuts))]


def _judged(found, replies, width, n):
    """The steps; which of them repeat wholly; which must be sorted, one of equal ones."""
    steps = _steps(found, replies, width, n)
    (core, _, _), one, back, count = _triples(*steps[5:])
    mixed, shared = chunks.told(replies, 2, core, n, 2)
    return steps, (shared | (count > 1))[back], one[mixed]


def _strings(found, steps, chosen, width):
    """The strings of the chosen steps, over a gathered buffer.

    (buffer, start of each in it, step of each, distance from its anchor).
    """
    number, anchor, _, near, far, *_ = (s[chosen] for s in steps)
    lengths = far - near + width
    offset = np.cumsum(lengths) - lengths
    gathered = np.zeros(lengths.sum(), np.uint8)
    for buffer in np.unique(number):
        mine = np.flatnonzero(number == buffer)
        size = lengths[mine]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        source = np.repeat((anchor - far)[mine], size) + inner
        gathered[np.repeat(offset[mine], size) + inner] = found[buffer][1][source]
    sizes = far - near + 1
    owner = np.repeat(np.arange(len(near)), sizes)
    back = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return gathered, offset[owner] + back, chosen[owner], far[owner] - back


def _string_hashes(gathered, starts, width):
    return [
        mix(roll.slices(roll.of_bytes(gathered), starts, starts + width)) for roll in (rolling(9), rolling(10))
    ]


def repeats_removed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    chunk_bytes: int = chunks.CHUNK_BYTES,
) -> DataFrame:
    """(id, kept, n_bytes, n_removed, spans) per row of ``docs``; ``width`` must be over 2 * STEP.

    A byte of the UTF-8 text is removed if a string of ``width`` bytes over it
    also starts at any other place of the table, judged on the input; strings do
    not cross rows. ``spans`` are the maximal removed runs. Null text is empty.
    Repeated rows remove each other wholly if they are long enough. A null id is
    carried along. Other columns are not read. An empty table gives an empty
    table.
    """
    number = chunks.chunk_count(docs, text_col, chunk_bytes)
    n = chunks.bucket_count(number)
    rows = docs.select(
        chunks.by_content(id_col, text_col, number).alias("chunk"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
    )

    def anchors(key, rows):
        keys = np.unique(np.concatenate([f[6] for f in _chunk(texts_of(rows.column("text")), width)]))
        return chunks.ask(key[0].as_py(), 1, keys, n, [keys.astype("<u4")])

    def steps(key, rows, replies):
        if not len(rows):
            return chunks.empty(chunks.ASKED)
        found = _chunk(texts_of(rows.column("text")), width)
        core, high, low = _triples(*_steps(found, replies, width, n)[5:])[0]
        return chunks.ask(key[0].as_py(), 2, core, n, [core, high, low])

    def strings(key, rows, replies):
        if not len(rows):
            return chunks.empty(chunks.ASKED)
        found = _chunk(texts_of(rows.column("text")), width)
        judged, _, chosen = _judged(found, replies, width, n)
        gathered, starts, _, _ = _strings(found, judged, chosen, width)
        first, second = _string_hashes(gathered, starts, width)
        high, low, _ = chunks.distinct_pairs(first, second)
        return chunks.ask(key[0].as_py(), 3, high, n, [high, low])

    def keep(key, rows, replies):
        if not len(rows):
            return chunks.empty("id long").append_column("kept", pa.array([], pa.binary())).append_column(
                "n_bytes", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column(
                "spans", pa.array([], SPANS))
        texts = texts_of(rows.column("text"))
        found = _chunk(texts, width)
        judged, whole, chosen = _judged(found, replies, width, n)
        gathered, starts, owner, distance = _strings(found, judged, chosen, width)
        group = np.unique(mix(judged[5][owner] + distance.astype(np.uint64)), return_inverse=True)[1]
        order, same = sort_suffixes(gathered, starts, group, width)
        classes = np.empty(len(order), np.int64)
        classes[order] = np.cumsum(~same) - 1
        copies = np.bincount(classes)
        high, low, back = chunks.distinct_pairs(*_string_hashes(gathered, starts[order[~same]], width))
        repeated = ((copies > 1) | chunks.told(replies, 3, high, n)[back])[classes]
        number, anchor, _, near, far = judged[:5]
        place, away = owner[repeated], distance[repeated]
        lows = np.concatenate([(anchor - far)[whole], anchor[place] - away])
        highs = np.concatenate([(anchor - near)[whole], anchor[place] - away]) + width
        home = np.concatenate([number[whole], number[place]])
        kept, removed, spans = [], [], []
        for buffer, (_, data, starts, *_) in enumerate(found):
            mine = home == buffer
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, lows[mine], 1)
            np.add.at(cover, highs[mine], -1)
            gone = np.cumsum(cover) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            raw = data.tobytes()
            cuts = np.searchsorted(begin, starts)
            for d in range(len(starts) - 1):
                at, stop = int(starts[d]), int(starts[d + 1]) - 1
                runs = list(zip(begin[cuts[d] : cuts[d + 1]].tolist(), end[cuts[d] : cuts[d + 1]].tolist()))
                left, here = [], at
                for a, b in runs:
                    left.append(raw[here:a])
                    here = b
                left.append(raw[here:stop])
                kept.append(b"".join(left))
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a - at, "end": b - at} for a, b in runs])
        return pa.table({
            "id": rows.column("id"), "kept": pa.array(kept, pa.binary()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, SPANS),
        })

    by_chunk = rows.groupBy("chunk")
    first = chunks.answer(by_chunk.applyInArrow(anchors, chunks.ASKED), {1: chunks.short_shared})
    second = chunks.answer(
        by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(steps, chunks.ASKED), {2: _judge_steps}
    )
    two = first.unionByName(second)
    third = chunks.answer(
        by_chunk.cogroup(two.groupBy("chunk")).applyInArrow(strings, chunks.ASKED), {3: chunks.long_shared}
    )
    return by_chunk.cogroup(two.unionByName(third).groupBy("chunk")).applyInArrow(keep, RESULT)


def op2_suffix(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats_removed(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
