"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents. Its words become the numbers of the
benchmark's vocabulary; only stretches in which every pair of neighbours is
also a pair of some benchmark window can hold one, and the index is built over
these. All windows are searched backward at once through wavelet ranks, their
occurrences located by sampled suffix positions and merged into spans.

Documents are read once and never shuffled. The benchmark goes to the tasks in
slices of measured size; a benchmark larger than a slice takes more passes over
the batches in the same job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.fm_index import FMIndex
from twinframe.llm.tables import table
from twinframe.llm.text import texts_of

WINDOW = 10
#: Text of a shard, and of a slice of the benchmark.
SHARD_BYTES = 2 << 20
SLICE_BYTES = 4 << 20
#: Lower-cases A-Z and blanks what is not in [^\x00-\x2F\x3A-\x60\x7B-\x7F].
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
MARKED = "id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Windows:
    """The distinct windows of a slice of the benchmark over its own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(FOLD).split()]
            width = min(window, len(ids))
            for at in range(len(ids) - width + 1 if width else 0):
                owners.setdefault(tuple(ids[at : at + width]), set()).add(item)
        self.items = list(owners.values())
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int64)
        for row, found in enumerate(owners):
            self.patterns[row, window - len(found) :] = found
        pairs = (self.patterns[:, :-1] * self.base + self.patterns[:, 1:])[self.patterns[:, :-1] > 0]
        self.pairs = np.unique(pairs)

    @property
    def base(self) -> int:
        return len(self.words) + 1

    def search(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, index of its first word) of every occurrence in the words of a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words):
            return none, none
        linked = np.zeros(len(words), bool)
        code = words[:-1] * self.base + words[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        if len(self.pairs):
            linked[:-1] = (self.pairs[at] == code) & (doc[1:] == doc[:-1])
        # stretches of linked neighbours that are long enough for the shortest window
        start = np.flatnonzero(~np.concatenate([[False], linked[:-1]]) & (words > 0))
        stop = np.flatnonzero(~linked & (words > 0)) + 1
        long_ = stop - start >= self.lengths.min()
        start, size = start[long_], (stop - start)[long_]
        if not len(start):
            return none, none
        place = np.arange((size + 1).sum()) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        source = np.repeat(start, size + 1) + place
        closing = place == np.repeat(size, size + 1)
        text = np.where(closing, 0, words[np.minimum(source, len(words) - 1)])
        index = FMIndex(text, len(self.words))
        low, high = index.search(self.patterns, self.lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, source[index.locate(rows)]


def _shards(texts: list[bytes]):
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SHARD_BYTES):
            size += len(texts[last])
            last += 1
        yield first, last
        first = last


def _mark(texts, spans, items, windows):
    """Word counts, hit counts, merged spans and items of the rows of one shard."""
    tokens = [t.translate(FOLD).split() for t in texts]
    counts = np.array([len(t) for t in tokens], np.int64)
    edge = np.concatenate([[0], np.cumsum(counts)])
    get = windows.words.get
    words = np.fromiter((get(w, 0) for t in tokens for w in t), np.int64, edge[-1])
    doc = np.repeat(np.arange(len(texts)), counts)
    which, at = windows.search(words, doc)
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, at, 1)
    np.add.at(turn, at + windows.lengths[which], -1)
    for row, known in enumerate(spans):
        for span in known:
            turn[edge[row] + span["start"]] += 1
            turn[edge[row] + span["end"]] -= 1
    hit = np.cumsum(turn)[:-1] > 0
    # spans end where the hits or the document do
    opens = hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])]) if len(hit) else hit
    closes = hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]]) if len(hit) else hit
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    found = [set(known) for known in items]
    for row, window in set(zip(doc[at].tolist(), which.tolist())):
        found[row] |= windows.items[window]
    merged = [[] for _ in texts]
    for row, a, b in zip(doc[begin].tolist(), begin.tolist(), end.tolist()):
        merged[row].append({"start": a - int(edge[row]), "end": b - int(edge[row])})
    return counts, np.bincount(doc[hit], minlength=len(texts)), merged, [sorted(f) for f in found]


def _slices(benchmark, item_col, text_col, slice_bytes):
    """The items as broadcasts of about ``slice_bytes`` of text each, measured beforehand."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.col(text_col).cast("binary").alias("text"),
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(total // slice_bytes) + 1
    parts = (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == n) for n in range(slices))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast([(r.item, bytes(r.text)) for r in part.collect()]) for part in parts]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) per row of ``docs``.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lowering A-Z. ``spans``
    are maximal runs of words inside an occurrence of a window (``window``
    consecutive words of an item, or all of a shorter one); ``items`` are the ids
    as text, in order, of the items with an occurring window, each once. Null or
    wordless texts have no words and no hits; null or wordless items have no
    window; a null item id is listed as "null"; a null document id is carried
    along. Repeated rows keep a row each. Other columns are not read. An empty
    benchmark hits nothing, an empty table gives an empty table.
    """
    slices = _slices(benchmark, item_col, item_text_col, slice_bytes)
    marked = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.col(text_col).cast("binary").alias("text"),
    )
    for number, held in enumerate(slices):
        more = number + 1 < len(slices)
        marked = marked.mapInArrow(_marker(held, window, more), MARKED + ", text binary" * more)
    return marked


def _marker(held, window, keep_text):
    """One pass over the documents with a slice of the benchmark, adding to what earlier passes found."""

    def run(batches):
        windows = Windows(held.value, window)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            parts = [_mark(texts[a:b], spans[a:b], items[a:b], windows) for a, b in _shards(texts)]
            numbers = (pa.array(np.concatenate([p[i] for p in parts] or [[]]).astype(np.int64)) for i in (0, 1))
            columns = [
                batch.column("id"), *numbers, pa.array([x for p in parts for x in p[2]], SPANS),
                pa.array([x for p in parts for x in p[3]], pa.list_(pa.string())),
            ]
            names = ["id", "n_words", "n_hit", "spans", "items"]
            if keep_text:
                columns.append(batch.column("text"))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contaminated_dropped(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Rows of ``docs`` without a hit word, with all their columns; null and wordless texts stay."""
    for held in _slices(benchmark, item_col, item_text_col, slice_bytes):
        docs = docs.mapInArrow(_dropper(held, window, text_col), docs.schema)
    return docs


def _dropper(held, window, text_col):
    def run(batches):
        windows = Windows(held.value, window)
        for batch in batches:
            texts = texts_of(batch.column(text_col))
            clean = [_mark(texts[a:b], [[]] * (b - a), [[]] * (b - a), windows)[1] == 0 for a, b in _shards(texts)]
            yield batch.filter(pa.array(np.concatenate(clean or [np.zeros(0, bool)])))

    return run


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
