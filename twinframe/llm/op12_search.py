"""Ranked lexical search over a length-stratified index.

Documents of equal normaliser ``m`` form a stratum. Inside it a term's postings
are grouped by term frequency, and since all documents of the stratum share
``m``, a posting's impact depends on the frequency alone: it is worked out once
per frequency of a stratum, not per posting. The largest frequency of a term in
a stratum bounds what the term can add there, so the sum over an item's terms
bounds every score of the stratum. Strata are visited from the largest bound
down, and one whose bound lies under the item's 50th best score is left out.

The index is a table with one row per stratum, large strata cut into parts. It
holds the postings of the terms that items ask for. Items are dealt to slices
of bounded size, written to the shared folder and read by the tasks; no item
passes through the driver. A first round over the index visits each item's most
promising stratum of every task and gives a score that the best 50 reach at
least; the second round starts from these scores.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinframe.llm.tables import table
from twinframe.session import materialize, shared_folder

BEST = 50
#: Terms of items (each counted once per item) in one slice, on average.
SLICE_TERMS = 1_000_000
#: Postings in one part of a stratum, and in one shard of parts, on average.
PART_POSTINGS = 1 << 14
SHARD_POSTINGS = 1 << 20
#: Postings that are added up at once, and found scores held before all but the best go.
HITS = 1 << 20
#: Terms are runs of bytes that stay: digits, letters (A-Z lowered) and all bytes of characters beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
INDEX = (
    "m long, part int, ids array<long>, terms binary, tfs binary, ends binary, places binary"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once per item; rows of one item id are one item, null included."""

    def run(batches):
        for batch in batches:
            number, words = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                own = set(terms_of(text or b""))
                number += [at] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(number, pa.int64())), pa.array([w.decode() for w in words], pa.string())],
                names=["item_id", "term"],
            )

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def _read(folder: str, columns: list[str]) -> pa.Table:
    """A written table; a table without rows may have left no file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    if not files:
        return pa.table({name: pa.array([], pa.int64()) for name in columns})
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=system, partitioning=None) for f in sorted(files)])


class Slice:
    """The items of one slice: their vocabulary in byte order and their term numbers."""

    def __init__(self, folder: str):
        rows = _read(folder, ["item_id", "term"])
        terms = [t.encode() for t in rows.column("term").to_pylist()]
        self.vocabulary = {term: number for number, term in enumerate(sorted(set(terms)))}
        self.terms = len(self.vocabulary)
        items = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        self.ids = items.dictionary
        owner = items.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.fromiter((self.vocabulary[t] for t in terms), np.int64, len(terms))
        order = np.lexsort((number, owner))
        self.term, self.owner = number[order], owner[order]
        self.starts = np.searchsorted(self.owner, np.arange(len(self.ids)))


def _cached(key: str, make):
    from twinframe.llm.text import worker_cache

    # one search at a time: what an earlier one left in the worker goes
    held = worker_cache("search slices", dict)
    if key not in held:
        if len(held) > 3:
            held.clear()
        held[key] = make()
    return held[key]


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes that hold the largest; the reader tells the width by the length."""
    top = int(values.max(initial=0))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}" if count else "<u1").astype(np.int64)


def document_terms(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, hits, terms, tfs) of the documents with a term: length, and numbers and frequencies of the slice's terms."""

    def run(batches):
        vocabulary = _cached(folder, lambda: Slice(folder)).vocabulary
        for batch in batches:
            keep, length, hits, terms, tfs = [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text or b"")
                if not words:
                    continue
                own = Counter(words)
                found = sorted((vocabulary[w], tf) for w, tf in own.items() if w in vocabulary)
                pair = np.array(found, np.int64).reshape(-1, 2)
                keep.append(at)
                length.append(len(words))
                hits.append(len(pair))
                terms.append(_narrow(pair[:, 0]))
                tfs.append(_narrow(pair[:, 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())), pa.array(length, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(terms, pa.binary()), pa.array(tfs, pa.binary()),
                ],
                names=["id", "n", "hits", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, hits long, terms binary, tfs binary")


def term_weights(found: DataFrame, documents: int) -> DataFrame:
    """(term, weight) of the terms that occur: floor(1000 ln((2 N + 2) / (2 df + 1)))."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for hits, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = _wide(terms, hits)
                if hits and number[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(number[-1]) + 1 - len(total), np.int64)])
                total[number] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])

    counted = found.select("hits", "terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    return counted.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))


def stratified_index(found: DataFrame, documents: int, length: int) -> DataFrame:
    """One row per stratum of equal normaliser, or part of a large one.

    Columns: m, part, the documents' ids, and per (term, frequency) in that
    order its term, frequency and the end of its places among ``places``, the
    documents' positions in ``ids``. Parts are dealt by row, so that copies and
    a hot stratum never meet in one task; documents without an asked term have
    no postings and are left out.
    """
    rows = found.where("hits > 0").select(
        "id", "hits", "terms", "tfs", F.monotonically_increasing_id().alias("row"),
        (F.lit(50) + F.expr(f"(50 * n * {documents}L) div {max(1, length)}L")).alias("m"),
    )
    sizes = rows.groupBy("m").agg(F.sum("hits").alias("postings"))
    total = sizes.agg(F.sum("postings")).first()[0] or 0
    large = sizes.where(F.col("postings") > PART_POSTINGS).select(
        "m", F.ceil(F.col("postings") / PART_POSTINGS).cast("long").alias("parts")
    )
    shards = total // SHARD_POSTINGS + 1
    dealt = (
        rows.join(large, "m", "left")
        .withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("m", "part"), F.lit(shards)))
        .select("shard", "m", "part", "id", "hits", "terms", "tfs")
    )

    def build(group):
        order = np.lexsort((group.column("part").to_numpy(), group.column("m").to_numpy()))
        group = group.take(pa.array(order)).combine_chunks()
        m, part = group.column("m").to_numpy(), group.column("part").to_numpy()
        hits = group.column("hits").to_pylist()
        terms, tfs = group.column("terms").to_pylist(), group.column("tfs").to_pylist()
        ids = group.column("id")
        starts = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (part[1:] != part[:-1])])).tolist()
        out: dict[str, list] = {name: [] for name in ("ids", "terms", "tfs", "ends", "places")}
        for a, b in zip(starts, [*starts[1:], len(m)]):
            term = np.concatenate([_wide(terms[i], hits[i]) for i in range(a, b)])
            tf = np.concatenate([_wide(tfs[i], hits[i]) for i in range(a, b)])
            place = np.repeat(np.arange(b - a), hits[a:b])
            ranked = np.lexsort((place, tf, term))
            term, tf, place = term[ranked], tf[ranked], place[ranked]
            ends = np.append(np.flatnonzero((term[1:] != term[:-1]) | (tf[1:] != tf[:-1])) + 1, len(term))
            out["ids"].append(ids.slice(a, b - a).to_pylist())
            out["terms"].append(term[ends - 1].astype("<u4").tobytes())
            out["tfs"].append(_narrow(tf[ends - 1]))
            out["ends"].append(ends.astype("<u4").tobytes())
            out["places"].append(_narrow(place))
        kinds = {"ids": pa.list_(pa.int64())}
        arrays = {name: pa.array(values, kinds.get(name, pa.binary())) for name, values in out.items()}
        return pa.table({"m": m[starts], "part": pa.array(part[starts], pa.int32()), **arrays})

    return dealt.groupBy("shard").applyInArrow(build, INDEX)


class Stratum:
    """One row of the index with its terms' postings and impacts."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.ids = row["ids"]
        group = np.frombuffer(row["terms"], "<u4").astype(np.int64)
        ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        tfs, which = np.unique(_wide(row["tfs"], len(group)), return_inverse=True)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * row["m"])
        added = weights[group] * impact[which]
        self.places = _wide(row["places"], int(ends[-1]))
        self.added = np.repeat(added, np.diff(ends, prepend=0))
        last = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
        self.terms, self.ends = group[last], ends[last]
        # impacts rise with the frequency, so a term's last group holds its largest
        self.most = added[last]

    def bounds(self, items: Slice) -> np.ndarray:
        """What no score of this stratum exceeds, per item."""
        most = np.zeros(items.terms, np.int64)
        most[self.terms] = self.most
        return np.add.reduceat(most[items.term], items.starts)

    def scores(self, items: Slice, chosen: np.ndarray, least: np.ndarray):
        """Yields (item, place, score) arrays of positive scores of at least ``least``."""
        wanted = np.zeros(len(items.ids), bool)
        wanted[chosen] = True
        refer = np.flatnonzero(wanted[items.owner])
        at = np.searchsorted(self.terms, items.term[refer])
        at[at == len(self.terms)] = 0
        known = self.terms[at] == items.term[refer]
        owner, at = items.owner[refer[known]], at[known]
        begin = np.concatenate([[0], self.ends[:-1]])[at]
        count = self.ends[at] - begin
        total = np.cumsum(count)
        width, first = len(self.ids), 0
        while first < len(owner):
            # whole items, so that a score is complete when it is judged
            base = int(total[first - 1]) if first else 0
            last = int(np.searchsorted(total, base + HITS, "right"))
            room = int(np.searchsorted(owner, owner[first] + max(1, HITS // width)))
            last = max(first + 1, min(last, room))
            last = int(np.searchsorted(owner, owner[last - 1], "right")) if last < len(owner) else last
            own, size = owner[first:last] - owner[first], count[first:last]
            ahead = np.repeat(begin[first:last] - (np.cumsum(size) - size), size)
            posting = ahead + np.arange(int(size.sum()))
            rows = int(own[-1]) + 1
            # sums stay far below 2**53, where doubles hold whole numbers exactly
            score = np.bincount(np.repeat(own, size) * width + self.places[posting], self.added[posting], rows * width)
            score = score.astype(np.int64).reshape(rows, width)
            limit = np.maximum(least[owner[first] : owner[first] + rows], 1)[:, None]
            item, place = np.nonzero(score >= limit)
            yield item + owner[first], place, score[item, place]
            first = last


class Best:
    """The highest-scoring documents per item, and the score that others must reach."""

    def __init__(self, least: np.ndarray, best: int):
        self.least, self.best = least.copy(), best
        self.held: list[tuple] = []
        self.size = 0

    def add(self, item, ids, score) -> None:
        self.held.append((item, ids, score))
        self.size += len(item)
        if self.size > HITS // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0, np.int64)
        item, score = (np.concatenate([h[k] for h in self.held]) for k in (0, 2))
        ids = pa.concat_arrays([h[1] for h in self.held])
        known = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), known, -score, item))
        first = np.searchsorted(item[order], item[order])
        kept = np.arange(len(order)) - first < self.best
        order, place = order[kept], (np.arange(len(order)) - first)[kept]
        item, score, ids = item[order], score[order], ids.take(pa.array(order))
        full = place == self.best - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        self.held, self.size = [(item, ids, score)], len(item)
        return item, ids, score


def _searched(index: DataFrame, folder: str, first_only: bool, best: int, item_type: str) -> DataFrame:
    """(item_id, id, score): each batch's best per item; ``first_only`` visits one stratum per item."""

    def run(batches):
        items = _cached(f"{folder}/items", lambda: Slice(f"{folder}/items"))
        weights = np.zeros(items.terms, np.int64)
        read = _read(f"{folder}/weights", ["term", "weight"])
        weights[read.column("term").to_numpy()] = read.column("weight").to_numpy()
        least = np.zeros(len(items.ids), np.int64)
        if not first_only:
            known = _read(f"{folder}/reached", ["item_id", "least"])
            place = {key: number for number, key in enumerate(items.ids.to_pylist())}
            for key, value in zip(known.column("item_id").to_pylist(), known.column("least").to_pylist()):
                least[place[key]] = value
        for batch in batches:
            strata = [Stratum(row, weights) for row in batch.to_pylist()]
            if not strata:
                continue
            bound = np.array([s.bounds(items) for s in strata])
            found = Best(least, best)
            lead = bound.argmax(axis=0)
            for at in np.argsort(-(bound - least).max(axis=1), kind="stable").tolist():
                open_ = (bound[at] >= found.least) & (bound[at] > 0)
                if first_only:
                    open_ &= lead == at
                chosen = np.flatnonzero(open_)
                if not len(chosen):
                    continue
                ids = pa.array(strata[at].ids, pa.int64())
                for item, place, score in strata[at].scores(items, chosen, found.least):
                    found.add(item, ids.take(pa.array(place)), score)
                found.settle()
            item, ids, score = found.settle()
            yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(item)), ids, pa.array(score)], names=["item_id", "id", "score"])

    return index.mapInArrow(run, f"item_id {item_type}, id long, score long")


def _top(found: DataFrame, best: int, salts: int) -> DataFrame:
    """(item_id, rank, id, score): first per salt, then over all, so that no task takes all of an item's finds."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(salts)))
    inside = F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))
    some = salted.withColumn("rank", inside).where(F.col("rank") <= best)
    over = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.withColumn("rank", over).where(F.col("rank") <= best).select("item_id", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", slice_terms: int = SLICE_TERMS,
) -> DataFrame:
    """(item_id, rank, id, score): the ``best`` highest-scoring documents of each item, equal scores by ascending id.

    Rows of one item id are one item that asks for the terms of all of them; an
    item without terms, or without a document of positive score, has no row.
    Every row of ``docs`` is a document of its own, repeated ids and rows
    included; ids are integers, a null one comes last among equal scores. Null
    texts have no terms and count nowhere. Empty tables give an empty table;
    other columns are not read.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_id_col, item_text_col))
    item_type = asked.schema["item_id"].dataType.simpleString()
    slices = asked.count() // slice_terms + 1
    home = f"{shared_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    sliced = asked.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int"))
    results = None
    for number in range(slices):
        folder = f"{home}/{number}"
        some = sliced.where(F.col("slice") == number).drop("slice")
        if some.isEmpty():
            continue
        some.write.parquet(f"{folder}/items")
        found = materialize(document_terms(docs, f"{folder}/items", id_col, text_col))
        documents, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        term_weights(found, documents).write.parquet(f"{folder}/weights")
        index = materialize(stratified_index(found, documents, length))
        salts = max(1, int(index.rdd.getNumPartitions() ** 0.5))
        first = _top(_searched(index, folder, True, best, item_type), best, salts)
        reached = first.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        reached.where(F.col("n") >= best).select("item_id", "least").write.parquet(f"{folder}/reached")
        top = _top(_searched(index, folder, False, best, item_type), best, salts)
        results = top if results is None else results.unionByName(top)
    if results is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, id long, score long")
    return results


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


OP12_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms
  FROM documents
), lengths AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark
), postings AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, docs
), impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS added
  FROM postings JOIN lengths USING (r) JOIN weights USING (term), totals
), scored AS (
  SELECT item_id, r, doc_id, sum(added)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
