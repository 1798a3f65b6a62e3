"""SimHash near-duplicates by pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are
tabled once. By the triangle inequality two fingerprints within ``max_bits``
differ by at most ``max_bits`` in every entry, so a pair with a larger
difference anywhere is discarded, and the survivors are verified bit by bit.
Fingerprints meet only where they can match at all: of five blocks of bits,
three flipped bits leave at least two whole, so each fingerprint goes to the
ten pairs of blocks. Inside such a bucket rows are sorted by their first pivot
distance and each is held against the rows within reach only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinframe.llm.components import connected_components
from twinframe.llm.tables import table
from twinframe.llm.text import texts_of
from twinframe.session import materialize

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Blocks of bits; a match leaves BLOCKS - MAX_BITS of them whole.
BLOCKS = 5
#: Rows of one bucket that one group holds; larger buckets are dealt as pairs of parts.
GROUP_ROWS = 4096


def _fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the shingle hashes."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long): the signed 64-bit fingerprint of each row's whole text.

    Words are runs without ASCII white space after lowering A-Z. A text of fewer
    words than a shingle is one shingle; null, empty and blank texts have
    fingerprint zero. One row per input row, repeated rows included.
    """

    def run(batches):
        for batch in batches:
            found = [_fingerprint(t.lower().split(), shingle) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _block_keys(fp: Column, max_bits: int) -> Column:
    """One key per choice of blocks that a match leaves whole."""
    blocks = max(BLOCKS, max_bits + 1)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for number, chosen in enumerate(combinations(masks, blocks - max_bits)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _pivot_table(fps: np.ndarray) -> np.ndarray:
    pivots = np.random.default_rng(SEED).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _matches(group: np.ndarray, fps: np.ndarray, max_bits: int):
    """Yields (i, j) index arrays of matching rows of one group, by their distance in the pivot order.

    Rows must be sorted by group. The table is sorted by its first column, so a
    row leaves the search once its next row lies out of reach.
    """
    tabled = _pivot_table(fps)
    order = np.lexsort((tabled[:, 0], group))
    group, tabled, fps = group[order], tabled[order], fps[order]
    live, step = np.arange(len(fps)), 1
    while True:
        live = live[live + step < len(fps)]
        near = live + step
        live = live[(group[near] == group[live]) & (tabled[near, 0] - tabled[live, 0] <= max_bits)]
        if not len(live):
            return
        near = live + step
        kept = np.abs(tabled[near, 1:] - tabled[live, 1:]).max(axis=1) <= max_bits
        i, j = live[kept], near[kept]
        same = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        yield order[i[same]], order[j[same]]
        step += 1


def spanning_links(pairs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n links (row, root) with the components of the pairs over rows 0..n-1."""
    root = np.arange(n)
    held, size = [], 0

    def absorb():
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root[:] = root[root]
        held.clear()

    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size > 1 << 20:
            absorb()
            size = 0
    absorb()
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; their components are those of all matching pairs.

    Only a spanning set of links leaves a task, so n near copies give at most n
    rows per choice of blocks. A bucket of over ``group_rows`` is cut into parts
    by hash and every pair of parts is its own group: no group is unbounded and
    no pair is lost. Groups travel in shards of about four groups' size.
    """
    keyed = fps.select("fp", F.inline(_block_keys(F.col("fp"), max_bits)))
    sizes = keyed.groupBy("choice", "bits").count().where("count > 1")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    key = F.xxhash64("choice", "bits", F.least("part", "other"), F.greatest("part", "other"))
    shards = keyed.count() // (4 * group_rows) + 1
    dealt = (
        keyed.join(sizes.withColumn("parts", F.ceil(F.col("count") / group_rows).cast("int")), ["choice", "bits"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "fp")
    )

    def link(rows):
        fp = rows.column("fp").to_numpy()
        pairs = _matches(rows.column("key").to_numpy(), fp.view(np.uint64), max_bits)
        a, b = spanning_links(pairs, len(fp))
        return pa.table({"a": fp[a], "b": fp[b]})

    return dealt.groupBy("shard").applyInArrow(link, "a long, b long").where("a <> b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over matching fingerprints.

    Equal fingerprints are one node, so any number of copies costs one search.
    Rows of null id keep a row and take the smallest known id of their
    component, null if there is none. An empty table gives an empty table.
    """
    rows = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")))
    found = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    lowest = placed.groupBy("component").agg(F.min("low").alias("smallest"))
    named = placed.join(lowest, "component").select("fp", "smallest")
    return rows.join(named, "fp").select("id", "fp", F.col("smallest").alias("component"))


def near_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its near-duplicate group, with all their columns.

    Rows of one id are one document and stay or go together; rows of null id
    stay. An empty table gives an empty table.
    """
    groups = simhash_components(docs, id_col, text_col)
    dropped = groups.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
