"""Approximate nearest neighbours by random-projection hash tables, with measured recall.

A table cuts space by random planes, each through the median of a bounded sample,
so that buckets hold about ``BUCKET`` vectors at any size of the pool.  Every vector
is in one bucket of every table.  A query looks into its own buckets first, which
bounds its k-th distance, and then into those across its nearest planes (multi-probe);
a bucket further away than that bound is left out, which loses nothing.  A bucket
larger than a block is searched block by block: none is capped.

How many tables are needed is measured: hash-chosen queries are searched exactly as
well, and tables are added until enough of their neighbours are found.  Where no
number of tables suffices, or those of a large pool would compare more than a fixed
share of it, the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinframe.operators import neighbors
from twinframe.session import materialize

#: Vectors of a bucket, on average; more are searched in blocks of ``neighbors.BLOCK``.
BUCKET = 512
#: Vectors that the planes are fitted to, and queries that recall is measured on.
SAMPLE = 4096
MEASURED = 256
#: Tables tried one after the other, and buckets a query visits per table at most.
TABLES = (4, 8, 16, 32)
PROBES = 12
#: Of so many nearest planes every set is considered for a probe.
FLIPS = 6
MAX_PLANES = 40
#: A pool of over so many blocks is searched exactly where its tables would compare over 1 / SHARE of it.
LARGE = 8
SHARE = 8
#: The measured recall must exceed the wanted one by this much, for it is an estimate.
SPARE = 0.02


class Planes:
    """Unit normals (table, plane, dimension) and the offset of every plane."""

    def __init__(self, sample: np.ndarray, tables: int, planes: int, seed: int):
        normals = np.random.default_rng(seed).normal(size=(tables, planes, sample.shape[1]))
        self.normals = normals / np.linalg.norm(normals, axis=2, keepdims=True)
        self.offsets = np.median(sample @ self.normals.reshape(tables * planes, -1).T, axis=0).reshape(tables, planes)

    def sides(self, points: np.ndarray) -> np.ndarray:
        """Signed distance to every plane: (point, table, plane)."""
        tables, planes, width = self.normals.shape
        return (points @ self.normals.reshape(-1, width).T).reshape(-1, tables, planes) - self.offsets

    def codes(self, sides: np.ndarray) -> np.ndarray:
        """Bucket number of every point in every table; the table is part of it."""
        tables, planes = self.offsets.shape
        bits = (sides >= 0) @ (1 << np.arange(planes, dtype=np.int64))
        return bits.astype(np.int64) | np.arange(tables, dtype=np.int64) << MAX_PLANES


def _codes(z: Column, planes: Planes) -> Column:
    @F.pandas_udf("array<bigint>")
    def code(vectors: pd.Series) -> pd.Series:
        parts = [
            planes.codes(planes.sides(np.stack(vectors.iloc[i : i + SAMPLE].to_numpy()))) for i in range(0, len(vectors), SAMPLE)
        ]
        return pd.Series(list(np.concatenate(parts)))

    return code(z)


def _probes(asked: DataFrame, planes: Planes, probes: int) -> DataFrame:
    """(vec, z, bound, cell): buckets beyond the own ones, nearest first, no further than ``bound``."""
    tables, count = planes.offsets.shape
    flips = min(FLIPS, count)
    sets = (np.arange(1, 1 << flips)[:, None] >> np.arange(flips) & 1).astype(bool)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), neighbors.TILE):
                part = batch.iloc[start : start + neighbors.TILE]
                sides = planes.sides(np.stack(part["z"].to_numpy()))
                own = planes.codes(sides)
                nearest = np.argsort(np.abs(sides), axis=2)[:, :, :flips]
                gaps = np.take_along_axis(sides, nearest, axis=2) ** 2
                # no vector across planes is nearer than any one of them; the sum only orders
                far = np.sqrt(np.where(sets, gaps[:, :, None, :], 0.0).max(axis=3))
                order = np.argsort(gaps @ sets.T.astype(float), axis=2)[:, :, : probes - 1]
                reach = np.take_along_axis(far, order, axis=2) <= part["bound"].to_numpy(float)[:, None, None]
                flipped = (np.int64(1) << nearest.astype(np.int64)) @ sets.T.astype(np.int64)
                cell = np.take_along_axis(own[:, :, None] ^ flipped, order, axis=2)
                query, table, place = np.nonzero(reach)
                chosen = part.iloc[query]
                yield pd.DataFrame({
                    "vec": chosen["vec"].to_numpy(), "z": chosen["z"].to_numpy(), "bound": chosen["bound"].to_numpy(float),
                    "cell": cell[query, table, place],
                })

    return asked.select("vec", "z", "bound").mapInPandas(probe, "vec bigint, z array<double>, bound double, cell bigint")


def _spread(visits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Visits with every block of their bucket, in chunks of bounded size."""
    met = visits.join(sizes, "cell")
    crowd = met.groupBy("cell").agg(F.count(F.lit(1)).alias("asking"))
    chunks = F.ceil(F.col("asking") / neighbors.BLOCK).cast("int")
    return (
        met.join(crowd, "cell")
        .withColumn("chunk", neighbors._blocks_of(F.col("vec"), chunks))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks", "asking")
    )


def _best(found: DataFrame) -> DataFrame:
    """A neighbour met in several tables counts once."""
    return found.groupBy("query", "neighbor", "synth").agg(F.min("dist").alias("dist")).select("query", "dist", "neighbor", "synth")


def nearest_in_tables(
    queries: DataFrame, pool: DataFrame, k: int, planes: Planes, probes: int = PROBES, few: bool = False
) -> DataFrame:
    """``(query, near)`` like ``neighbors.nearest_vectors``, from the buckets that are visited.

    Of a pool met by ``few`` queries only the buckets they can visit are kept.
    """
    named = queries.select("vec", "z", F.lit(float("inf")).alias("bound"), F.explode(_codes(F.col("z"), planes)).alias("cell"))
    placed = pool.select("vec", "z", "members", F.explode(_codes(F.col("z"), planes)).alias("cell"))
    if few:
        unbounded = queries.select("vec", "z", F.lit(float("inf")).alias("bound"))
        met = materialize(named.select("cell").unionByName(_probes(unbounded, planes, probes).select("cell")).distinct())
        placed = placed.join(F.broadcast(met), "cell", "left_semi")
    placed = materialize(placed)
    blocks = F.ceil(F.col("n") / neighbors.BLOCK).cast("int")
    sizes = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", blocks.alias("blocks")))
    placed = placed.join(sizes, "cell").withColumn("block", neighbors._blocks_of(F.col("vec"), F.col("blocks"))).drop("blocks")

    def searched(visits: DataFrame) -> DataFrame:
        dealt = _spread(visits, sizes)
        return neighbors._search(dealt, neighbors._to_chunks(placed, dealt), k, False)

    near = materialize(_best(searched(named)))
    order = Window.partitionBy("query").orderBy("dist", "neighbor", "synth")
    kth = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == k).select(
        F.col("query").alias("vec"), F.col("dist").alias("bound")
    )
    bounded = queries.select("vec", "z").join(kth, "vec", "left").fillna(float("inf"), ["bound"])
    more = searched(_probes(bounded, planes, probes))
    return neighbors._merge(_best(near.unionByName(more)), k)


def _recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the true neighbours that were found, the query itself left out; equally distant ones are as good."""
    reach = F.element_at("near", -1)["dist"] * (1 + 1e-12)
    true = exact.select("query", reach.alias("reach"), (F.size("near") - 1).alias("wanted"))
    hits = F.size(F.filter("near", lambda m: m["dist"] <= F.col("reach"))) - 1
    both = true.join(found, "query", "left").agg(
        F.sum(F.greatest(F.lit(0), F.coalesce(F.least(hits, F.col("wanted")), F.lit(0)))).alias("hits"), F.sum("wanted").alias("wanted")
    ).first()
    return both["hits"] / both["wanted"] if both["wanted"] else 1.0


def knn_approx(
    pair: DataFrame, id: str, k: int = 5, vector: str = "z", recall: float = 0.9, seed: int = 42, bucket: int = BUCKET
) -> DataFrame:
    """``(id, side, rank, neighbor, dist, same_side, recall, tables)``: about the k nearest others in the pooled pair.

    Rows, ties and copies are as in ``neighbors.knn_pooled``; distances are exact, but
    a neighbour may be missed.  ``recall`` is the share of true neighbours found for
    ``MEASURED`` hash-chosen vectors, and at least the wanted one; ``tables`` is the
    number of tables that took, 0 where the search was exact.  An empty pair gives an
    empty table.
    """
    rows = neighbors._rows(pair, id, vector)
    vectors = materialize(neighbors.distinct_vectors(rows, k + 1))
    size = vectors.count()
    planes = min(MAX_PLANES, max(0, int(np.ceil(np.log2(max(1, size) / bucket)))))
    # every visit carries its vector, an exact search only packed groups: beyond this it costs less
    worth = [t for t in TABLES if size <= LARGE * neighbors.BLOCK or t * PROBES * bucket * SHARE <= size]
    found, measured, used = None, 1.0, 0
    if planes and worth:
        turn = [F.xxhash64(F.lit(seed), "z"), F.col("vec")]
        sample = np.array([r["z"] for r in vectors.orderBy(*turn).limit(SAMPLE).select("z").collect()], float)
        chosen = materialize(vectors.orderBy(*turn).limit(MEASURED))
        exact = materialize(neighbors.nearest_vectors(chosen, vectors, k + 1, skip_self=False))
        for tables in worth:
            fitted = Planes(sample, tables, planes, seed)
            reached = _recall(nearest_in_tables(chosen, vectors, k + 1, fitted, few=True), exact)
            if reached >= min(1.0, recall + SPARE):
                found, measured, used = nearest_in_tables(vectors, vectors, k + 1, fitted), reached, tables
                break
    if found is None:
        found = neighbors.nearest_vectors(vectors, vectors, k + 1, skip_self=False)
    answers = vectors.select("vec", "z").join(found, F.col("vec") == F.col("query")).select("z", "near")
    return neighbors.listed(rows, answers, id, k).withColumns({"recall": F.lit(measured), "tables": F.lit(used)})
