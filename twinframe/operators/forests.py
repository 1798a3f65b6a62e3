"""Random forests over tables too large for Spark ML's, which holds an entry per row and tree.

The same forest: rows binned at up to 32 quantiles, Poisson(1) copies of a row in each
tree, a fresh choice of features at each node, Gini or variance gain, votes by the
classes of a leaf or the mean of its values, sibling leaves of one class merged.  Binned rows are packed into blocks; a
level is one pass, in which a task adds up a share of the blocks for some of the trees,
and the sums of a tree meet in one group.  Copies come from a stream per (tree, block),
so nothing is kept per row and tree between levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from twinframe.session import materialize

BINS = 32

#: Rows of a block, and of the blocks that a task reads.
BLOCK_ROWS = 32_768
SHARE_ROWS = 524_288

#: Tasks of a level while shares are few, and bytes of sums that a task holds.
LEVEL_TASKS = 48
SUM_BYTES = 64 << 20

#: 32-bit uniforms above the k-th bound stand for more than k copies.
_BOUNDS = np.array(
    [min(round(2**32 * p), 2**32 - 1) for p in np.exp(-1.0) * np.cumsum(1.0 / np.cumprod([1.0, *range(1, 12)]))],
    np.uint32,
)


def _stream(seed: int, tree: int, purpose: int, place: int) -> np.random.Philox:
    return np.random.Philox(key=np.array([seed % 2**64, tree], np.uint64), counter=[0, 0, purpose, place])


def _copies(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree: Poisson(1)."""
    raw = _stream(seed, tree, 0, block).random_raw(-(-n // 2))
    uniform = raw.view(np.uint32)[:n]
    found = np.zeros(n, np.uint8)
    for bound in _BOUNDS[:5]:
        found += uniform > bound
    many = np.flatnonzero(uniform > _BOUNDS[5])
    found[many] = np.searchsorted(_BOUNDS, uniform[many], side="left")
    return found


def _chosen(seed: int, tree: int, level: int, width: int, m: int) -> np.ndarray:
    """(nodes, m): the features that each node of a level may split on."""
    random = np.random.Generator(_stream(seed, tree, 1, level))
    return np.argsort(random.random((1 << level, width)), axis=1, kind="stable")[:, :m]


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(features, rows): the number of cuts below each value, as a byte."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)


def _cuts(rows: DataFrame, width: int, continuous: int) -> list[np.ndarray]:
    """Ends of the bins: between all values where few, else at quantiles of all rows; 0/1 features have one."""
    cuts = [np.array([0.5])] * width
    if not continuous:
        return cuts
    probabilities = [i / BINS for i in range(1, BINS)]
    entry = lambda i: F.get("x", F.lit(i))
    found = rows.agg(
        *[F.percentile_approx(entry(i), probabilities, 10_000) for i in range(continuous)],
        *[F.approx_count_distinct(entry(i)) for i in range(continuous)],
    ).first()
    few = [i for i in range(continuous) if found[continuous + i] <= 2 * BINS]
    sets = rows.agg(*[F.collect_set(entry(i)) for i in few]).first() if few else ()
    for i in range(continuous):
        cuts[i] = np.unique(np.array(found[i], float))
    for i, values in zip(few, sets):
        if len(values) <= BINS:
            values = np.sort(np.array(values, float))
            cuts[i] = values[:-1] / 2 + values[1:] / 2
    return cuts


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node), a node's children at 2i + 1 and 2i + 2; a leaf above the last level hands its rows left.

    ``leaves`` is (tree, leaf, class shares) or (tree, leaf, mean).
    """

    cuts: Sequence[np.ndarray]
    features: np.ndarray
    ends: np.ndarray
    leaves: np.ndarray
    classes: bool

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaf entries of every row."""
        n, flat = len(x), _binned(x, self.cuts).ravel()
        at, total = np.arange(n), np.zeros((n, self.leaves.shape[2]))
        inner = self.features.shape[1]
        for features, ends, leaves in zip(self.features, self.ends, self.leaves):
            total += leaves[_walked(flat, n, at, features * n, ends, inner.bit_length()) - inner]
        return total / len(self.leaves)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` of classes."""

        @F.pandas_udf("array<double>")
        def votes(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.votes(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

        found = rows.withColumn("_votes", votes(vector_to_array("features")))
        if not self.classes:
            return found.withColumn("prediction", F.get("_votes", F.lit(0))).drop("_votes")
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return found.withColumns(
            {"prediction": best.cast("double"), "probability": array_to_vector("_votes")}
        ).drop("_votes")


def _walked(flat, n, at, offsets, ends, levels) -> np.ndarray:
    """Node of each row ``at`` after so many levels; ``offsets`` are features times the rows of the block."""
    node = np.zeros(len(at), np.int64)
    for _ in range(levels):
        right = flat.take(offsets.take(node) + at) > ends.take(node)
        node *= 2
        node += 1
        node += right
    return node


def _blocks(rows: DataFrame, cuts: Sequence[np.ndarray], shares: int) -> DataFrame:
    """``(block, n, bins, y)`` of binned rows, dealt over ``shares`` partitions."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number, part = [], 0, 0

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            bins = _binned(np.stack(frame["x"].to_numpy()), cuts)
            y = frame["y"].to_numpy(np.float64)
            return pd.DataFrame({"block": [(part << 24) + number], "n": [len(y)], "bins": [bins.tobytes()], "y": [y.tobytes()]})

        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            held.append(batch)
            while sum(map(len, held)) >= BLOCK_ROWS:
                whole = pd.concat(held, ignore_index=True)
                yield packed(whole.iloc[:BLOCK_ROWS])
                held, number = [whole.iloc[BLOCK_ROWS:]], number + 1
        if sum(map(len, held)):
            yield packed(pd.concat(held, ignore_index=True))

    numbered = rows.withColumn("part", F.spark_partition_id())
    blocks = numbered.mapInPandas(pack, "block long, n long, bins binary, y binary")
    return materialize(blocks.repartition(shares))


def _added(dealt: DataFrame, groups: int, level: int, state: dict) -> DataFrame:
    """``(tree, sums)``: the sums of the open nodes of a level over the blocks of a partition, for the trees of its group."""
    seed, width, m, classes, center = (state[k] for k in ("seed", "width", "m", "classes", "center"))
    features, ends, is_open = (state[k] for k in ("features", "ends", "open"))
    nodes = 1 << level

    def sums(tree: int, block: int, n: int, flat: np.ndarray, y: np.ndarray) -> np.ndarray:
        copies = _copies(seed, tree, block, n)
        at = np.flatnonzero(copies)
        node = _walked(flat, n, at, features[tree] * n, ends[tree], level) - (nodes - 1)
        if not is_open[tree].all():
            kept = is_open[tree][node]
            at, node = at[kept], node[kept]
        times = copies[at].astype(float)
        chosen = _chosen(seed, tree, level, width, m).T * n
        y = y.take(at)
        # classes are counted each, values by their number and sum
        if classes:
            start, weights, size = node * (BINS * classes) + y, [times], nodes * BINS * classes
        else:
            start, weights, size = node * BINS, [times, times * y], nodes * BINS
        found = np.empty((m, len(weights), size))
        for j in range(m):
            cell = flat.take(chosen[j].take(node) + at).astype(np.int64)
            if classes:
                cell *= classes
            cell += start
            for k, weight in enumerate(weights):
                found[j, k] = np.bincount(cell, weight, size)
        return found

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, block, n, bins, y in batch[["group", "block", "n", "bins", "y"]].itertuples(index=False):
                flat, y = np.frombuffer(bins, np.uint8), np.frombuffer(y, np.float64)
                y = y.astype(np.int64) if classes else y - center
                for t in range(group, len(features), groups):
                    if is_open[t].any():
                        found = sums(t, int(block), int(n), flat, y)
                        if t in totals:
                            totals[t] += found
                        else:
                            totals[t] = found
        yield pd.DataFrame({"tree": list(totals), "sums": [found.tobytes() for found in totals.values()]})

    return dealt.mapInPandas(add, "tree int, sums binary")


def _best(sums: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the best choice and bin (-1: none) and the left and right sums, from (m, nodes, BINS, stats)."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left

    def weight(part):
        return part.sum(axis=-1) if classes else part[..., 0]

    def held(part):
        squares = (part * part).sum(axis=-1) if classes else part[..., 1] ** 2
        return squares / np.maximum(weight(part), 1.0)

    n = weight(whole)
    apart = held(left) + held(right)
    gain = (apart - held(whole)) / np.maximum(n, 1.0)
    # what rounding alone may leave is no gain
    gain[(weight(left) < 1) | (weight(right) < 1) | (apart - held(whole) <= 1e-12 * apart)] = -1.0
    m, nodes, cells = gain.shape
    place = gain.transpose(1, 0, 2).reshape(nodes, m * cells)
    best = place.argmax(axis=1)
    j, end, each = best // cells, best % cells, np.arange(nodes)
    return np.where(place[each, best] < 0, -1, j), end, left[j, each, end], right[j, each, end], whole[0, :, 0]


def _merge(features: np.ndarray, ends: np.ndarray, found: np.ndarray) -> None:
    """Make a leaf of every node whose children are leaves of the same class, from the bottom up."""
    inner, best = features.shape[1], found.argmax(axis=2)
    leaf = np.ones(best.shape, bool)
    leaf[:, :inner] = ends == BINS
    for node in reversed(range(inner)):
        left, right = 2 * node + 1, 2 * node + 2
        same = ~leaf[:, node] & leaf[:, left] & leaf[:, right] & (best[:, left] == best[:, right])
        leaf[same, node], ends[same, node], features[same, node] = True, BINS, 0


def grow(
    rows: DataFrame, continuous: int, classes: int, trees: int, depth: int, seed: int
) -> Forest:
    """A forest of ``rows`` (y, features): ``classes`` of them, or values where it is 0.

    The first ``continuous`` features are numbers, the others 0 or 1.
    """
    rows = rows.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x"))
    known = F.col("y").isNotNull() & ~F.isnan("y")
    n, width, center, unknown = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("y"), F.count_if(~known)).first()
    if unknown:
        raise ValueError(f"{unknown} rows have no value to learn")
    cuts = _cuts(rows, width, continuous)
    shares = max(1, ceil(n / SHARE_ROWS))
    blocks = _blocks(rows, cuts, shares)
    m = min(width, ceil(sqrt(width)) if classes else ceil(width / 3))
    inner, stats = (1 << depth) - 1, max(classes, 2)
    features, ends = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.uint8)
    state = {"seed": seed, "width": width, "m": m, "classes": classes, "center": center}
    found = np.zeros((trees, 2 * inner + 1, stats))
    is_open = np.ones((trees, 1), bool)
    # every share is read by one task for each group of trees
    held = 8 * m * (1 << (depth - 1)) * BINS * stats
    groups = min(trees, max(1, LEVEL_TASKS // shares, ceil(trees * held / SUM_BYTES)))
    dealt = reduce(DataFrame.unionByName, [blocks.withColumn("group", F.lit(g)) for g in range(groups)])
    for level in range(depth):
        nodes = 1 << level
        state |= {"features": features, "ends": ends, "open": is_open}

        def split(frame: pd.DataFrame) -> pd.DataFrame:
            # in an order of their own, so that rounding does not follow the shuffle
            total = sum(np.frombuffer(s) for s in sorted(frame["sums"]))
            shape = (m, nodes, BINS, stats) if classes else (m, stats, nodes, BINS)
            total = total.reshape(shape)
            j, end, *sides = _best(total if classes else np.moveaxis(total, 1, 3), classes)
            tree = int(frame["tree"].iloc[0])
            feature = _chosen(seed, tree, level, width, m)[np.arange(nodes), j]
            packed = np.stack(sides).tobytes()
            return pd.DataFrame({"tree": [tree], "feature": [np.where(j < 0, -1, feature)], "end": [end], "sides": [packed]})

        best = _added(dealt, groups, level, state).groupBy("tree").applyInPandas(split, "tree int, feature array<int>, end array<int>, sides binary")
        first, after = nodes - 1, 2 * nodes - 1
        features, ends = features.copy(), ends.copy()
        following = np.zeros((trees, 2 * nodes), bool)
        for r in best.collect():
            t, feature, end = r["tree"], np.array(r["feature"]), np.array(r["end"])
            left, right, whole = np.frombuffer(r["sides"]).reshape(3, nodes, stats)
            if level == 0:
                found[t, 0] = whole[0]
            cut = is_open[t] & (feature >= 0)
            features[t, first:after][cut], ends[t, first:after][cut] = feature[cut], end[cut]
            for side, part in enumerate((left, right)):
                found[t, after + side : after + 2 * nodes : 2][cut] = part[cut]
                mixed = (part > 0).sum(axis=1) > 1 if classes else part[:, 0] > 1
                following[t, side::2] = cut & mixed
        is_open = following
    if classes:
        _merge(features, ends, found)
    # rows of a leaf go left, level by level
    for node in range(inner):
        uncut = ends[:, node] == BINS
        found[uncut, 2 * node + 1] = found[uncut, node]
    leaves = found[:, inner:]
    if classes:
        leaves = leaves / np.maximum(leaves.sum(axis=2, keepdims=True), 1.0)
    else:
        leaves = center + leaves[:, :, 1:] / np.maximum(leaves[:, :, :1], 1.0)
    return Forest(cuts, features, ends, leaves, bool(classes))
