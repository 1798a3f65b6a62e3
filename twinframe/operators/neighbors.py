"""Exact nearest-neighbour joins and the record-level metrics built on them.

Vectors are reduced to distinct ones first: copies share their neighbours, so a
group of copies of any size costs one search.  The pool is split into cells
around sampled pivots and each cell into blocks of bounded size.  Every query is
first searched in one block near its own pivot, which bounds its k-th distance;
then it visits only the blocks that can hold something closer.  Groups of queries
meet packed blocks inside tasks, where only tiles whose boxes are near enough are
compared, by a matrix product that leaves few pairs to measure; only the k best per
query leave a task.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinframe.operators.cumulative import exact_quantiles
from twinframe.operators.features import encode_mixed
from twinframe.operators.sampling import sample_sides
from twinframe.session import materialize

#: Distinct vectors per block, of pool and of queries: at most BLOCK, and fewer (down
#: to MIN_BLOCK) when a table would not keep all cores busy.
BLOCK = 4096
MIN_BLOCK = 128
MAX_PIVOTS = 1024

#: Rows of one distance tile.
TILE = 256
#: One point in so many shows whether boxes of tiles leave anything out.
PROBE = 64
#: Blocks' worth of queries that travel together, and blocks that meet them in one task.
GROUP = 8
RUN = 16
SALTS = 32
#: Numbers of close pairs that are measured at a time.
MEASURED = 1 << 20
#: Tasks of the second search per core, where the table gives as many.
SHARES = 4
MAX_TASKS = 4096

NEIGHBOUR = "struct<dist:double,neighbor:bigint,side:string>"
FOUND = "query bigint, dist double, neighbor bigint, synth boolean"


def _keyed(rows: DataFrame) -> DataFrame:
    """Add ``_h``, the hash of ``z``: with it first, sorts by vector compare numbers, and arrays only where they are equal."""
    return rows.withColumn("_h", F.xxhash64("z"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per vector: ``(vec, z, n_real, n_synth, members)``.

    ``members`` are the ``keep`` smallest (id, side); the row_number limit is
    applied before the shuffle, so a hot vector sends few rows per task.
    ``vec`` numbers the vectors; callers materialize the result, which fixes it.
    A row is told apart by side and id, since both sides may use the same ids.
    """
    rows = _keyed(rows.select("z", "id", "side"))
    order = Window.partitionBy("_h", "z").orderBy("id", "side")
    members = (
        rows.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= keep)
        .groupBy("_h", "z")
        .agg(F.array_sort(F.collect_list(F.struct("id", "side"))).alias("members"))
    )
    sizes = rows.groupBy("_h", "z").agg(
        F.count_if(F.col("side") == "real").alias("n_real"),
        F.count_if(F.col("side") == "synth").alias("n_synth"),
    )
    return members.join(sizes, ["_h", "z"]).select(
        F.monotonically_increasing_id().alias("vec"), "z", "n_real", "n_synth", "members"
    )


def _block_size(pool: DataFrame, size: int) -> int:
    per_core = size // (2 * pool.sparkSession.sparkContext.defaultParallelism)
    return max(min(MIN_BLOCK, BLOCK), min(BLOCK, per_core))


def _choose_pivots(pool: DataFrame, wanted: int) -> np.ndarray:
    """Up to ``MAX_PIVOTS`` pool vectors in hash order: a driver array of fixed bound."""
    wanted = max(1, min(MAX_PIVOTS, wanted))
    rows = pool.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("z").collect()
    return np.array([r["z"] for r in rows], float)


def _pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(pivots)))
    gap = np.empty_like(total)
    for d in range(points.shape[1]):
        np.subtract(points[:, d, None], pivots[None, :, d], out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return np.sqrt(total, out=total)


class Ready:
    """Targets of products: the sound ones around their center, in the kinds of numbers asked for so far."""

    def __init__(self, targets: np.ndarray):
        self.sound = np.flatnonzero(np.isfinite(targets).all(axis=1))
        if len(self.sound):
            self.center = targets[self.sound].mean(axis=0)
            self.right = targets[self.sound] - self.center
            self.reach = np.sqrt((self.right * self.right).sum(axis=1)).max()
        self.factors: dict[type, np.ndarray] = {}

    def factor(self, kind: type) -> np.ndarray:
        if kind not in self.factors:
            right = self.right.astype(kind)
            self.factors[kind] = np.column_stack([right, np.ones(len(right), kind), (right * right).sum(axis=1)]).T
        return self.factors[kind]


def _close(
    points: np.ndarray, targets: np.ndarray, bounds: np.ndarray, k: int, ready: Ready | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, target, distance) of all pairs within the point's bound and its k-th distance here.

    A product in short numbers with room for its rounding leaves few pairs; only those
    are measured, in full numbers.  Vectors with a non-finite part are near to nothing.
    """
    ready = ready or Ready(targets)
    sound = ready.sound
    if not len(sound):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    left = points - ready.center
    reach = np.sqrt((left * left).sum(axis=1)) + ready.reach
    kind = np.float32 if np.nanmax(reach, initial=0.0) < 1e15 else np.float64
    slack = (reach * reach) * (2 * (points.shape[1] + 8) * np.finfo(kind).eps)
    left = left.astype(kind)
    # one product gives |x|^2 - 2 xy + |y|^2
    square = np.column_stack([-2 * left, (left * left).sum(axis=1), np.ones(len(left), kind)]) @ ready.factor(kind)
    limit = bounds * bounds * (1 + 1e-6) + slack
    if len(sound) > k and not np.isfinite(bounds).all():
        limit = np.fmin(limit, np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * slack)
    with np.errstate(over="ignore"):
        within = square <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]
    point, target = np.divmod(np.flatnonzero(within), len(sound))
    target = sound[target]
    dist = _measured(points, targets, point, target)
    kept = (dist <= bounds[point]) & np.isfinite(dist)
    return point[kept], target[kept], dist[kept]


def _measured(points: np.ndarray, targets: np.ndarray, point: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Distances of the numbered pairs, summed in the order of ``_pivot_distances``; a bounded run of pairs at a time."""
    dist = np.zeros(len(point))
    step = max(1, MEASURED // max(1, points.shape[1]))
    for start in range(0, len(point) if points.shape[1] else 0, step):
        run = slice(start, start + step)
        gap = points[point[run]] - targets[target[run]]
        np.multiply(gap, gap, out=gap)
        # a running sum adds one by one; a plain sum would add by halves and round otherwise
        dist[run] = np.sqrt(np.cumsum(gap, axis=1, out=gap)[:, -1])
    return dist


def _first_k(query, dist, ids, synth, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best of every query, in order, and their ranks."""
    order = np.lexsort((synth, ids, dist, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return order[rank < k], rank[rank < k]


def _members(vector: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every close vector stands for its members: (index into ``vector``, member)."""
    times = lengths[vector]
    found = np.repeat(np.arange(len(vector)), times)
    place = np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times)
    return found, starts[vector[found]] + place


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``radius`` (distance to it)."""

    @F.pandas_udf("struct<cell:int,radius:double>")
    def nearest(z: pd.Series) -> pd.DataFrame:
        cells, radii = [], []
        for start in range(0, len(z), BLOCK):
            away = _pivot_distances(np.stack(z.iloc[start : start + BLOCK].to_numpy()), pivots)
            cell = away.argmin(axis=1)
            cells.append(cell)
            radii.append(away[np.arange(len(cell)), cell])
        return pd.DataFrame({"cell": np.concatenate(cells), "radius": np.concatenate(radii)})

    return rows.withColumn("_at", nearest("z")).select("*", "_at.cell", "_at.radius").drop("_at")


def _blocks_of(vec: Column, count: Column) -> Column:
    """Spread the vectors of a cell evenly over its blocks."""
    return F.pmod(F.xxhash64(vec, F.lit("block")), F.greatest(count, F.lit(1))).cast("int")


def _search(queries: DataFrame, pool: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Best ``k`` members within ``bound`` per (query, block), as rows.

    Both sides come by (cell, block, chunk).
    """

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "dist": [], "neighbor": [], "synth": []})
        lengths = right["ids"].map(len).to_numpy()
        starts = np.cumsum(lengths) - lengths
        ids, synth = (np.concatenate(right[c].to_numpy()) for c in ("ids", "synths"))
        points, targets = np.stack(left["z"].to_numpy()), np.stack(right["z"].to_numpy())
        queries, names = left["vec"].to_numpy(), right["vec"].to_numpy()
        bounds = left["bound"].to_numpy(float)
        found = []
        ready = Ready(targets)
        for start in range(0, len(points), TILE):
            tile = slice(start, start + TILE)
            query, vector, dist = _close(points[tile], targets, bounds[tile], k + skip_self, ready)
            if skip_self:
                other = queries[tile][query] != names[vector]
                query, vector, dist = query[other], vector[other], dist[other]
            at, member = _members(vector, lengths, starts)
            query, dist = query[at], dist[at]
            kept, _ = _first_k(query, dist, ids[member], synth[member], k)
            found.append(
                pd.DataFrame(
                    {"query": queries[tile][query[kept]], "dist": dist[kept],
                     "neighbor": ids[member[kept]], "synth": synth[member[kept]]}
                )
            )
        return pd.concat(found)

    by = ["cell", "block", "chunk"]
    # both sides may stem from one table: rename to get distinct columns
    left = queries.select(*by, "vec", "z", "bound").toDF(*by, "vec", "z", "bound")
    right = pool.select(
        *by, "vec", "z", F.col("members.id").alias("ids"),
        F.transform("members.side", lambda s: s == "synth").alias("synths"),
    ).toDF(*by, "vec", "z", "ids", "synths")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, FOUND)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best over all blocks of a query, as one array."""
    order = Window.partitionBy("query").orderBy("dist", "neighbor", "synth")
    side = F.when(F.col("synth"), "synth").otherwise("real")
    return (
        found.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= k)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "neighbor", side.alias("side"))))
             .alias("near"))
    )


def nearest_vectors(queries: DataFrame, pool: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """``(query, near)``: the k nearest pool members of every distinct query vector.

    ``queries`` carry (vec, z); ``pool`` carries (vec, z, members).  Both are read
    several times and should be materialized.  ``skip_self`` leaves out the pool
    vector of the same name.
    """
    size = pool.count()
    if size == 0 or queries.isEmpty():
        return queries.select(
            F.col("vec").alias("query"), F.array().cast(f"array<{NEIGHBOUR}>").alias("near")
        )
    block = _block_size(pool, size)
    pivots = _choose_pivots(pool, -(-size // block))
    placed = _assign(pool.select("vec", "z", "members"), pivots)
    if len(pivots) > 1:
        placed = materialize(placed)
    if queries is pool:
        asked = placed.drop("members")
    else:
        asked = _assign(queries.select("vec", "z"), pivots)
        asked = materialize(asked) if len(pivots) > 1 else asked

    # one row per pivot: how many blocks a cell has, and its distance range
    cells = {
        r["cell"]: r
        for r in placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"),
             F.max("radius").alias("high"))
        .collect()
    }
    here = sorted(cells)
    parts = {c: -(-cells[c]["n"] // block) for c in here}
    part_map = _number_map(parts)
    placed = placed.withColumn("block", _blocks_of(F.col("vec"), part_map[F.col("cell")]))

    # queries travel in chunks of bounded size, near ones together
    homes = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    chunk_map = _number_map({c: -(-n // block) for c, n in homes.items()})
    first = np.cumsum([0] + [-(-homes[c] // block) for c in sorted(homes)])
    base_map = _number_map({c: int(first[i]) for i, c in enumerate(sorted(homes))})
    asked = asked.withColumn(
        "chunk",
        (base_map[F.col("cell")]
         + _blocks_of(F.col("vec"), chunk_map[F.col("cell")])).cast("int"),
    )

    # first round: one block of the query's own cell
    home = asked.withColumns(
        {"block": _blocks_of(F.col("chunk"), part_map[F.col("cell")]),
         "bound": F.lit(float("inf"))}
    )
    near = _search(home, _to_chunks(placed, home), k, skip_self)
    if sum(parts.values()) == 1:
        return _merge(near, k)
    near = materialize(near)

    # second round: every block that may hold something as close as the k-th so far
    far = F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf")))
    reached = near.groupBy(F.col("query").alias("vec")).agg(far.alias("bound"))
    bounded = home.drop("bound").join(reached, "vec", "left").fillna(float("inf"), ["bound"])
    more = _search_far(bounded, placed, pivots, here, cells, parts, homes, block, k, skip_self)
    return _merge(near.unionByName(more), k)


def _number_map(numbers: dict[int, int]) -> Column:
    """Small int -> long dictionary as a constant."""
    text = ",".join(f"{key}:{value}" for key, value in numbers.items())
    return F.str_to_map(F.lit(text), F.lit(","), F.lit(":")).cast("map<int,bigint>")


def _to_chunks(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """One copy of a pool block per query chunk that visits it."""
    needed = queries.select("cell", "block", "chunk").distinct().toDF("cell", "block", "chunk")
    return pool.join(needed, ["cell", "block"])


def _in_turn(points: np.ndarray) -> np.ndarray:
    """An order in which every run of ``TILE`` lies close together: halved along the widest dimension."""
    done, left = [], [np.arange(len(points))]
    while left:
        some = left.pop()
        if len(some) <= TILE:
            done.append(some)
            continue
        part = points[some]
        with np.errstate(invalid="ignore"):
            wide = int(np.argmax(np.nan_to_num(np.ptp(part, axis=0))))
        half = (len(some) // 2 + TILE - 1) // TILE * TILE
        order = np.argpartition(part[:, wide], half - 1)
        left += [some[order[half:]], some[order[:half]]]
    return np.concatenate(done)


def _boxes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of every run of ``TILE``."""
    starts = np.arange(0, len(points), TILE)
    return np.fmin.reduceat(points, starts), np.fmax.reduceat(points, starts)


def _near_tiles(points: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(point, tile): tiles whose box is not farther from the point than its bound."""
    total = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        value = points[:, d, None]
        gap = np.fmax(np.fmax(low[:, d] - value, value - high[:, d]), 0.0)
        total += gap * gap
    # a little slack: rounding must not exclude a tie
    return np.sqrt(total) <= (bounds * (1 + 1e-9) + 1e-9)[:, None]


def _in_block(points: np.ndarray, bounds: np.ndarray, asks: np.ndarray, targets: np.ndarray, k: int):
    """Runs of (point, target, distance) as of ``_close``, for the points numbered ``asks``.

    Every point meets only the tiles it may find something in; where a few points show
    that this leaves most of them, as in many dimensions, all are compared.
    """
    if not len(asks):
        return
    low, high = _boxes(targets)
    few = asks[::PROBE]
    if _near_tiles(points[few], bounds[few], low, high).mean() > 0.5:
        ready = Ready(targets)
        for start in range(0, len(asks), TILE):
            some = asks[start : start + TILE]
            point, target, dist = _close(points[some], targets, bounds[some], k, ready)
            yield some[point], target, dist
        return
    for start in range(0, len(asks), BLOCK):
        some = asks[start : start + BLOCK]
        near = _near_tiles(points[some], bounds[some], low, high)
        for tile in np.flatnonzero(near.any(axis=0)):
            those, first = some[near[:, tile]], tile * TILE
            point, target, dist = _close(points[those], targets[first : first + TILE], bounds[those], k)
            yield those[point], first + target, dist


@dataclass(frozen=True)
class Cells:
    """Pivots, and the distance range of the pool around those that have any."""

    pivots: np.ndarray
    here: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def least(self, points: np.ndarray, home: np.ndarray, own: np.ndarray, which) -> np.ndarray:
        """(point, cell): no point of the cell is nearer than this, by the triangle inequality.

        A cell's points lie between ``low`` and ``high`` from its pivot and nearer to it
        than to any other pivot; both facts bound their distance to the query.
        """
        targets, low, high = self.pivots[self.here[which]], self.low[which], self.high[which]
        away = _pivot_distances(points, targets)
        gap = np.maximum(np.maximum(away - high, low - away), 0.0)
        homes, at = np.unique(home, return_inverse=True)
        apart = _pivot_distances(self.pivots[homes], targets)[at]
        plane = np.where(
            apart > 0, (away * away - (own * own)[:, None]) / (2 * np.where(apart > 0, apart, 1.0)), 0.0
        )
        return np.maximum(gap, plane)


def _turns(pivots: np.ndarray, homes: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int]]:
    """First group, and number of groups, of the queries of every cell: near cells share one of about ``size``."""
    order = [c for c in _nearby(pivots) if c in homes]
    first, count, group, held = {}, {}, 0, 0
    for c in order:
        if held and held + homes[c] > size:
            group, held = group + 1, 0
        first[c], count[c] = group, -(-homes[c] // size)
        held += homes[c]
        if count[c] > 1:
            group, held = group + count[c], 0
    return first, count


def _nearby(points: np.ndarray) -> list[int]:
    """Numbers of the points in an order that keeps near ones together."""
    done, left = [], [np.arange(len(points))]
    while left:
        some = left.pop()
        if len(some) < 2:
            done += some.tolist()
            continue
        part = points[some]
        order = np.argsort(part[:, int(np.argmax(np.nan_to_num(np.ptp(part, axis=0))))], kind="stable")
        left += [some[order[len(some) // 2 :]], some[order[: len(some) // 2]]]
    return done


def _task_shape(asked: int, blocks: int, cores: int) -> tuple[int, int]:
    """Blocks' worth of queries per group and blocks per run: less of both while a small table leaves cores idle."""
    group, run = GROUP, RUN
    while group > 1 and -(-asked // group) * -(-blocks // run) < SHARES * cores:
        group, run = group // 2, run // 2
    return group, run


def _search_far(bounded, placed, pivots, here, cells, parts, homes, block: int, k: int, skip_self: bool) -> DataFrame:
    """Best ``k`` members within ``bound`` per query and run of blocks, beyond the block searched first.

    Queries travel in groups of up to ``GROUP`` blocks, the pool in packed blocks, one copy
    per group that may find something there; up to ``RUN`` blocks meet a group in one task,
    which narrows the bounds from block to block.
    """
    total = sum(parts.values())
    cores = bounded.sparkSession.sparkContext.defaultParallelism
    group_blocks, run_blocks = _task_shape(-(-sum(homes.values()) // block), total, cores)
    map_ = Cells(
        pivots, np.array(here), np.array([cells[c]["low"] for c in here]), np.array([cells[c]["high"] for c in here])
    )
    index = {c: i for i, c in enumerate(here)}
    turn = [c for c in _nearby(pivots) if c in index]
    firsts = dict(zip(turn, np.cumsum([0] + [parts[c] for c in turn]).tolist()))

    def pack_pool(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(rows["z"].to_numpy())
        order = _in_turn(z)
        rows, z = rows.iloc[order], z[order]
        lengths = rows["ids"].map(len).to_numpy("<i8")
        ids, synth = (np.concatenate(rows[c].to_numpy()) for c in ("ids", "synths"))
        return pd.DataFrame([{
            "cell": int(rows["cell"].iloc[0]), "block": int(rows["block"].iloc[0]), "z": z.astype("<f8").tobytes(),
            "vec": rows["vec"].to_numpy("<i8").tobytes(), "lengths": lengths.tobytes(),
            "ids": ids.astype("<i8").tobytes(), "synths": synth.astype("u1").tobytes(),
        }])

    blocks = (
        placed.select("cell", "block", "vec", "z", F.col("members.id").alias("ids"),
                      F.transform("members.side", lambda s: s == "synth").alias("synths"))
        .groupBy("cell", "block")
        .applyInPandas(pack_pool, "cell int, block int, z binary, vec binary, lengths binary, ids binary, synths binary")
    )

    def pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(rows["z"].to_numpy())
        order = _in_turn(z)
        rows, z = rows.iloc[order], z[order]
        # a little slack: rounding must not exclude a tie
        reach = rows["bound"].to_numpy("<f8") * (1 + 1e-9) + 1e-9
        home, own = rows["cell"].to_numpy("<i4"), rows["radius"].to_numpy("<f8")
        met = np.zeros(len(map_.here), bool)
        for start in range(0, len(z), TILE):
            tile = slice(start, start + TILE)
            met |= (map_.least(z[tile], home[tile], own[tile], slice(None)) <= reach[tile, None]).any(axis=0)
            if met.all():
                break
        return pd.DataFrame([{
            "group": int(rows["group"].iloc[0]), "z": z.astype("<f8").tobytes(), "vec": rows["vec"].to_numpy("<i8").tobytes(),
            "bound": reach.tobytes(), "home": home.tobytes(), "own": own.tobytes(),
            "searched": rows["block"].to_numpy("<i4").tobytes(), "cells": map_.here[met].tolist(),
        }])

    first, count = _turns(pivots, homes, group_blocks * block)
    group = _number_map(first)[F.col("cell")] + F.pmod(
        F.xxhash64("vec", F.lit("group")), _number_map(count)[F.col("cell")]
    )
    asked = materialize(
        bounded.withColumn("group", group.cast("int"))
        .select("group", "vec", "z", "cell", "block", "radius", "bound")
        .groupBy("group")
        .applyInPandas(
            pack_queries,
            "group int, z binary, vec binary, bound binary, home binary, own binary, searched binary, cells array<int>",
        )
    )
    visits = (
        asked.select("group", F.explode("cells").alias("cell"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (_number_map(parts)[F.col("cell")] - 1).cast("int"))))
        .withColumn("run", F.floor((_number_map(firsts)[F.col("cell")] + F.col("block")) / run_blocks).cast("int"))
    )

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "dist": [], "neighbor": [], "synth": []})
        if not len(left) or not len(right):
            return empty
        asked = left.iloc[0]
        names = np.frombuffer(asked["vec"], "<i8")
        points = np.frombuffer(asked["z"], "<f8").reshape(len(names), -1)
        bound = np.frombuffer(asked["bound"], "<f8").copy()
        home, own = np.frombuffer(asked["home"], "<i4"), np.frombuffer(asked["own"], "<f8")
        searched = np.frombuffer(asked["searched"], "<i4")
        held = [np.zeros(0, int), np.zeros(0), np.zeros(0, "<i8"), np.zeros(0, bool)]
        pending, waiting = [held], 0
        # bounds fall from block to block, the distances to cells stay
        cells_here = np.unique(right["cell"])
        least = map_.least(points, home, own, [index[c] for c in cells_here])
        for row in right.sort_values(["cell", "block"]).itertuples():
            vecs, lengths = np.frombuffer(row.vec, "<i8"), np.frombuffer(row.lengths, "<i8")
            ids, synth = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.synths, "u1").astype(bool)
            targets, starts = np.frombuffer(row.z, "<f8").reshape(len(vecs), -1), np.cumsum(lengths) - lengths
            seen = (home == row.cell) & (searched == row.block)
            asks = np.flatnonzero((least[:, np.searchsorted(cells_here, row.cell)] <= bound) & ~seen)
            for query, vector, dist in _in_block(points, bound, asks, targets, k + skip_self):
                if skip_self:
                    other = names[query] != vecs[vector]
                    query, vector, dist = query[other], vector[other], dist[other]
                if not len(query):
                    continue
                place, member = _members(vector, lengths, starts)
                pending.append([query[place], dist[place], ids[member], synth[member]])
                waiting += len(place)
            if waiting > len(names):
                pending, waiting = [_narrow(pending, bound, k)], 0
        query, dist, neighbor, synths = _narrow(pending, bound, k)
        return pd.DataFrame({"query": names[query], "dist": dist, "neighbor": neighbor, "synth": synths})

    # both sides stem from the same visits: rename to get distinct columns
    left = asked.drop("cells").join(visits.select("group", "run").distinct(), "group")
    left = left.toDF(*left.columns)
    right = blocks.join(visits.toDF(*visits.columns), ["cell", "block"])
    right = right.toDF(*right.columns)
    # a number of its own keeps what is small in bytes, but long to compare, from being put together
    tasks = max(first[c] + count[c] for c in first) * -(-total // run_blocks)
    left, right = (side.repartition(min(tasks, MAX_TASKS), "group", "run") for side in (left, right))
    return left.groupBy("group", "run").cogroup(right.groupBy("group", "run")).applyInPandas(best, FOUND)


def _narrow(pending: list, bound: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` best so far of every query; ``bound`` falls to the k-th distance."""
    query, dist, ids, synth = (np.concatenate(x) for x in zip(*pending))
    kept, rank = _first_k(query, dist, ids, synth, k)
    full = kept[rank == k - 1]
    bound[query[full]] = np.minimum(bound[query[full]], dist[full] * (1 + 1e-9) + 1e-9)
    return [query[kept], dist[kept], ids[kept], synth[kept]]


def _to_rows(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Give every row the answer of its vector; rows of one vector spread over salts.

    ``answers`` has (z, ...), one row per vector.  It is copied only to the salts
    that a vector's rows really use.
    """
    salted = _keyed(rows).withColumn("_salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)))
    used = salted.select("_h", "z", "_salt").distinct()
    copied = _keyed(answers).join(used, ["_h", "z"])
    return salted.join(copied, ["_h", "z", "_salt"]).drop("_h", "_salt")


def _rows(table: DataFrame, id: str, vector: str) -> DataFrame:
    return table.select(
        F.col(id).cast("long").alias("id"),
        "side",
        F.col(vector).cast("array<double>").alias("z"),
    )


def knn_pooled(pair: DataFrame, id: str, k: int = 5, vector: str = "z") -> DataFrame:
    """``(id, side, rank, neighbor, dist, same_side)``: k nearest others in the pooled pair.

    A row is told apart from its copies by side and id, never by position.
    """
    rows = _rows(pair, id, vector)
    vectors = materialize(distinct_vectors(rows, k + 1))
    found = _pooled(vectors, k)
    answers = vectors.select("vec", "z").join(found, F.col("vec") == F.col("query")).select(
        "z", "near"
    )
    return listed(rows, answers, id, k)


def listed(rows: DataFrame, answers: DataFrame, id: str, k: int) -> DataFrame:
    """One row per row and neighbour from ``answers`` (z, near), the row itself left out."""
    others = F.slice(F.filter(
        "near", lambda m: (m["neighbor"] != F.col("id")) | (m["side"] != F.col("side"))
    ), 1, k)
    listed = _to_rows(rows, answers).select("id", "side", F.posexplode(others).alias("_r", "_m"))
    return listed.select(
        F.col("id").alias(id),
        "side",
        (F.col("_r") + 1).alias("rank"),
        F.col("_m.neighbor").alias("neighbor"),
        F.col("_m.dist").alias("dist"),
        (F.col("_m.side") == F.col("side")).alias("same_side"),
    )


def _pooled(vectors: DataFrame, k: int) -> DataFrame:
    """k + 1 nearest members per vector, its own included at distance 0."""
    return nearest_vectors(vectors, vectors, k + 1, skip_self=False)


def dcr_nearest(pair: DataFrame, id: str, vector: str = "z") -> DataFrame:
    """``(id, neighbor, dist)``: the real record closest to every synthetic one."""
    rows = _rows(pair, id, vector)
    pool = materialize(distinct_vectors(rows.where(F.col("side") == "real"), 1))
    synth = rows.where(F.col("side") == "synth")
    queries = materialize(distinct_vectors(synth, 1))
    found = nearest_vectors(queries, pool, 1, skip_self=False)
    answers = queries.select("vec", "z").join(found, F.col("vec") == F.col("query")).select(
        "z", F.get("near", F.lit(0)).alias("_m")
    )
    return _to_rows(synth, answers).select(
        F.col("id").alias(id), F.col("_m.neighbor").alias("neighbor"), F.col("_m.dist").alias("dist")
    )


def dcr_leave_one_out(pair: DataFrame, id: str, vector: str = "z") -> DataFrame:
    """``(id, neighbor, dist)``: the other real record closest to every real one."""
    real = pair.where(F.col("side") == "real")
    return knn_pooled(real, id, 1, vector).select(id, "neighbor", "dist")


def snn_scores(vectors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(snn_real, snn_synth, snn_mean, deviation, k, n_real, n_synth)``.

    Computed on distinct vectors: rows of one vector and side share their votes,
    except the few that stand in the neighbour list themselves.
    """
    near = vectors.select("vec", "n_real", "n_synth").join(found, F.col("vec") == F.col("query"))
    share = lambda list_, side: F.aggregate(
        list_, F.lit(0.0), lambda t, m: t + F.when(m["side"] != side, 1.0).otherwise(0.0)
    ) / F.greatest(F.size(list_), F.lit(1))

    def hits(side: str, count: str) -> Column:
        # list members at distance 0 are this vector's own rows
        own = F.filter("near", lambda m: (m["dist"] == 0) & (m["side"] == side))
        first = F.slice("near", 1, k)
        listed = F.aggregate(
            own,
            F.lit(0.0),
            lambda t, o: t
            + share(
                F.slice(
                    F.filter("near", lambda m: (m["neighbor"] != o["neighbor"]) | (m["side"] != side)), 1, k
                ),
                F.lit(side),
            ),
        )
        return listed + (F.col(count) - F.size(own)) * share(first, F.lit(side))

    total = near.agg(
        F.sum(hits("real", "n_real")).alias("_r"),
        F.sum(hits("synth", "n_synth")).alias("_s"),
        F.coalesce(F.sum("n_real"), F.lit(0)).alias("n_real"),
        F.coalesce(F.sum("n_synth"), F.lit(0)).alias("n_synth"),
    )
    real = F.coalesce(F.col("_r"), F.lit(0.0)) / F.greatest("n_real", F.lit(1))
    synth = F.coalesce(F.col("_s"), F.lit(0.0)) / F.greatest("n_synth", F.lit(1))
    scored = total.select(real.alias("snn_real"), synth.alias("snn_synth"), "n_real", "n_synth")
    mean = (F.col("snn_real") + F.col("snn_synth")) / 2
    return scored.select(
        "snn_real", "snn_synth", mean.alias("snn_mean"), F.abs(mean - 0.5).alias("deviation"),
        F.lit(k).alias("k"), "n_real", "n_synth",
    )


def snn_of_vectors(pair: DataFrame, id: str, k: int = 5, vector: str = "z") -> DataFrame:
    vectors = materialize(distinct_vectors(_rows(pair, id, vector), k + 1))
    return snn_scores(vectors, _pooled(vectors, k), k)


def dcr_of_vectors(pair: DataFrame, id: str, vector: str = "z") -> DataFrame:
    """Distances to the closest real record, as one row.

    Also on distinct vectors, weighted by their rows; a real vector with copies is
    at distance 0 from another real record.
    """
    rows = _rows(pair, id, vector)
    vectors = materialize(distinct_vectors(rows, 1))
    real = materialize(distinct_vectors(rows.where(F.col("side") == "real"), 1))
    single = real.where(F.col("n_real") == 1)
    nearest = lambda found: F.get("near", F.lit(0))["dist"]

    synth = vectors.where(F.col("n_synth") > 0)
    to_real = synth.join(
        nearest_vectors(synth, real, 1, False), F.col("vec") == F.col("query")
    ).select(F.lit("synth").alias("column"), nearest(None).alias("value"), F.col("n_synth").alias("n"))
    among = single.join(
        nearest_vectors(single, real, 1, True), F.col("vec") == F.col("query")
    ).select(F.lit("real").alias("column"), nearest(None).alias("value"), F.lit(1).cast("long").alias("n"))
    copies = real.where(F.col("n_real") > 1).select(
        F.lit("real").alias("column"), F.lit(0.0).alias("value"), F.col("n_real").alias("n")
    )
    distances = materialize(to_real.unionByName(among).unionByName(copies))
    at = exact_quantiles(distances, [0.05, 0.5])
    pick = lambda column, p: F.max(
        F.when((F.col("column") == column) & (F.col("p") == p), F.col("value"))
    )
    quantiles = at.agg(
        F.struct(
            pick("synth", 0.5).alias("median"),
            pick("synth", 0.05).alias("fifth"),
            pick("real", 0.5).alias("base"),
        )
    )
    side = lambda s: F.coalesce(
        F.sum(F.when(F.col("column") == s, F.col("n"))), F.lit(0)
    )
    weighted = F.sum(F.when(F.col("column") == "synth", F.col("value") * F.col("n")))
    total = distances.agg(
        F.try_divide(weighted, side("synth")).alias("_mean"),
        side("real").alias("n_real"),
        side("synth").alias("n_synth"),
    ).withColumn("_q", quantiles.scalar())
    base, median = F.col("_q.base"), F.col("_q.median")
    return total.select(
        median.alias("dcr_synth_to_real_median"),
        F.col("_q.fifth").alias("dcr_synth_to_real_5th"),
        F.col("_mean").alias("dcr_synth_to_real_mean"),
        base.alias("dcr_real_to_real_median"),
        F.when(base > 0, median / F.nullif(base, F.lit(0.0)))
        .when(base.isNotNull() & median.isNotNull(), F.lit(float("inf")))
        .alias("dcr_ratio"),
        "n_real",
        "n_synth",
    )


def _encoded(pair, id, numeric, categorical, subsample, seed) -> DataFrame:
    if subsample is not None:
        pair = sample_sides(pair, [id], subsample, seed)
    return materialize(encode_mixed(materialize(pair), [id], numeric, categorical))


def snn(
    pair: DataFrame, id: str, numeric: Sequence[str], categorical: Sequence[str],
    k: int = 5, subsample: int | None = None, seed: int = 42,
) -> DataFrame:
    """Share of a record's k nearest that come from the other side; 1/2 is perfect mixing.

    All rows are compared unless the caller asks for ``subsample`` rows per side.
    """
    return snn_of_vectors(_encoded(pair, id, numeric, categorical, subsample, seed), id, k)


def dcr(
    pair: DataFrame, id: str, numeric: Sequence[str], categorical: Sequence[str],
    subsample: int | None = None, seed: int = 42,
) -> DataFrame:
    """Distance from synthetic records to their closest real record."""
    return dcr_of_vectors(_encoded(pair, id, numeric, categorical, subsample, seed), id)


def inter_record(
    pair: DataFrame, id: str, numeric: Sequence[str], categorical: Sequence[str],
    k: int = 5, subsample: int | None = None, seed: int = 42,
) -> DataFrame:
    """Both record-level metrics as long ``(family, metric, value)`` rows, encoded once."""
    encoded = _encoded(pair, id, numeric, categorical, subsample, seed)
    parts = []
    for family, scores in (("snn", snn_of_vectors(encoded, id, k)), ("dcr", dcr_of_vectors(encoded, id))):
        cast = scores.select(*[F.col(c).cast("double").alias(c) for c in scores.columns])
        parts.append(
            cast.unpivot([], scores.columns, "metric", "value").select(
                F.lit(family).alias("family"), "metric", "value"
            )
        )
    return parts[0].unionByName(parts[1])
