"""Table <-> latent vector maps, fitted once and applied row by row.

Numerics go through their quantile grid to a normal score; categories sit at
normal quantiles of their text-order index.  Two modes:

``centers``
    every level, and every tied value, maps to one point; numerics are
    standardised afterwards.
``cells``
    a level is spread over its own share of the probability scale and a tied
    value over its share of the grid (distributional transform), so that the
    latent columns are truly normal.  A generator with smooth densities needs it.

The fitted state is three tables.  The grid is bounded by ``points`` per column
and travels with the tasks; the level dictionary may be large and is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from twinframe.functions.normal import (
    normal_probabilities,
    normal_quantile,
    with_normal_cdf,
    with_probit,
)
from twinframe.functions.scalars import clip, count_not_above, hash_key, hash_uniform, round_half_even
from twinframe.operators.cumulative import quantile_grid
from twinframe.operators.lookup import lookup
from twinframe.operators.profile import category_levels, long_numeric
from twinframe.session import groups_that_fit, materialize

POINTS = 2000
LATENT_LIMIT = 4.5

#: Probabilities this close to an end of the training range count as the end itself.
EDGE = 1e-7

#: Slices of the probability scale by which level cells are found when decoding: one per level, at least these.
SLICES = 256


@dataclass(frozen=True)
class EncoderState:
    numeric: list[str]
    categorical: list[str]
    grid: DataFrame
    stats: DataFrame
    levels: DataFrame
    order: list[str] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.categorical)

    @cached_property
    def grids(self) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(values, p_min, p_max) per numeric column; at most ``points`` entries each."""
        frame = self.grid.select("column", "value", "p_min", "p_max").toPandas()
        frame = frame.sort_values(["column", "value"])
        return {
            c: tuple(part[x].to_numpy(float) for x in ("value", "p_min", "p_max"))
            for c, part in frame.groupby("column")
        }

    @cached_property
    def moments(self) -> dict[str, tuple[float, float]]:
        return {r["column"]: (r["mean"], r["scale"]) for r in self.stats.collect()}

    @cached_property
    def level_sizes(self) -> dict[str, int]:
        """Number of levels per categorical column."""
        sizes = self.levels.groupBy("column").agg(F.max("k").alias("k")).collect()
        return {r["column"]: r["k"] for r in sizes}

    @cached_property
    def small_levels(self) -> dict[str, bool]:
        """Per categorical column: may its levels be broadcast?"""
        return groups_that_fit(self.levels, "column")

    def small(self, column: str) -> bool:
        # a column without levels has nothing to send
        return self.small_levels.get(column, True)

    def entries(self, column: str, *names) -> DataFrame:
        return self.levels.where(F.col("column") == column).select(
            F.col("level").alias("_level"), *names
        )

    def neighbours(self, column: str) -> DataFrame:
        """Every level with its centre, and the level and centre that follow."""
        here = self.levels.where(F.col("column") == column).select("idx", "level", "center")
        there = here.select(
            (F.col("idx") - 1).alias("idx"),
            F.col("level").alias("_next_level"),
            F.col("center").alias("_next_center"),
        )
        named = here.withColumnsRenamed({"level": "_level", "center": "_center"})
        return named.join(there, "idx", "left")

    def save(self, path: str) -> None:
        spark = self.grid.sparkSession
        kinds = [(i, c, c in self.numeric) for i, c in enumerate(self.order)]
        spark.createDataFrame(kinds, "position int, column string, numeric boolean").write.mode(
            "overwrite"
        ).parquet(f"{path}/columns")
        for name in ("grid", "stats", "levels"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncoderState:
        columns = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        return cls(
            [r["column"] for r in columns if r["numeric"]],
            [r["column"] for r in columns if not r["numeric"]],
            *[spark.read.parquet(f"{path}/{name}") for name in ("grid", "stats", "levels")],
            [r["column"] for r in columns],
        )


def fit_encoder(
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    points: int = POINTS,
    order: Sequence[str] | None = None,
) -> EncoderState:
    """Two passes: grid and levels, then the moments of the clipped scores."""
    numeric, categorical = list(numeric), list(categorical)
    order = list(order or [*numeric, *categorical])
    spark = rows.sparkSession
    if numeric:
        grid = materialize(quantile_grid(long_numeric(rows, numeric), points))
    else:
        grid = spark.createDataFrame([], "column string, value double, p_min double, p_max double")
    if categorical:
        levels = materialize(category_levels(rows, categorical))
    else:
        levels = spark.createDataFrame(
            [], "column string, level string, n long, idx long, k long, below long, total long, "
            "center double")
    bare = EncoderState(numeric, categorical, grid, grid, levels, order)
    return EncoderState(numeric, categorical, grid, _fit_stats(rows, bare), levels, order)


def _fit_stats(rows: DataFrame, state: EncoderState) -> DataFrame:
    """(column, mean, scale, minimum, maximum); the grid ends are the data bounds."""
    schema = "column string, mean double, scale double, minimum double, maximum double"
    found = []
    if state.numeric:
        scored = _with_scores(rows.select(*[f"`{c}`" for c in state.numeric]), state)
        names = [f"_s{i}" for i in range(len(state.numeric))]
        flat = scored.agg(*[f(s) for s in names for f in (F.avg, F.stddev_pop)]).first()
        for i, c in enumerate(state.numeric):
            ends = state.grids[c][0] if c in state.grids else [None]
            low, high = (None if e is None else float(e) for e in (ends[0], ends[-1]))
            found.append((c, flat[2 * i] or 0.0, flat[2 * i + 1] or 1.0, low, high))
    return rows.sparkSession.createDataFrame(found, schema)


def _struct_of(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"v{i}", T.DoubleType()) for i in range(n)])


def _grid_probability(x: np.ndarray, grid, weight) -> np.ndarray:
    """Position of values on a collapsed grid; a tied value takes ``weight`` of its span."""
    values, low, high = grid
    at = np.clip(np.searchsorted(values, x, side="right") - 1, 0, len(values) - 1)
    following = np.minimum(at + 1, len(values) - 1)
    gap = values[following] - values[at]
    part = np.clip((x - values[at]) / np.where(gap > 0, gap, 1.0), 0.0, 1.0)
    between = high[at] + part * (low[following] - high[at])
    return np.where(x == values[at], low[at] + weight * (high[at] - low[at]), between)


def _score_udf(grids: list, spread: bool):
    """Struct of values (and uniforms) -> struct of clipped normal scores, by Arrow batch."""

    @F.pandas_udf(_struct_of(len(grids)))
    def scores(frame: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for i, grid in enumerate(grids):
            x = frame[f"x{i}"].to_numpy(float)
            if grid is None:
                out[f"v{i}"] = np.full(len(x), np.nan)
                continue
            if spread:
                p = _grid_probability(x, grid, frame[f"u{i}"].to_numpy(float))
                edge = 0.5 / POINTS
            else:
                p, edge = _grid_probability(x, grid, 0.5), EDGE
                p = np.where(x > grid[0][-1] - EDGE, 1.0, p)
                p = np.where(x < grid[0][0] + EDGE, 0.0, p)
            z = normal_quantile(np.clip(p, edge, 1.0 - edge))
            out[f"v{i}"] = np.where(np.isnan(x), np.nan, np.clip(z, -LATENT_LIMIT, LATENT_LIMIT))
        return pd.DataFrame(out)

    return scores


def _with_scores(rows: DataFrame, state: EncoderState, seed=None, ids=()) -> DataFrame:
    """Add ``_s<i>``, the clipped normal score of every numeric column."""
    spread = seed is not None
    fields = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(state.numeric)]
    if spread:
        fields += [
            hash_uniform(hash_key(seed, [*ids, F.lit(c)])).alias(f"u{i}")
            for i, c in enumerate(state.numeric)
        ]
    find = _score_udf([state.grids.get(c) for c in state.numeric], spread)
    return rows.withColumn("_s", find(F.struct(*fields))).withColumns(
        {
            f"_s{i}": F.when(~F.isnan(v), v)
            for i in range(len(state.numeric))
            for v in [F.col(f"_s.v{i}")]
        }
    ).drop("_s")


def encode_numeric(rows: DataFrame, state: EncoderState) -> DataFrame:
    """Replace numeric columns by their standardised latent values."""
    if not state.numeric:
        return rows
    scored = _with_scores(rows, state)
    return scored.withColumns(
        {
            c: (F.col(f"_s{i}") - F.lit(state.moments[c][0])) / F.lit(state.moments[c][1])
            for i, c in enumerate(state.numeric)
        }
    ).drop(*[f"_s{i}" for i in range(len(state.numeric))])


def encode_categorical(rows: DataFrame, state: EncoderState) -> DataFrame:
    """Replace levels by their centre; an unseen level becomes null."""
    for c in state.categorical:
        text = rows.withColumn(c, F.col(f"`{c}`").cast("string"))
        found = lookup(text, state.entries(c, "center", "n"), c, "_level", ["center"], state.small(c), "n")
        rows = found.withColumn(c, F.col("center")).drop("center")
    return rows


def encode(
    rows: DataFrame,
    state: EncoderState,
    keep: Sequence[str] = (),
    mode: str = "centers",
    seed: int = 42,
    ids: Sequence[str] = (),
) -> DataFrame:
    """``(keep..., z)`` with numerics before categories.

    Row-wise over the fitted state, without an action on ``rows``; so it also
    serves a streaming DataFrame.  ``cells`` needs ``ids`` to draw its uniforms.
    """
    if mode == "centers":
        kept = rows.select(
            *[F.col(f"`{k}`").alias(f"_keep{i}") for i, k in enumerate(keep)],
            *[f"`{c}`" for c in (*state.numeric, *state.categorical)],
        )
        coded = encode_categorical(encode_numeric(kept, state), state)
        parts = [F.col(f"`{c}`") for c in (*state.numeric, *state.categorical)]
        return coded.select(
            *[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], F.array(*parts).alias("z")
        )
    if mode != "cells":
        raise ValueError(f"unknown mode {mode!r}")
    if not ids:
        raise ValueError("mode 'cells' needs row ids")
    scored = _with_scores(rows, state, seed, ids) if state.numeric else rows
    index = range(len(state.categorical))
    for i, c in enumerate(state.categorical):
        text = scored.withColumn("_text", F.col(f"`{c}`").cast("string"))
        entries = state.entries(c, "below", "n", "total")
        share = F.col("below") + hash_uniform(hash_key(seed, [*ids, F.lit(c)])) * F.col("n")
        scored = (
            lookup(text, entries, "_text", "_level", ["below", "n", "total"], state.small(c), "n")
            .withColumn(f"_q{i}", share / F.col("total"))
            .drop("below", "n", "total", "_text")
        )
    coded = with_probit(scored, {f"_c{i}": f"_q{i}" for i in index}) if index else scored
    parts = [F.col(f"_s{i}") for i in range(len(state.numeric))]
    parts += [clip(F.col(f"_c{i}"), -LATENT_LIMIT, LATENT_LIMIT) for i in index]
    return coded.select(*[f"`{k}`" for k in keep], F.array(*parts).alias("z"))


def constant_array(values: np.ndarray) -> Column:
    """A constant array<double>, read once by the optimizer from the shortest exact text of its entries."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _curves(state: EncoderState) -> list[dict]:
    """Per numeric column the ascending arrays value, p_min and p_max of its grid and the number of entries.

    They are constants of the plan: at most ``points`` entries per column, whatever the
    size of the table.  A column without numbers has one empty entry.
    """
    none = (np.array([np.nan]),) * 3
    grids = [state.grids.get(c, none) for c in state.numeric]
    names = ("value", "p_min", "p_max")
    return [
        {"size": len(grid[0]), "empty": bool(np.isnan(grid[0][0]))}
        | {name: constant_array(a) for name, a in zip(names, grid)}
        for grid in grids
    ]


def _rank(ordered: Column, x: Column, curve: dict) -> Column:
    """Number, from 0, of the last entry not above ``x``, or of the first; null on an empty grid."""
    if curve["empty"]:
        return F.lit(None).cast("int")
    return F.greatest(count_not_above(ordered, x, curve["size"]) - 1, F.lit(0))


def _grid_value(p: Column, at: Column, curve: dict) -> Column:
    """Value at a probability of a collapsed grid, ``at`` the entry whose span starts not above it."""
    value, end = F.get(curve["value"], at), F.get(curve["p_max"], at)
    above, start = F.get(curve["value"], at + 1), F.get(curve["p_min"], at + 1)
    between = (above - value) / (start - end) * (p - end) + value
    # up to its end the span is flat, and so is all that follows the last entry
    return F.when(p.isNotNull(), F.when((p <= end) | start.isNull(), value).otherwise(between))


def decode_numeric(rows: DataFrame, state: EncoderState, mode: str = "centers") -> DataFrame:
    """Add every numeric column, as a rounded long, from the array ``z``.

    Interpolation between references cannot leave the data bounds.
    """
    if not state.numeric:
        return rows
    curves, index = _curves(state), range(len(state.numeric))
    moments = [state.moments[c] if mode == "centers" else (0.0, 1.0) for c in state.numeric]
    raw = lambda i: F.get("z", F.lit(i)) * moments[i][1] + moments[i][0]
    score = lambda i: clip(F.when(~F.isnan(raw(i)), raw(i)), -LATENT_LIMIT, LATENT_LIMIT)
    placed = rows.withColumn("_p", F.array(*[score(i) for i in index])).withColumn("_p", normal_probabilities("_p"))
    found = placed.withColumns({f"_p{i}": F.get("_p", F.lit(i)) for i in index}).withColumns(
        {f"_at{i}": _rank(curves[i]["p_min"], F.col(f"_p{i}"), curves[i]) for i in index}
    )
    return found.withColumns(
        {c: round_half_even(_grid_value(F.col(f"_p{i}"), F.col(f"_at{i}"), curves[i])) for i, c in enumerate(state.numeric)}
    ).drop("_p", *[f"_{x}{i}" for i in index for x in ("p", "at")])


def _lower_center(rows: DataFrame, state: EncoderState) -> DataFrame:
    """Add ``_z<i>`` and ``_j<i>``, the level index whose centre and successor enclose it.

    Centres are normal quantiles of evenly spaced probabilities.  So the value's
    own probability names the two centres around it; no list of centres is
    searched.
    """
    offset, sizes = len(state.numeric), state.level_sizes
    index = range(len(state.categorical))
    k = {i: sizes.get(c, 1) for i, c in enumerate(state.categorical)}
    raw = rows.withColumns({f"_z{i}": F.get("z", F.lit(offset + i)) for i in index})
    placed = with_normal_cdf(raw, {f"_p{i}": f"_z{i}" for i in index})
    spot = lambda i: F.floor(F.col(f"_p{i}") * k[i] - 0.5)
    return placed.withColumns(
        {f"_j{i}": clip(spot(i), 0, max(k[i] - 2, 0)).cast("long") for i in index}
    ).drop(*[f"_p{i}" for i in index])


def decode_categorical(rows: DataFrame, state: EncoderState, mode: str = "centers") -> DataFrame:
    """Add every categorical column from the array ``z``."""
    if mode == "centers":
        rows = _lower_center(rows, state)
        for i, c in enumerate(state.categorical):
            found = lookup(
                rows, state.neighbours(c), f"_j{i}", "idx",
                ["_level", "_center", "_next_level", "_next_center"], state.small(c))
            # equal distances go to the lower centre
            nearer = F.abs(F.col(f"_z{i}") - F.col("_next_center")) < F.abs(
                F.col(f"_z{i}") - F.col("_center")
            )
            rows = found.withColumn(
                c, F.when(nearer, F.col("_next_level")).otherwise(F.col("_level"))
            ).drop(f"_z{i}", f"_j{i}", "_level", "_center", "_next_level", "_next_center")
        return rows
    offset, index = len(state.numeric), range(len(state.categorical))
    raw = rows.withColumns({f"_z{i}": F.get("z", F.lit(offset + i)) for i in index})
    rows = with_normal_cdf(raw, {f"_p{i}": f"_z{i}" for i in index})
    for i, c in enumerate(state.categorical):
        rows = _level_of_cell(rows, state, c, f"_p{i}")
    return rows.drop(*[f"_{x}{i}" for i in index for x in ("z", "p")])


def _level_of_cell(rows: DataFrame, state: EncoderState, column: str, p: str) -> DataFrame:
    """Range join of a probability to the level whose cumulative share holds it.

    Both sides are cut into slices of the probability scale, which makes it an
    equi-join; a frequent level spans many slices, so its rows spread out.  There are
    as many slices as levels, so all cells together make two rows a level at most
    (beside those of the fewest slices).
    """
    slices = max(SLICES, state.level_sizes.get(column, 0))
    slice_of = lambda x: F.least(F.floor(x * slices), F.lit(slices - 1))
    cells = (
        state.entries(column, "below", "n", "total")
        .withColumns(
            {
                "_from": F.col("below") / F.col("total"),
                "_to": F.when(F.col("below") + F.col("n") >= F.col("total"), 2.0).otherwise(
                    (F.col("below") + F.col("n")) / F.col("total")
                ),
            }
        )
        .select(
            F.col("_level").alias(column),
            "_from",
            "_to",
            F.explode(F.sequence(slice_of(F.col("_from")), slice_of(F.col("_to")))).alias("_slice"),
        )
    )
    if state.small(column):
        cells = F.broadcast(cells)
    inside = (F.col(p) >= F.col("_from")) & (F.col(p) < F.col("_to"))
    spread = rows.withColumn("_cut", slice_of(F.col(p)))
    joined = spread.join(cells, (F.col("_cut") == F.col("_slice")) & inside, "left")
    return joined.drop("_cut", "_slice", "_from", "_to")


def decode(
    rows: DataFrame, state: EncoderState, keep: Sequence[str] = (), mode: str = "centers"
) -> DataFrame:
    """``(keep..., columns in table order)`` from the latent array ``z``."""
    plain = rows.select(*[f"`{k}`" for k in keep], "z")
    decoded = decode_categorical(decode_numeric(plain, state, mode), state, mode)
    return decoded.select(*[f"`{c}`" for c in (*keep, *state.order)])


def roundtrip_error(rows: DataFrame, state: EncoderState, ids: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_changed, max_error) of decoding an encoded table.

    ``n_changed`` counts categories that differ and numerics off by more than the
    rounding.
    """
    original = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(state.order)]
    source = rows.select("*", *original)
    names = [f"_o{i}" for i in range(len(state.order))]
    back = decode(encode(source, state, [*ids, *names]), state, [*ids, *names])
    entries = []
    for i, c in enumerate(state.order):
        if c in state.numeric:
            error = F.abs(F.col(f"`{c}`") - F.col(f"_o{i}").cast("double"))
            entries.append((c, F.count_if(error > 0.5), F.max(error)))
        else:
            same = F.col(f"`{c}`").eqNullSafe(F.col(f"_o{i}").cast("string"))
            entries.append((c, F.count_if(~same), F.lit(None).cast("double")))
    flat = back.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[a.alias(f"_n{i}") for i, (_, a, _) in enumerate(entries)],
        *[F.first(F.lit(None).cast("double")).alias(f"_e{i}") if c not in state.numeric
          else e.alias(f"_e{i}") for i, (c, _, e) in enumerate(entries)],
    )
    return flat.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("_rows").alias("n_rows"),
                        F.col(f"_n{i}").alias("n_changed"),
                        F.col(f"_e{i}").alias("max_error"),
                    )
                    for i, (c, _, _) in enumerate(entries)
                ]
            )
        )
    )
