"""Marginal and correlation fidelity of a labelled real/synthetic pair.

Each metric is one pass over the union of both tables; no per-column jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from twinframe.operators.profile import long_levels, long_numeric
from twinframe.operators.ranges import widest_gaps

SERIES_TERMS = 100

#: Below this the Kolmogorov tail differs from 1 by less than 1e-11, and the series
#: no longer converges within SERIES_TERMS.
CERTAIN = 0.2


#: Product of the sizes up to which the p-value is counted exactly: a few thousand vector steps.
EXACT_CELLS = 4_000_000


def exact_ks_tail(gap: float, n: int, m: int) -> float:
    """Chance that two samples of one continuous distribution differ by ``gap`` or more.

    All orders of the n + m values are equally likely paths over an n x m lattice.
    The chance of staying where both shares differ by less than ``gap`` is carried
    from one anti-diagonal to the next; ``gap * n * m`` is a whole number, so the
    border is exact.
    """
    limit = round(gap * n * m)
    if limit <= 0:
        return 1.0
    n, m = min(n, m), max(n, m)
    taken = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for step in range(1, n + m + 1):
        left = n + m - step + 1
        # the last value was one of the n, or one of the m
        one = np.zeros(n + 1)
        one[1:] = inside[:-1] * (n - taken[:-1]) / left
        other = inside * np.maximum(m - (step - 1 - taken), 0) / left
        inside = one + other
        second = step - taken
        inside[(second < 0) | (second > m) | (np.abs(taken * m - second * n) >= limit)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(T.DoubleType())
def _exact_tail(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    # one row per column of the table, each of a small pair
    return pd.Series([exact_ks_tail(*row) for row in zip(gap, n.astype(int), m.astype(int))], dtype=float)


def _side_counts(suffix: str = "") -> dict:
    return {
        f"real{suffix}": F.count_if(F.col("side") == "real"),
        f"synth{suffix}": F.count_if(F.col("side") == "synth"),
    }


def ks_two_sample(pair: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``(column, ks_stat, p_value)``; null when a side has no values.

    The p-value is exact while the product of the sizes is at most ``EXACT_CELLS``,
    and the limit distribution's beyond.
    """
    is_side = {s: (F.col("side") == s) for s in ("real", "synth")}
    gaps = widest_gaps(long_numeric(pair, numeric, ["side"]), is_side)
    widest = gaps.select(
        "column", F.col("gap").alias("ks_stat"), F.col("real").cast("double").alias("_n"), F.col("synth").cast("double").alias("_m")
    )
    size = F.try_divide(F.col("_n") * F.col("_m"), F.col("_n") + F.col("_m"))
    scaled = widest.withColumn("_x", F.col("ks_stat") * F.sqrt(size))
    term = lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * F.col("_x") * F.col("_x"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)), F.lit(0.0), lambda total, k: total + term(k)
    )
    tail = F.when(F.col("_x") < CERTAIN, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))
    )
    limiting = scaled.select(
        "column", "ks_stat", "_n", "_m", F.when(F.col("_x").isNotNull(), tail).alias("p_value")
    )
    small = F.col("p_value").isNotNull() & (F.col("_n") * F.col("_m") <= EXACT_CELLS)
    exact = limiting.where(small).withColumn("p_value", _exact_tail("ks_stat", "_n", "_m"))
    return limiting.where(~small).unionByName(exact).drop("_n", "_m")


def tvd(pair: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """``(column, tvd)``, half the summed difference of level frequencies."""
    levels = long_levels(pair, categorical, ["side"]).groupBy("column", "level").agg(
        *[c.alias(name) for name, c in _side_counts().items()]
    )
    # every row has one value per column, so the side sizes serve all columns
    sizes = pair.agg(F.struct(*[c.alias(name) for name, c in _side_counts().items()]))
    gap = F.abs(
        F.try_divide(F.col("real"), F.col("_size.real"))
        - F.try_divide(F.col("synth"), F.col("_size.synth"))
    )
    return (
        levels.withColumn("_size", sizes.scalar())
        .groupBy("column")
        .agg((F.sum(gap) / 2).alias("tvd"))
    )


def corr_matrix(rows: DataFrame, numeric: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., row, col, r)`` for all ordered pairs, from pairwise-present rows.

    One aggregation of pairwise moments.  A constant column has r = 0 everywhere,
    its diagonal included.
    """
    clean = rows.select(
        *by,
        *[F.when(~F.isnan(v), v).alias(f"_x{i}")
          for i, c in enumerate(numeric) for v in [F.col(f"`{c}`").cast("double")]],
    )
    index = range(len(numeric))
    pairs = [(i, j) for i in index for j in index if i < j]
    sd = lambda i, j: F.stddev_pop(F.when(F.col(f"_x{j}").isNotNull(), F.col(f"_x{i}")))
    moments = clean.groupBy(*by).agg(
        *[F.stddev_pop(f"_x{i}").alias(f"_d{i}") for i in index],
        *[F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_c{i}_{j}") for i, j in pairs],
        *[sd(i, j).alias(f"_s{i}_{j}") for i, j in pairs],
        *[sd(j, i).alias(f"_s{j}_{i}") for i, j in pairs],
    )

    def entry(i: int, j: int):
        a, b = min(i, j), max(i, j)
        if i == j:
            r = F.when(F.col(f"_d{i}") > 0, 1.0).otherwise(0.0)
        else:
            spread = F.col(f"_s{a}_{b}") * F.col(f"_s{b}_{a}")
            r = F.when(spread > 0, F.col(f"_c{a}_{b}") / spread).otherwise(0.0)
        return F.struct(F.lit(numeric[i]).alias("row"), F.lit(numeric[j]).alias("col"), r.alias("r"))

    return moments.select(*by, F.inline(F.array(*[entry(i, j) for i in index for j in index])))


def corr_frobenius(pair: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``(corr_frobenius)``, the norm of the difference of both correlation matrices."""
    sides = corr_matrix(pair, numeric, ["side"]).groupBy("row", "col").agg(
        F.max(F.when(F.col("side") == "real", F.col("r"))).alias("_r"),
        F.max(F.when(F.col("side") == "synth", F.col("r"))).alias("_s"),
    )
    gap = F.col("_r") - F.col("_s")
    return sides.agg(F.sqrt(F.sum(gap * gap)).alias("corr_frobenius"))


def fidelity_summary(
    pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str], method: str = "ours"
) -> DataFrame:
    """Long ``(method, metric, column, value)`` rows.

    Values have four decimals; the averages are taken over the rounded values.
    """
    per_column = (
        ks_two_sample(pair, numeric)
        .select(F.lit("ks").alias("metric"), "column", F.round("ks_stat", 4).alias("value"))
        .unionByName(
            tvd(pair, categorical).select(
                F.lit("tvd").alias("metric"), "column", F.round("tvd", 4).alias("value")
            )
        )
    )
    # grouping sets give the column rows and their averages from one computation;
    # averaging whole ten-thousandths makes ties exact, and these round up
    units = F.round(F.avg(F.round(F.col("value") * 10000)))
    rolled = per_column.rollup("metric", "column").agg(
        (units / 10000).alias("value"), F.grouping_id().alias("_level")
    )
    averages = rolled.where("_level < 2").select(
        F.when(F.col("_level") == 1, F.concat(F.lit("avg_"), "metric")).otherwise(F.col("metric"))
        .alias("metric"),
        F.coalesce("column", F.lit("")).alias("column"),
        "value",
    )
    matrix = corr_frobenius(pair, numeric).select(
        F.lit("corr_frobenius").alias("metric"),
        F.lit("").alias("column"),
        F.round("corr_frobenius", 4).alias("value"),
    )
    return averages.unionByName(matrix).select(F.lit(method).alias("method"), "*")
