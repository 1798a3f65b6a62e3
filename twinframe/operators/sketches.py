"""Approximate encoder state that is saved, and merged with later batches.

Of every numeric column a quantile sketch (KLL) is kept, of every categorical one
its counted levels.  Sketches are filled task by task and merged, so what is
shuffled is one sketch per task and column.  The grid they give is approximate;
:func:`rank_errors` measures by how much.  Level counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinframe.functions.normal import normal_quantile, with_probit
from twinframe.functions.scalars import count_not_above, present
from twinframe.operators.encoder import EDGE, LATENT_LIMIT, POINTS, EncoderState, constant_array
from twinframe.operators.profile import index_levels, level_counts, long_numeric
from twinframe.session import materialize

#: Size parameter of a sketch (about 30 KB), and the rank error it keeps to with high probability.
SIZE = 2000
RANK_ERROR = 0.005


@dataclass(frozen=True)
class EncoderSketch:
    """``quantiles`` (column, sketch) and ``levels`` (column, level, n) of all batches so far."""

    numeric: list[str]
    categorical: list[str]
    quantiles: DataFrame
    levels: DataFrame

    def merged(self, other: EncoderSketch) -> EncoderSketch:
        """The sketch of both tables; neither is read again."""
        both = self.quantiles.unionByName(other.quantiles).groupBy("column")
        counts = self.levels.unionByName(other.levels).groupBy("column", "level")
        return EncoderSketch(
            self.numeric, self.categorical,
            materialize(both.agg(F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"))),
            materialize(counts.agg(F.sum("n").alias("n"))),
        )

    def save(self, path: str) -> None:
        spark = self.quantiles.sparkSession
        names = [(i, c, c in self.numeric) for i, c in enumerate([*self.numeric, *self.categorical])]
        columns = spark.createDataFrame(names, "position int, column string, numeric boolean")
        for name, frame in (("columns", columns), ("quantiles", self.quantiles), ("levels", self.levels)):
            frame.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncoderSketch:
        columns = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        return cls(
            [r["column"] for r in columns if r["numeric"]], [r["column"] for r in columns if not r["numeric"]],
            *[spark.read.parquet(f"{path}/{name}") for name in ("quantiles", "levels")],
        )

    def grid(self, points: int = POINTS) -> DataFrame:
        """(column, value, p_min, p_max) as ``cumulative.quantile_grid``, of approximate quantiles."""
        n = F.kll_sketch_get_n_double("sketch")
        cells = F.greatest(F.least(n, F.lit(points)) - 1, F.lit(1))
        sized = self.quantiles.where(n > 0).withColumn("_cells", cells)
        # ranks must be constants of the plan: columns under ``points`` rows have their own
        quantiles = F.lit(None).cast("array<double>")
        for row in sized.select("_cells").distinct().collect():
            ranks = constant_array(np.arange(row[0] + 1) / row[0])
            found = F.kll_sketch_get_quantile_double("sketch", ranks)
            quantiles = F.when(F.col("_cells") == row[0], found).otherwise(quantiles)
        found = sized.select("column", "_cells", F.posexplode(quantiles))
        return found.groupBy("column", F.col("col").alias("value")).agg(
            (F.min("pos") / F.max("_cells")).alias("p_min"), (F.max("pos") / F.max("_cells")).alias("p_max")
        )

    def state(self, points: int = POINTS, order: Sequence[str] | None = None) -> EncoderState:
        """Encoder state of the sketch; the moments of the scores are those of the grid."""
        grid = materialize(self.grid(points))
        indexed = index_levels(self.levels).withColumn("_p", (F.col("idx") + 0.5) / F.col("k"))
        levels = materialize(with_probit(indexed, {"center": "_p"}).drop("_p"))
        bare = EncoderState(self.numeric, self.categorical, grid, grid, levels, list(order or [*self.numeric, *self.categorical]))
        schema = "column string, mean double, scale double, minimum double, maximum double"
        stats = grid.sparkSession.createDataFrame([(c, *_moments(bare.grids.get(c))) for c in self.numeric], schema)
        return EncoderState(self.numeric, self.categorical, grid, stats, levels, bare.order)


def _moments(grid) -> tuple:
    """Mean and deviation of the clipped scores over a grid's references, and the ends; a grid has at most ``points``."""
    if grid is None:
        return 0.0, 1.0, None, None
    values, low, high = grid
    p = (low + high) / 2
    p = np.where(values > values[-1] - EDGE, 1.0, p)
    p = np.where(values < values[0] + EDGE, 0.0, p)
    z = np.clip(normal_quantile(np.clip(p, EDGE, 1 - EDGE)), -LATENT_LIMIT, LATENT_LIMIT)
    gaps = low[1:] - high[:-1]
    share = high - low + (gaps.min() if len(gaps) else 1.0)
    mean = float(np.average(z, weights=share))
    scale = float(np.sqrt(np.average((z - mean) ** 2, weights=share)))
    return mean, scale or 1.0, float(values[0]), float(values[-1])


def sketch_encoder(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> EncoderSketch:
    """Sketch of one batch: one pass for all numbers and one for all levels.  Null and NaN numbers are left out."""
    spark, numeric, categorical = rows.sparkSession, list(numeric), list(categorical)
    quantiles = spark.createDataFrame([], "column string, sketch binary")
    levels = spark.createDataFrame([], "column string, level string, n long")
    if numeric:
        long = long_numeric(rows, numeric).where(present(F.col("value")))
        quantiles = materialize(long.groupBy("column").agg(F.kll_sketch_agg_double("value", F.lit(SIZE)).alias("sketch")))
    if categorical:
        levels = materialize(level_counts(rows, categorical).select("column", "level", "n"))
    return EncoderSketch(numeric, categorical, quantiles, levels)


def rank_errors(rows: DataFrame, numeric: Sequence[str], grid: DataFrame, points: int = POINTS) -> DataFrame:
    """(column, n_rows, rank_error): how far a grid's probabilities lie from the true ranks of its values, at most.

    Rows are counted between the grid's values, exactly.  An entry is right if its span
    of probabilities lies between the shares of rows below it and not above it.
    """
    arrays = grid.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("_values"))
    long = long_numeric(rows, numeric).where(present(F.col("value")))
    # one array of at most ``points`` numbers per column
    placed = long.join(F.broadcast(arrays), "column").withColumn("at", count_not_above(F.col("_values"), F.col("value"), points))
    counted = placed.groupBy("column", "at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.get("_values", F.col("at") - 1) == F.col("value")).alias("ties")
    )
    entries = grid.withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    order = Window.partitionBy("column").orderBy("at")
    whole = Window.partitionBy("column")
    # entries without rows, and rows under the first entry, have a line of their own
    lined = counted.join(entries, ["column", "at"], "full").fillna(0, ["n", "ties"])
    swept = lined.withColumn("total", F.sum("n").over(whole)).withColumn("below", F.sum("n").over(order) - F.col("n"))
    over = F.col("p_max") - (F.col("below") + F.col("ties")) / F.col("total")
    under = F.col("below") / F.col("total") - F.col("p_min")
    return swept.groupBy("column").agg(
        F.max("total").alias("n_rows"), F.greatest(F.max(over), F.max(under), F.lit(0.0)).alias("rank_error")
    )
