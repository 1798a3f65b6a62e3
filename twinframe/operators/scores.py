"""Model scores as aggregations over counted cells, optionally per ``by`` group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from twinframe.operators.cumulative import running_totals


def classification_metrics(
    rows: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., accuracy, macro_f1)``; the F1 mean is unweighted over classes."""
    cells = rows.groupBy(*by, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("_y").alias("c"), F.col("_n").alias("actual"), none.alias("predicted"),
                 hit.cast("long").alias("hit")),
        F.struct(F.col("_p").alias("c"), none.alias("actual"), F.col("_n").alias("predicted"),
                 none.alias("hit")),
    )
    classes = (
        cells.select(*by, F.inline(roles))
        .groupBy(*by, "c")
        .agg(*[F.sum(x).alias(x) for x in ("actual", "predicted", "hit")])
    )
    f1 = 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))
    return classes.groupBy(*by).agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("macro_f1")
    )


def roc_auc(
    rows: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., auc)`` with ties at half weight; null when one class is absent."""
    key = list(by) or ["_all"]
    keyed = rows if by else rows.withColumn("_all", F.lit(0))
    counts = keyed.groupBy(*key, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    ranked = running_totals(counts, key, "_score", ["pos", "neg"])
    below = (F.col("cum_neg") - F.col("neg")) + F.col("neg") / F.lit(2.0)
    wins = F.sum(F.col("pos") * below)
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    scored = ranked.groupBy(*key).agg(F.try_divide(wins, pairs).alias("auc"))
    return scored if by else scored.drop("_all")


def regression_metrics(
    rows: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., rmse, r2)`` in one pass; r2 is null when y is constant."""
    actual, error = F.col(y).cast("double"), F.col(y) - F.col(yhat)
    mse = F.avg(error * error)
    return rows.groupBy(*by).agg(
        F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(mse, F.nullif(F.var_pop(actual), F.lit(0.0)))).alias("r2"),
    )


def seed_summary(scores: DataFrame, keys: Sequence[str] = ("method", "metric")) -> DataFrame:
    """Mean and population deviation of per-seed ``value`` rows."""
    return scores.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def long_scores(scores: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One ``(keep..., metric, value)`` row per metric column."""
    return scores.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keep), list(metrics), "metric", "value"
    )
