"""One-pass column profiles: bounds, levels, frequencies, completeness, domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinframe.functions.normal import with_probit
from twinframe.functions.scalars import clip, missing, present
from twinframe.operators.cumulative import running_totals


def long_numeric(rows: DataFrame, numeric: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to ``(keep..., column, value double)``."""
    cast = rows.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
    return cast.unpivot(list(keep), [F.col(f"`{c}`") for c in numeric], "column", "value")


def long_levels(rows: DataFrame, categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot categorical columns to ``(keep..., column, level string)``."""
    cast = rows.select(*keep, *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical])
    return cast.unpivot(list(keep), [F.col(f"`{c}`") for c in categorical], "column", "level")


def _inline(entries: Sequence[Column]) -> Column:
    return F.inline(F.array(*entries))


def numeric_bounds(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(column, minimum, maximum) in one pass, without unpivoting the rows."""
    flat = rows.agg(
        *[f(F.when(present(v), v)).alias(f"_{p}{i}")
          for i, c in enumerate(numeric)
          for v in [F.col(f"`{c}`").cast("double")]
          for p, f in (("lo", F.min), ("hi", F.max))]
    )
    return flat.select(
        _inline(
            [F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").alias("minimum"),
                      F.col(f"_hi{i}").alias("maximum")) for i, c in enumerate(numeric)]
        )
    )


def completeness(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_missing) counting null, NaN and infinite values."""
    names = [*numeric, *categorical]
    flat = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(c, c in numeric)).alias(f"_m{i}") for i, c in enumerate(names)],
    )
    return flat.select(
        _inline(
            [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"),
                      F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(names)]
        )
    )


def level_counts(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, level, n); null is a level."""
    return long_levels(rows, categorical).groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n")
    )


def category_freq(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, level, n, freq).  Every column has one value per row, so one total serves all."""
    total = rows.agg(F.count(F.lit(1)))
    return (
        level_counts(rows, categorical)
        .withColumn("_total", total.scalar())
        .select("column", "level", "n", (F.col("n") / F.col("_total")).alias("freq"))
    )


def index_levels(counts: DataFrame) -> DataFrame:
    """Number levels 0.. by text order and add where each lies in cumulative frequency.

    Takes ``(column, level, n)``; returns also ``idx``, ``k`` (levels of the
    column), ``below`` (rows of lower levels) and ``total``.
    """
    ones = counts.withColumns(
        # null sorts first, so that it is a level like any other
        {"one": F.lit(1).cast("long"), "_order": F.struct(F.col("level"))}
    )
    ranked = running_totals(ones, ["column"], "_order", ["one", "n"])
    return ranked.select(
        "column",
        "level",
        "n",
        (F.col("cum_one") - 1).alias("idx"),
        F.col("total_one").alias("k"),
        (F.col("cum_n") - F.col("n")).alias("below"),
        F.col("total_n").alias("total"),
    )


def category_levels(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Level dictionary: index by text order and the normal quantile at its centre."""
    indexed = index_levels(level_counts(rows, categorical))
    middle = indexed.withColumn("_p", (F.col("idx") + 0.5) / F.col("k"))
    return with_probit(middle, {"center": "_p"}).drop("_p")


def decode_table(levels: DataFrame) -> DataFrame:
    """Per column the ascending ``(center, level)`` entries, as a row order of the dictionary.

    ``entry`` counts from 0; kept as rows because a dictionary may be large.
    """
    return levels.select("column", F.col("idx").alias("entry"), "center", "level")


def out_of_domain(rows: DataFrame, levels: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, level, n) for levels absent from the dictionary.

    Rows are reduced to counted levels first, so a hot level costs one row.
    """
    seen = level_counts(rows, categorical)
    known = levels.select("column", F.col("level").alias("_level"))
    match = (seen["column"] == known["column"]) & seen["level"].eqNullSafe(known["_level"])
    return seen.join(known, match, "left_anti")


def clip_columns(rows: DataFrame, bounds: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Limit every numeric column to its (minimum, maximum) row in ``bounds``."""
    table = bounds.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("minimum", "maximum"))))
    )
    limited = rows.withColumn("_bounds", table.scalar())
    return limited.withColumns(
        {
            c: F.when(
                F.col(f"`{c}`").isNotNull(),
                clip(F.col(f"`{c}`").cast("double"), F.col("_bounds")[c]["minimum"],
                     F.col("_bounds")[c]["maximum"]),
            )
            for c in numeric
        }
    ).drop("_bounds")


def head_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of an explicit order (tables have none of their own)."""
    return rows.orderBy(*order).limit(n)


def train_summary(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(measure, column, value): rows, width, and levels per categorical column."""
    counts = level_counts(rows, categorical)
    size = rows.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("rows").alias("measure"), F.lit("").alias("column"), "value"
    )
    width = size.select(
        F.lit("columns").alias("measure"),
        "column",
        F.lit(len(numeric) + len(categorical)).cast("long").alias("value"),
    )
    levels = counts.groupBy("column").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("levels").alias("measure"), "column", "value"
    )
    return size.unionByName(width).unionByName(levels)
