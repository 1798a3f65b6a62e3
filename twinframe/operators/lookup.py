"""Left dictionary joins: broadcast when measured small, otherwise one shuffle without hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Values counted as hot at most, the rows per value that a hot one exceeds (as a share), and the sketch's entries.
HOT = 256
HOT_SHARE = 1 / 1024
SKETCH = 16_384


def _name(value: Column) -> Column:
    return F.xxhash64(value)


def hot_values(rows: DataFrame, value: str) -> list[int]:
    """Hashes of the values that hold more than ``HOT_SHARE`` of the rows, at most ``HOT``.

    A mergeable sketch per task finds them in one pass; no value is shuffled.  A null
    value counts as one.
    """
    named = rows.select(_name(F.col(f"`{value}`")).alias("_value"))
    top = F.expr(f"approx_top_k(_value, {HOT}, {SKETCH})").alias("top")
    found = named.agg(top, F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] > HOT_SHARE * found["n"]]


def hot_entries(dictionary: DataFrame, entry: str, counts: str) -> list[int]:
    """The same from the counts a dictionary was fitted with, where the rows cannot be looked at first."""
    total = dictionary.agg(F.sum(counts)).first()[0] or 0
    top = dictionary.where(F.col(counts) > HOT_SHARE * total).orderBy(F.desc(counts)).limit(HOT)
    return [r[0] for r in top.select(_name(F.col(f"`{entry}`"))).collect()]


def lookup(
    rows: DataFrame,
    dictionary: DataFrame,
    value: str,
    entry: str,
    keep: Sequence[str],
    small: bool,
    counts: str | None = None,
) -> DataFrame:
    """Add ``keep`` columns of the dictionary row whose ``entry`` equals ``value``.

    ``entry`` is unique in the dictionary; null matches null.  ``small`` says that
    the dictionary was measured (``session.fits_broadcast``, ``groups_that_fit``) and is
    broadcast.  Otherwise the rows are shuffled once by their value.  Values that hold
    a large share of the rows, in the dictionary or not, are measured first; their few
    entries are broadcast and their rows spread evenly.  A stream cannot be measured:
    there the ``counts`` column of the dictionary says what is hot.
    """
    side = dictionary.select(F.col(f"`{entry}`").alias("_entry"), *keep)
    match = F.col(f"`{value}`").eqNullSafe(F.col("_entry"))
    if small:
        return rows.join(F.broadcast(side), match, "left").drop("_entry")
    if not rows.isStreaming:
        hot = hot_values(rows, value)
    else:
        hot = hot_entries(dictionary, entry, counts) if counts else []
    if not hot:
        return rows.join(side, match, "left").drop("_entry")
    is_hot = _name(F.col("_entry")).isin(hot)
    hot_side = side.where(is_hot).select(F.col("_entry").alias("_hot_entry"), *[F.col(c).alias(f"_hot_{c}") for c in keep])
    cold_side = side.where(~is_hot).withColumn("_cold", _name(F.col("_entry")))
    # the rows of a hot value take a key of their own each, which no entry has
    anywhere = F.xxhash64(F.rand(7), F.lit("hot"))
    named = rows.withColumn("_is_hot", _name(F.col(f"`{value}`")).isin(hot)).withColumn(
        "_turn", F.when(F.col("_is_hot"), anywhere).otherwise(_name(F.col(f"`{value}`")))
    )
    warm = named.join(F.broadcast(hot_side), F.col(f"`{value}`").eqNullSafe(F.col("_hot_entry")) & F.col("_is_hot"), "left")
    cold = (F.col("_turn") == F.col("_cold")) & match & ~F.col("_is_hot")
    joined = warm.join(cold_side, cold, "left")
    return joined.withColumns({c: F.when(F.col("_is_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)) for c in keep}).drop(
        "_entry", "_cold", "_turn", "_is_hot", "_hot_entry", *[f"_hot_{c}" for c in keep]
    )
