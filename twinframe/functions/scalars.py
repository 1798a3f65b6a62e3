"""Clipping, rounding, hashing and ordered search as ``Column`` expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: 13 hex digits of an md5 are 52 bits, which a double holds exactly.
HASH_DIGITS = 13
HASH_RANGE = 2.0**52


def clip(value: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def round_half_even(value: Column) -> Column:
    """Round halves to the even neighbour and return a long."""
    return F.bround(value, 0).cast("long")


def missing(name: str, numeric: bool) -> Column:
    """True where a value is null, NaN or infinite."""
    column = F.col(f"`{name}`")
    if not numeric:
        return column.isNull()
    as_double = column.cast("double")
    return column.isNull() | F.isnan(as_double) | (F.abs(as_double) == F.lit(float("inf")))


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def hash_key(seed, ids: Iterable) -> Column:
    """md5 of the seed and ids as hex text: a row order no partitioning can change.

    Every part goes in with its length, null as ``~``, so that different ids never read the same.
    """
    parts = [seed if isinstance(seed, Column) else F.lit(seed)]
    parts += [F.col(f"`{i}`") if isinstance(i, str) else i for i in ids]
    texts = [p.cast("string") for p in parts]
    sized = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit("."), t), F.lit("~")) for t in texts]
    return F.md5(F.concat_ws(":", *sized).cast("binary"))


def hash_number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, HASH_DIGITS), 16, 10).cast("long")


def hash_uniform(key: Column) -> Column:
    """Uniform in the open interval (0, 1)."""
    return (hash_number(key).cast("double") + F.lit(0.5)) / F.lit(HASH_RANGE)


def count_not_above(ordered: Column, value: Column, max_size: int) -> Column:
    """How many entries of an ascending array are <= value, by binary search."""
    steps, step = [], 1
    while step <= max_size:
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda seen, s: F.when(F.get(ordered, seen + s - 1) <= value, seen + s).otherwise(seen),
    )
