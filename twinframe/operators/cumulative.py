"""Exact ordered passes without a single-task window.

A window with no partition key, or with a key that holds a third of the rows,
runs in one task.  Here the order is cut into ranges at sampled splitters:
running sums are taken inside each range and the few range totals are added
back.  The result is exact for any splitters; they only balance the work.  The
sample is taken by hash, so it does not depend on partitioning or retries.

``key`` columns name a few groups (table columns, seeds, sides), not data values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinframe.functions.scalars import count_not_above
from twinframe.operators.ranges import values_at_ranks
from twinframe.session import default_buckets, materialize

SAMPLE_PER_BUCKET = 16

#: A range of at most this many rows is sorted by one task.
SORTED_ROWS = 1_000_000

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)

#: Hex digits of an md5.
HASH_LENGTH = 32


def with_range(
    rows: DataFrame, key: Sequence[str], order: str, buckets: int | None = None
) -> DataFrame:
    """Add ``_key``, a number per key, and ``_range``, which rises with ``order`` within it.

    Ranges of different keys differ.
    """
    buckets = buckets or default_buckets(rows.sparkSession)
    if isinstance(rows.schema[order].dataType, T.NumericType):
        evenly = [i / buckets for i in range(1, buckets)]
        splitters = rows.groupBy(*key).agg(
            F.array_sort(F.percentile_approx(order, evenly)).alias("_splitters")
        )
    else:
        splitters = _sampled_splitters(rows, key, order, buckets)
    # one array of at most ``buckets`` entries per key; keys get numbers, because
    # sorting and joining by a number is much cheaper than by text
    found = splitters.select(*key, "_splitters").collect()
    schema = T.StructType([*splitters.schema.fields, T.StructField("_key", T.IntegerType(), False)])
    numbered = rows.sparkSession.createDataFrame(
        [(*row, i) for i, row in enumerate(found)], schema
    )
    place = count_not_above(F.col("_splitters"), F.col(order), buckets)
    cell = F.col("_key") * F.lit(buckets + 1) + F.coalesce(place, F.lit(0))
    return join_null_safe(rows, F.broadcast(numbered), key).withColumn("_range", cell).drop("_splitters")


def join_null_safe(rows: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on equal columns where null equals null; the columns come from ``rows``."""
    renamed = other.withColumnsRenamed({c: f"_other_{c}" for c in by})
    match = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in by]
    return rows.join(renamed, match).drop(*[f"_other_{c}" for c in by])


def _sampled_splitters(
    rows: DataFrame, key: Sequence[str], order: str, buckets: int
) -> DataFrame:
    """Splitters for text and composite orders, from a hash sample of fixed expected size."""
    wanted = buckets * SAMPLE_PER_BUCKET
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    stride = F.greatest(F.lit(1), F.expr(f"_rows div {wanted}"))
    picked = (
        rows.select(*key, order)
        .transform(lambda part: join_null_safe(part, F.broadcast(sizes), key))
        .where(F.pmod(F.xxhash64(*key, order), stride) == 0)
    )
    sample = F.array_sort(F.collect_list(order))
    step = F.greatest(F.lit(1.0), F.size("_sample") / F.lit(float(buckets)))
    last = F.least(F.size("_sample"), F.lit(buckets)) - 1
    every = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.get("_sample", F.floor(i * step).cast("int"))
    )
    return picked.groupBy(*key).agg(sample.alias("_sample")).select(
        *key, every.alias("_splitters")
    )


def running_totals(
    rows: DataFrame,
    key: Sequence[str],
    order: str,
    sums: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (sum up to and including this row) and ``total_<c>`` per key.

    Rows must be distinct on (key, order): aggregate equal values first.
    """
    # the counted rows are read several times below; computing them is the costly part
    ranged = with_range(materialize(rows), key, order, buckets)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(*_SO_FAR)
    everything = Window.partitionBy("_key")
    before = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_key", "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = offsets.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"total_{c}") for c in sums],
    )
    return (
        ranged.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums})
        .join(F.broadcast(offsets), "_range")
        .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in sums})
        .drop("_key", "_range", *[f"_before_{c}" for c in sums])
    )


def value_counts(rows: DataFrame, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Count long ``(column, value)`` rows, dropping null and NaN values."""
    counts = counts or {"n": F.count(F.lit(1))}
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy("column", "value").agg(*[c.alias(name) for name, c in counts.items()])


def exact_quantiles(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles of long ``(column, value[, n])`` rows.

    ``n`` is an optional weight (repetitions).  Returns ``(column, p, value)``.
    """
    targets = F.array(*[F.lit(float(p)) for p in probabilities])
    place = lambda p: F.floor((F.col("total") - 1) * p)
    sized, found = _at_ranks(rows, F.flatten(F.transform(targets, lambda p: F.array(place(p), place(p) + 1))))
    position = (F.col("total") - 1) * F.col("p")
    at = sized.withColumn("p", F.explode(targets)).withColumns(
        {"_low": F.floor(position), "_part": position - F.floor(position)}
    )
    return _interpolated(at, found).select("column", "p", "value")


def _at_ranks(rows: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Sizes ``(column, total)`` of long rows, and their values at the wanted ranks."""
    weighted = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))
    sizes, found = values_at_ranks(weighted.where("n > 0"), F.array_distinct(wanted))
    return sizes, materialize(found)


def _interpolated(at: DataFrame, found: DataFrame) -> DataFrame:
    """Replace ``_low`` and ``_part`` of every row by the value between its two ranks."""
    lower = found.select("column", F.col("rank").alias("_low"), F.col("value").alias("_l"))
    upper = found.select("column", (F.col("rank") - 1).alias("_low"), F.col("value").alias("_u"))
    step = F.when(F.col("_part") > 0, (F.col("_u") - F.col("_l")) * F.col("_part")).otherwise(0.0)
    joined = at.join(lower, ["column", "_low"]).join(upper, ["column", "_low"], "left")
    return joined.withColumn("value", F.col("_l") + F.coalesce(step, F.lit(0.0))).drop("_low", "_part", "_l", "_u")


def quantile_grid(rows: DataFrame, points: int = 2000) -> DataFrame:
    """Exact quantiles of long ``(column, value)`` rows at evenly spaced probabilities.

    ``min(rows, points)`` references per column.  Equal references collapse into
    one row ``(column, value, p_min, p_max)``.
    """
    # reference j sits at rank j*span/cells, between two whole ranks
    cells = F.least(F.col("total"), F.lit(points)) - 1
    span, parts = F.col("total") - 1, F.greatest(cells, F.lit(1))
    rank = lambda j: ((j * span - j * span % parts) / parts).cast("long")
    every = F.sequence(F.lit(0).cast("long"), cells)
    sized, found = _at_ranks(rows, F.flatten(F.transform(every, lambda j: F.array(rank(j), rank(j) + 1))))
    at = sized.withColumn("_cells", parts).withColumn("j", F.explode(every)).withColumns(
        {"_low": rank(F.col("j")), "_part": F.col("j") * span % F.col("_cells") / F.col("_cells")}
    )
    scale = F.max("_cells").cast("double")
    return _interpolated(at, found).groupBy("column", "value").agg(
        (F.min("j") / scale).alias("p_min"), (F.max("j") / scale).alias("p_max")
    )


def rank_cuts(
    rows: DataFrame,
    key: Sequence[str],
    order: str,
    wanted: Column,
    digits: int | None = None,
    small: bool = True,
) -> DataFrame:
    """The ``order`` value standing at each wanted rank (1-based) of every key.

    ``wanted`` is an array<bigint> over the group size ``_rows``.  Rows are counted
    per range of the order, and only the ranges that hold a wanted rank are looked
    into again, until these are small enough to sort.  ``digits`` says that the
    order is hash text whose leading digits are even ranges; otherwise ranges are
    sampled.  ``small`` says that the number of keys has a bound.  Returns
    ``(key..., cut, at)``, ``cut`` being the position in ``wanted``.
    """
    kind = rows.schema[order].dataType
    leading = None
    if isinstance(kind, T.StructType) and isinstance(kind[0].dataType, T.NumericType):
        leading = kind[0].name

    def ranged(part: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
        if digits is None and level == 1 and leading is not None:
            # the leading field alone also rises with the order, and is cheaper to split
            led = part.withColumn("_lead", F.col(f"{order}.{leading}"))
            return with_range(led, keys, "_lead").drop("_key", "_lead")
        if digits is None:
            return with_range(part, keys, order).drop("_key")
        return part.withColumn("_range", F.substring(order, 1, digits * level))

    def held(counted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
        """Ranges that hold a wanted rank, the rank inside them, and the largest range."""
        reach = Window.partitionBy(*keys).orderBy("_range")
        at = counted.withColumn("_before", F.sum("_n").over(reach) - F.col("_n"))
        if "_k" not in counted.columns:
            whole = F.sum("_n").over(Window.partitionBy(*keys))
            at = at.withColumn("_rows", whole).select("*", F.posexplode(wanted).alias("cut", "_k"))
        inside = F.col("_k") - F.col("_before")
        found = at.where(inside.between(F.lit(1), F.col("_n"))).select(
            *key, "cut", "_range", "_n", inside.alias("_k")
        )
        if small:
            kept = found.collect()
            copy = found.sparkSession.createDataFrame(kept, found.schema)
            return F.broadcast(copy), max([r["_n"] for r in kept], default=0)
        kept = materialize(found)
        return kept, kept.agg(F.max("_n")).first()[0] or 0

    part = ranged(rows.select(*key, order), key, 1)
    counts = part.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    targets, largest = held(counts, key)
    near = join_null_safe(part, targets, [*key, "_range"])
    level, cuts = 1, [*key, "cut"]
    while largest > SORTED_ROWS and not (digits and digits * level >= HASH_LENGTH):
        level += 1
        goal = F.col("_k").alias("_goal")
        part = ranged(materialize(near.select(*cuts, order, goal)), cuts, level)
        counts = part.groupBy(*cuts, "_range").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_goal").alias("_k")
        )
        targets, largest = held(counts, cuts)
        near = join_null_safe(part.drop("_goal"), targets, [*cuts, "_range"])
    place = Window.partitionBy(*key, "cut").orderBy(order)
    return (
        near.withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") == F.col("_k"))
        .select(*key, "cut", F.col(order).alias("at"))
    )


def equal_tiles(rows: DataFrame, order: Sequence[str], tiles: int, name: str) -> DataFrame:
    """Number rows 1..tiles in equal parts of their order (the SQL ``ntile``).

    Only the tiles-1 boundary rows are looked up; labelling is row-wise.  The
    last ``order`` column must be unique.
    """
    keyed = rows.select(F.lit(0).alias("_all"), F.struct(*order).alias("_at"))
    size, rest = f"(_rows div {tiles})", f"(_rows % {tiles})"
    ends = F.array(*[F.expr(f"{i} * {size} + least({i}L, {rest})") for i in range(1, tiles)])
    cuts = rank_cuts(keyed, ["_all"], "_at", ends)
    bounds = cuts.agg(F.array_sort(F.collect_list("at")).alias("_ends"))
    above = F.size(F.filter("_ends", lambda end: end < F.struct(*order)))
    return (
        rows.withColumn("_ends", bounds.scalar())
        .withColumn(name, (above + 1).cast("int"))
        .drop("_ends")
    )
