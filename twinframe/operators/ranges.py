"""Order statistics by counted ranges, without exchanging the values.

The span of a column is cut into equal cells.  One pass counts each cell and
notes its smallest and largest value; tasks add up before the shuffle, so what
moves is cells, not values.  A cell of one value is settled, however many rows
it has.  Of the others only those are looked into again that can hold an answer:
a wanted rank, or a distribution gap wider than the widest one seen.  Their span
is cut into cells in turn, until the rows left are few enough to count by value.
Every level is exact; cells only decide how much is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinframe.session import materialize

#: Cells of all frames of one level together, and the fewest in one frame.
CELLS = 1 << 16
MIN_CELLS = 64

#: Rows of open cells that are counted by value instead of being cut again.
COUNTED_ROWS = 1_000_000

_BEFORE = (Window.unboundedPreceding, -1)


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _cell(cells: int) -> Column:
    """Number of a value's cell in its frame [lo, hi]; rises with the value, infinities apart."""
    span = F.col("hi") / 2 - F.col("lo") / 2
    place = F.floor((F.col("value") / 2 - F.col("lo") / 2) / span * cells)
    return (
        F.when(F.col("value") == F.lit(float("-inf")), F.lit(-1))
        .when(F.col("value") == F.lit(float("inf")), F.lit(cells))
        .when(F.coalesce(span, F.lit(0.0)) <= 0, F.lit(0))
        .otherwise(F.least(place, F.lit(cells - 1)))
        .cast("long")
    )


def narrowed(
    rows: DataFrame, sums: Sequence[str], judge: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
) -> list[DataFrame]:
    """Count cells level by level; returns what ``judge`` settles at each.

    ``rows`` is long (column, value, sums...) without null and NaN.  ``judge`` gets a
    level's cells (frame, cell, lo, hi, rows, sums...) and the frames they were cut
    from: (column, frame) first, then its own open cells.  It returns the settled
    answers and the cells to look into, (column, cell, lo, hi, rows, carried...), and
    must settle a cell where lo = hi.  Columns and wanted answers are few, so frames
    are broadcast; their number is bounded by the answers wanted.  Frames and cells
    are one number in the rows, which is cheaper to count and join by than text.
    """
    rows = rows.withColumn("value", F.col("value").cast("double"))
    totals = {"rows": F.count(F.lit(1)), **{c: F.sum(c) for c in sums}}
    ends = rows.groupBy("column").agg(F.min(_finite(F.col("value"))).alias("lo"), F.max(_finite(F.col("value"))).alias("hi"))
    frames = materialize(ends.withColumn("frame", (F.row_number().over(Window.orderBy("column")) - 1).cast("long")))
    part = rows.join(F.broadcast(frames.select("column", "frame", "lo", "hi")), "column").drop("column")
    settled, n_frames = [], frames.count()
    while True:
        cells = max(MIN_CELLS, CELLS // max(1, n_frames))
        cut = part.withColumn("cell", F.col("frame") * (cells + 2) + _cell(cells) + 1).drop("frame", "lo", "hi")
        counted = cut.groupBy("cell").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"), *[c.alias(name) for name, c in totals.items()]
        )
        counted = counted.withColumn("frame", F.floor(F.col("cell") / (cells + 2)))
        answers, open_ = judge(materialize(counted), frames)
        settled.append(answers)
        number = (F.row_number().over(Window.orderBy("cell")) - 1).cast("long")
        frames = materialize(open_.withColumn("frame", number))
        left, n_frames = frames.agg(F.sum("rows"), F.count(F.lit(1))).first()
        if not left:
            return settled
        part = cut.join(F.broadcast(frames.select("cell", "frame", "lo", "hi")), "cell").drop("cell")
        frames = frames.drop("cell", "rows", *sums)
        if left <= COUNTED_ROWS:
            values = part.groupBy("frame", "value").agg(*[c.alias(name) for name, c in totals.items()])
            values = values.withColumns({"cell": F.lit(0), "lo": F.col("value"), "hi": F.col("value")}).drop("value")
            settled.append(judge(values, frames)[0])
            return settled
        part = materialize(part)


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def values_at_ranks(rows: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Sizes ``(column, total)``, and ``(column, rank, value)``: the values at ranks (from 0) of each column.

    ``rows`` is long (column, value, n), n repetitions of a value; null and NaN are
    left out.  ``wanted`` is an array<bigint> over the column's size ``total``; ranks
    from ``total`` on have no row.
    """
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("column", "value", "n")
    known_sizes: list[DataFrame] = []

    def judge(cells: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        if "asked" in frames.columns:
            asked = frames.select("column", "frame", F.inline("asked"))
        else:
            sizes = cells.groupBy("frame").agg(F.sum("n").alias("total")).join(F.broadcast(frames), "frame")
            known_sizes.append(materialize(sizes.select("column", "frame", "total")))
            asked = known_sizes[0].select("column", "frame", "total", F.explode(wanted).alias("rank")).where("rank < total")
            asked = asked.select("column", "frame", "rank", F.col("rank").alias("at"))
        # a rank lies in the last cell that begins at or before it
        order = Window.partitionBy("frame").orderBy("lo")
        held = F.struct("cell", "lo", "hi", "rows", "n", "at")
        begun = cells.withColumn("at", F.coalesce(F.sum("n").over(order.rowsBetween(*_BEFORE)), F.lit(0)))
        both = begun.select("frame", "at", F.lit(0).alias("tag"), held.alias("held")).unionByName(
            asked.select("column", "frame", "at", "rank", F.lit(1).alias("tag")), allowMissingColumns=True
        )
        sweep = Window.partitionBy("frame").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = both.withColumn("held", F.last("held", ignorenulls=True).over(sweep)).where("tag = 1").select(
            "column", "rank", (F.col("at") - F.col("held.at")).alias("at"), *[F.col(f"held.{c}") for c in ("cell", "lo", "hi", "rows", "n")]
        )
        edge = F.when((F.col("at") == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).when(
            F.col("at") == F.col("n") - 1, F.col("hi")
        )
        placed = materialize(placed.withColumn("value", edge))
        known = placed.where("value IS NOT NULL").select("column", "rank", "value")
        inside = F.collect_list(F.struct("rank", "at")).alias("asked")
        return known, placed.where("value IS NULL").groupBy("column", "cell", "lo", "hi", "rows").agg(inside)

    found = _united(narrowed(kept, ["n"], judge))
    return known_sizes[0].drop("frame"), found


def widest_gaps(rows: DataFrame, sides: Mapping[str, Column]) -> DataFrame:
    """``(column, gap, <side>...)``: the widest gap between two distribution functions, and the sizes.

    ``rows`` is long (column, value, ...); ``sides`` names two counts as 0/1 columns over
    its rows.  Null and NaN values are left out.  The gap is null where a side has no
    values.  A cell is looked into only if its rows, in the worst order, could open a
    gap wider than the widest at any cell's end.
    """
    first, second = sides
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "column", "value", *[c.cast("long").alias(name) for name, c in sides.items()]
    )
    sizes: list[DataFrame] = []
    widest: list[DataFrame] = []

    def judge(cells: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not sizes:
            found = cells.groupBy("frame").agg(*[F.sum(s).alias(f"total_{s}") for s in sides])
            found = found.join(F.broadcast(frames.select("column", "frame")), "frame")
            sizes.append(materialize(found.drop("frame")))
            frames = frames.select("column", "frame", *[F.lit(0).cast("long").alias(f"before_{s}") for s in sides])
        carried = frames.select("column", "frame", *[f"before_{s}" for s in sides]).join(F.broadcast(sizes[0]), "column")
        order = Window.partitionBy("frame").orderBy("lo").rowsBetween(*_BEFORE)
        swept = cells.join(F.broadcast(carried), "frame").withColumns(
            {f"before_{s}": F.col(f"before_{s}") + F.coalesce(F.sum(s).over(order), F.lit(0)) for s in sides}
        )

        def share(side: str, more: Column) -> Column:
            return F.try_divide(F.col(f"before_{side}") + more, F.col(f"total_{side}"))

        none = F.lit(0)
        swept = swept.withColumns({
            "gap": F.abs(share(first, F.col(first)) - share(second, F.col(second))),
            "reach": F.greatest(
                F.abs(share(first, F.col(first)) - share(second, none)), F.abs(share(first, none) - share(second, F.col(second)))
            ),
        })
        ends = swept.groupBy("column").agg(F.max("gap").alias("gap"))
        widest.append(materialize(ends))
        best = _united(widest).groupBy("column").agg(F.max("gap").alias("best"))
        open_ = swept.where("lo < hi").join(F.broadcast(best), "column").where("reach > best")
        return widest[-1], open_.select("column", "cell", "lo", "hi", "rows", *[f"before_{s}" for s in sides])

    gaps = _united(narrowed(kept, [first, second], judge)).groupBy("column").agg(F.max("gap").alias("gap"))
    return sizes[0].join(gaps, "column").select(
        "column", "gap", F.col(f"total_{first}").alias(first), F.col(f"total_{second}").alias(second)
    )
