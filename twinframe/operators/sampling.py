"""Exact-size samples and splits in md5 order.

Rows are labelled by comparing their hash with a few cut values, so the table
itself is neither sorted nor shuffled.  ``ids`` must identify a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinframe.functions.scalars import hash_key
from twinframe.operators.cumulative import rank_cuts, running_totals
from twinframe.operators.lookup import lookup
from twinframe.session import default_buckets, fits_broadcast, materialize

SEEDS = (42, 123, 456)
RATIOS = (0.70, 0.15, 0.15)

#: Leading hex digits that form a range: 4,096 even ranges of the hash per look.
RANGE_DIGITS = 3

#: Copies of one row that are written out in one piece.
RUN_ROWS = 65_536


def _cuts(
    rows: DataFrame, key: Sequence[str], ids: Sequence[str], seed, wanted: Column, small: bool = True
) -> DataFrame:
    hashed = rows.select(*key, hash_key(seed, ids).alias("_at"))
    return rank_cuts(hashed, key, "_at", wanted, RANGE_DIGITS, small)


def sample_exact(rows: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, or all rows if there are fewer."""
    wanted = F.array(F.least(F.lit(n).cast("long"), F.col("_rows")))
    cut = _cuts(rows.withColumn("_all", F.lit(0)), ["_all"], ids, seed, wanted).select("at")
    return (
        rows.withColumn("_cut", cut.scalar())
        .where(hash_key(seed, ids) <= F.col("_cut"))
        .drop("_cut")
    )


def sample_sides(pair: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """:func:`sample_exact` of each side of a labelled pair."""
    wanted = F.array(F.least(F.lit(n).cast("long"), F.col("_rows")))
    cuts = _cuts(pair, ["side"], ids, seed, wanted).select("side", F.col("at").alias("_cut"))
    # a pair has two sides, so the cut table has at most two rows
    return (
        pair.join(F.broadcast(cuts), "side")
        .where(hash_key(seed, ids) <= F.col("_cut"))
        .drop("_cut")
    )


def balanced_pair(pair: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Cut both sides to the size of the smaller one."""
    sizes = pair.agg(
        F.count_if(F.col("side") == "real"), F.count_if(F.col("side") == "synth")
    ).first()
    return sample_sides(pair, ids, min(sizes), seed)


def _split_ends(ratios: Sequence[float]) -> Column:
    first = F.floor(F.col("_rows") * F.lit(float(ratios[0])))
    return F.array(first, first + F.floor(F.col("_rows") * F.lit(float(ratios[1]))))


def _split_label(at: Column) -> Column:
    return (
        F.when(at <= F.col("_train"), "train").when(at <= F.col("_val"), "val").otherwise("test")
    )


def _cut_pair(cuts: DataFrame, key: Sequence[str]) -> DataFrame:
    return cuts.groupBy(*key).agg(
        F.max(F.when(F.col("cut") == 0, F.col("at"))).alias("_train"),
        F.max("at").alias("_val"),
    )


def split_by_seed(
    rows: DataFrame,
    ids: Sequence[str],
    seeds: Sequence[int] = SEEDS,
    ratios: Sequence[float] = RATIOS,
) -> DataFrame:
    """One copy of the rows per seed with a ``split`` column: floor, floor, the rest."""
    seeded = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    cuts = _cut_pair(_cuts(seeded, ["seed"], ids, F.col("seed"), _split_ends(ratios)), ["seed"])
    # one row per seed
    return (
        seeded.join(F.broadcast(cuts), "seed", "left")
        .withColumn("split", _split_label(hash_key(F.col("seed"), ids)))
        .drop("_train", "_val")
    )


def split_train_val_test(
    rows: DataFrame, ids: Sequence[str], seed: int = 42, ratios: Sequence[float] = RATIOS
) -> DataFrame:
    return split_by_seed(rows, ids, [seed], ratios).drop("seed")


def split_stratified(
    rows: DataFrame, ids: Sequence[str], label: str, seed: int = 42, test_share: float = 0.3
) -> DataFrame:
    """``split`` = test for ceil(share * rows) of every label, train for the rest."""
    wanted = F.array(F.ceil(F.col("_rows") * F.lit(float(test_share))))
    labels = materialize(rows.select(label).distinct())
    small = fits_broadcast(labels)
    cuts = _cuts(rows, [label], ids, seed, wanted, small).select(
        F.col(label).alias("_label"), F.col("at").alias("_cut")
    )
    return (
        lookup(rows, cuts, label, "_label", ["_cut"], small)
        .withColumn(
            "split", F.when(hash_key(seed, ids) <= F.col("_cut"), "test").otherwise("train")
        )
        .drop("_cut")
    )


def split_stratified_total(
    rows: DataFrame, ids: Sequence[str], label: str, seed: int = 42, test_share: float = 0.3
) -> DataFrame:
    """``split`` with exactly ceil(share * all rows) test rows, shared over the labels by largest remainder.

    Every label gets the floor of its share, and those with the largest remainders one
    row more (of equal ones the first in label order, null before all), until the total
    is reached.  So each label is within one row of its share.
    """
    share = F.lit(float(test_share))
    quota = lambda n: n * share
    counts = materialize(rows.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.count(F.lit(1)).alias("_n")))
    turn = F.struct((F.floor(quota(F.col("_n"))) - quota(F.col("_n"))).alias("minus"), F.col("_label").alias("label"))
    given, total = counts.agg(F.sum(F.floor(quota(F.col("_n")))), F.sum("_n")).first()
    extra = (math.ceil(total * test_share) - given) if total else 0
    small = fits_broadcast(counts)
    keyed = counts.select(F.lit(0).alias("_all"), turn.alias("_at"))
    last = rank_cuts(keyed, ["_all"], "_at", F.array(F.lit(extra).cast("long"))).select("at")
    chosen = turn <= F.col("_last") if extra > 0 else F.lit(False)
    marked = counts.withColumn("_last", last.scalar()).where(chosen).select("_label") if extra > 0 else counts.where("false").select("_label")
    wanted = F.floor(quota(F.col("_n"))) + F.col("_more").isNotNull().cast("long")
    more = marked.withColumnRenamed("_label", "_marked").withColumn("_more", F.lit(1))
    sizes = materialize(
        counts.join(more, F.col("_label").eqNullSafe(F.col("_marked")), "left").select("_label", wanted.alias("_wanted"))
    )
    # the cut of a label stands at its own rank
    sized = lookup(rows.select(*ids, label), sizes, label, "_label", ["_wanted"], small)
    hashed = sized.where("_wanted > 0").select(F.col(f"`{label}`"), "_wanted", hash_key(seed, ids).alias("_at"))
    cuts = rank_cuts(hashed, [label, "_wanted"], "_at", F.array(F.col("_wanted")), RANGE_DIGITS, small).select(
        F.col(label).alias("_label"), F.col("at").alias("_cut")
    )
    test = F.coalesce(hash_key(seed, ids) <= F.col("_cut"), F.lit(False))
    return (
        lookup(rows, cuts, label, "_label", ["_cut"], small)
        .withColumn("split", F.when(test, "test").otherwise("train"))
        .drop("_cut")
    )


def resampled_columns(
    rows: DataFrame, ids: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """``n`` rows (row_id, columns...) whose columns hold real values, each in an order of its own.

    Every column is ordered by a hash of its name and the row ids.  Of N values row i
    takes the one at rank ``i * N div n``: each once if n = N, an even part of them if
    n is smaller, each floor(n / N) or ceil(n / N) times if larger.  Nulls are values
    like any other.  Ranks are running totals over ranges of the order, so no column is
    sorted in one task, and which rows a rank gives follows by arithmetic, without a join.
    """
    entry = lambda c, i, kind: F.struct(
        F.lit(i).alias("column"),
        hash_key(seed, [*ids, F.lit(c)]).alias("_at"),
        (F.col(f"`{c}`").cast("double") if kind == "n" else F.lit(None).cast("double")).alias("number"),
        (F.col(f"`{c}`").cast("string") if kind == "c" else F.lit(None).cast("string")).alias("level"),
    )
    names = [*numeric, *categorical]
    entries = [entry(c, i, "n" if i < len(numeric) else "c") for i, c in enumerate(names)]
    long = rows.select(F.inline(F.array(*entries))).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(long, ["column"], "_at", ["one"])
    # rows i with i * N div n = r: from ceil(r n / N) up to, but without, ceil((r + 1) n / N)
    first, after = (
        f"(({rank}) * {int(n)}L + total_one - 1) div total_one" for rank in ("cum_one - 1", "cum_one")
    )
    taken = ranked.where(F.expr(f"{first} < {after}")).withColumn("row_id", F.explode(F.expr(f"sequence({first}, {after} - 1)")))
    value = lambda i, c: F.max(F.when(F.col("column") == i, F.col("number" if i < len(numeric) else "level"))).alias(c)
    return taken.groupBy("row_id").agg(*[value(i, c) for i, c in enumerate(names)])


def labelled_union(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Both tables under a ``side`` column, by column name."""
    return real.withColumn("side", F.lit("real")).unionByName(
        synth.withColumn("side", F.lit("synth"))
    )


def with_row_id(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows 0..n-1 by content, for tables without a key.

    The order is the md5 of all columns as text. Equal rows are counted before
    anything is shuffled and numbered in turn, so reruns agree. The copies of a row
    are written out in runs of at most ``RUN_ROWS``, dealt over the tasks, so a row
    with many copies is neither a hot key nor one long array.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    hashed = counted.withColumn("_all", F.lit(0)).withColumn("_at", hash_key(0, rows.columns))
    placed = running_totals(hashed, ["_all"], "_at", ["_copies"])
    first, last = F.col("cum__copies") - F.col("_copies"), F.col("cum__copies") - 1
    few = placed.where(F.col("_copies") <= RUN_ROWS).select(*columns, first.alias("_from"), last.alias("_to"))
    many = placed.where(F.col("_copies") > RUN_ROWS).withColumn(
        "_from", F.explode(F.sequence(first, last, F.lit(RUN_ROWS).cast("long")))
    )
    runs = many.select(*columns, "_from", F.least(F.col("_from") + (RUN_ROWS - 1), last).alias("_to"))
    dealt = runs.repartition(default_buckets(rows.sparkSession), "_from")
    numbered = few.unionByName(dealt).withColumn(name, F.explode(F.sequence("_from", "_to")))
    return numbered.select(name, *columns)
