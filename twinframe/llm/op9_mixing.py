"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in the order of a hash, form a stream that is cut into
blocks of equal size. Slot i of the schedule belongs to the source in whose
share of [0, 1) the i-th van der Corput point falls, the reversed bits of i; so
any stretch of slots holds the sources in nearly their shares. The r-th slot of a source
takes the r-th block of its stream, from the start again once the stream ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinframe.llm.tables import table
from twinframe.session import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
MOST = 3
#: Words of a block.
BLOCK = 1024
#: Points have so many bits.
BITS = 40
UNITS = 1 << BITS
#: Slots that are ranked together.
STRETCH = 1 << 16
#: Rows that one window of a running total holds on average.
RANGE = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(rows: DataFrame, group: list[str], order: list, part: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one in its group.

    ``part`` must rise with the order and cut every group into stretches of
    bounded size: totals are taken inside a stretch, and the few stretch totals
    are summed apart, so that a group of any size is never in one task.
    """
    cut = rows.withColumn("_part", part).withColumn("_value", value)
    totals = cut.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_ahead") + F.col("_inside"))
        .drop("_part", "_value", "_sum", "_ahead", "_inside")
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, weight, target) per source of ``sizes`` (key, null_last, size).

    Weights repeat over the sources in code point order, null last. All sources
    share the sum of sizes by weight; a source stops at ``most`` times its size
    and what is over is shared again among the others until none is above. One
    row per source is ranked in one task; the rounds bring three sums to the
    driver. Sources without words get zero. If every source is full, the rest
    cannot be placed.
    """
    place = F.row_number().over(Window.orderBy("null_last", "key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = materialize(
        sizes.groupBy("null_last", "key").agg(F.sum("size").alias("source_size"))
        .select("null_last", "key", "source_size", weight.cast("long").alias("weight"))
        .withColumn("cap", most * F.col("source_size"))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, rest, shares = F.lit(False), total, None
    while True:
        left, capped, open_, n_full = sources.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("cap"))),
            F.count(F.when(~full, 1)), F.count(F.when(full, 1)),
        ).first()
        rest = total - (capped or 0)
        if not open_ or shares == n_full:
            break
        shares = n_full
        full = full | (F.col("weight") * F.lit(rest) >= F.col("cap") * F.lit(left))
    share = F.col("weight") * F.lit(rest) / F.lit(left or 1)
    return sources.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(share))


def _schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(source, rank): the schedule's slots, ranked per source, up to the slots each source needs.

    A point finds its source by an equal join on cells of [0, 1) that each
    source's share is spread over.
    """
    spark = sources.sparkSession
    cells = 4 * sources.count() + 1
    cell = lambda units: F.floor(units * cells / UNITS)
    shares = sources.withColumn(
        "cell", F.explode(F.sequence(cell(F.col("low")), F.greatest(cell(F.col("low")), cell(F.col("high") - 1))))
    ).select("source", "low", "high", "cell")
    points = (
        spark.range(slots)
        .withColumn("slot_part", F.floor(F.col("id") / STRETCH))
        .withColumn("unit", F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long"))
        .withColumn("cell", cell(F.col("unit")))
    )
    return points.join(shares, "cell").where("unit >= low and unit < high").select("source", "id", "slot_part")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK,
) -> DataFrame:
    """(id, tie, size, source_size, target, taken) per row of ``docs``; ``tie`` is xxhash64 of the text.

    ``taken`` is the number of words the mix takes from the row, repeats counted:
    at most ``most`` times its size, and over a source the rounded target. Rows
    of one source are ordered by the md5 of their id, then by the id and a hash
    of the text, so reruns agree; repeated rows each count. Null text or text
    without words has size 0 and gives nothing; a null source is a source of its
    own. Other columns are not read. An empty table gives an empty table.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).isNull().alias("null_last"),
            F.coalesce(F.col(source_col), F.lit("")).alias("key"), word_count(F.col(text_col)).alias("size"),
            F.md5(F.col(id_col).cast("string").cast("binary")).alias("turn"), F.xxhash64(text_col).alias("tie"),
        )
    )
    targets = source_targets(rows.select("null_last", "key", "size"), weights, most)
    quota = F.round("target").cast("long")
    before = Window.orderBy("null_last", "key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("target").over(before), F.lit(0.0))
    everything = F.sum("target").over(Window.partitionBy())
    point = lambda x: F.floor(x * UNITS / F.greatest(everything, F.lit(1.0)))
    sources = materialize(
        targets.withColumn("quota", quota)
        .withColumn("source", F.row_number().over(Window.orderBy("null_last", "key")))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        # whole rounds of the stream, then blocks until the quota is reached
        .withColumn("need", F.when(
            F.col("source_size") > 0,
            F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks")
            + F.ceil(F.col("quota") % F.col("source_size") / block),
        ).otherwise(0))
        .withColumn("low", point(start)).withColumn("high", point(start + F.col("target")))
    )
    slots = sources.agg(F.sum("need")).first()[0] or 0

    drawn = _schedule(sources, slots)
    counts = drawn.groupBy("source").count()
    ranked = running_total(drawn, ["source"], ["id"], F.col("slot_part"), F.lit(1), "rank").select("source", "rank")
    # a source that the points left short of its need gets its last slots at the end
    short = (
        sources.join(counts, "source", "left").withColumn("count", F.coalesce("count", F.lit(0))).where("count < need")
        .select("source", F.explode(F.sequence(F.col("count"), F.col("need") - 1)).alias("rank"))
    )
    slot = ranked.unionByName(short).join(sources, "source").where("rank < need")
    uses = (
        slot.withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("at", F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block)
        # the last slot of a source stops at the quota
        .withColumn("stop", F.least(F.lit(block), F.col("quota") - F.col("at")))
        .groupBy("source", "block").agg(F.count("*").alias("times"), F.min("stop").alias("stop"))
    )

    named = rows.join(sources.select("null_last", "key", "source", "source_size", "target"), ["null_last", "key"])
    stretches = rows.count() // RANGE + 1
    part = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * stretches / F.lit(1 << 32))
    part = F.coalesce(part, F.lit(-1))
    placed = running_total(named, ["source"], ["turn", "id", "tie"], part, F.col("size"), "offset")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()))
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
        )))
        .withColumn("low", F.greatest(F.col("offset") - F.col("block") * block, F.lit(0)))
        .withColumn("high", F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.lit(block)))
    )
    # of a block's uses only the last may stop early
    words = F.col("times") * (F.col("high") - F.col("low")) - F.greatest(
        F.lit(0), F.col("high") - F.greatest("low", "stop")
    )
    taken = pieces.join(uses, ["source", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "id", "tie", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, to the nearest whole row; all columns are kept.

    Rows that give less than half of their words go, and so do texts without words.
    Rows of equal id and text share one number of copies. Columns may have any
    names; an empty table gives an empty table.
    """
    shares = mix(docs, id_col, text_col, source_col).where("size > 0")
    copies = shares.groupBy("id", "tie").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("doc_tie"),
    ).join(copies.where("copies > 0"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_tie") == F.col("tie")))
    return held.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("tie").withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(doc_id::VARCHAR) AS turn
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM sources
), level AS (
  SELECT rest, left_weight FROM filled WHERE weight * rest < cap * left_weight ORDER BY left_weight DESC LIMIT 1
), targets AS (
  SELECT source, source_size,
    coalesce(CASE WHEN weight * level.rest >= cap * level.left_weight THEN cap::DOUBLE
      ELSE (weight * level.rest)::DOUBLE / level.left_weight::DOUBLE END, cap::DOUBLE) AS target
  FROM filled LEFT JOIN level ON true
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS quota,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
    ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM placed
"""
