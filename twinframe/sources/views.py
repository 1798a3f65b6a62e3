"""Real/synthetic stand-ins over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.session import fits_broadcast, materialize

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]
ORDER_NUMERIC = ["o_totalprice"]
ORDER_CATEGORICAL = ["o_orderstatus", "o_orderpriority"]
HOUSEHOLD_NUMERIC = ["c_acctbal", "n_orders", "spend", "max_order", "urgent_pending"]
HOUSEHOLD_CATEGORICAL = ["c_mktsegment", "r_name", "spend_quintile"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _side(key: str):
    return F.when(F.col(key) % 2 == 0, "real").otherwise("synth")


def pair_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(
        _side("l_orderkey").alias("side"),
        *dict.fromkeys(LINE_ID + LINE_NUMERIC + LINE_CATEGORICAL),
    )


def pair_shifted(spark: SparkSession, folder: str) -> DataFrame:
    synth = F.col("side") == "synth"
    return pair_lineitem(spark, folder).withColumns(
        {
            "l_extendedprice": F.when(synth, F.col("l_extendedprice") * 1.1).otherwise(
                F.col("l_extendedprice")
            ),
            "l_returnflag": F.when(synth & (F.col("l_quantity") > 40), "R").otherwise(
                F.col("l_returnflag")
            ),
        }
    )


def pair_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("side", _side("o_orderkey"))


def household(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: segment, region and totals of its orders."""
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    totals = (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("o_totalprice").alias("spend"),
            F.max("o_totalprice").alias("max_order"),
            F.sum(F.when(urgent, F.col("o_totalprice")).otherwise(0.0)).alias("urgent_pending"),
        )
    )
    region = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "customer")
        .join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(region, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            "c_acctbal",
            F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("spend", "max_order", "urgent_pending")],
            "c_mktsegment",
            "r_name",
        )
    )


def household_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    from twinframe.operators.cumulative import equal_tiles

    # every operator reads this derived table several times
    rows = materialize(household(spark, folder))
    tiles = equal_tiles(rows, ["spend", "c_custkey"], 5, "spend_quintile")
    return materialize(tiles.withColumn("spend_quintile", F.col("spend_quintile").cast("string")))


def pair_household(spark: SparkSession, folder: str) -> DataFrame:
    return household_quintiles(spark, folder).withColumn("side", _side("c_custkey"))


def pair_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", _side("vec_id").alias("side"), F.col("embedding").cast("array<double>").alias("z")
    )


def scored_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: y = quality, score = length, predicted above the median length."""
    from twinframe.operators.cumulative import exact_quantiles

    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        F.col("n_chars").cast("double").alias("score"),
    )
    median = exact_quantiles(
        rows.select(F.lit("score").alias("column"), F.col("score").alias("value")), [0.5]
    ).select("value")
    return rows.withColumn("yhat", (F.col("score") > median.scalar()).cast("int"))


def scored_multi(spark: SparkSession, folder: str) -> DataFrame:
    from twinframe.operators.cumulative import equal_tiles

    rows = household_quintiles(spark, folder)
    tiles = equal_tiles(rows, ["max_order", "c_custkey"], 5, "yhat")
    return tiles.select(
        "c_custkey", F.col("spend_quintile").alias("y"), F.col("yhat").cast("string").alias("yhat")
    )


def scored_real(spark: SparkSession, folder: str) -> DataFrame:
    """Orders: y = price, predicted by the mean price of the priority class."""
    from twinframe.operators.lookup import lookup

    orders = table(spark, folder, "orders")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("yhat"))
    means = materialize(means.withColumnRenamed("o_orderpriority", "_class"))
    scored = lookup(orders, means, "o_orderpriority", "_class", ["yhat"], fits_broadcast(means))
    return scored.select("o_orderkey", F.col("o_totalprice").alias("y"), "yhat")
