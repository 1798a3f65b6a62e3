"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinframe.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); component is the smallest node reachable.

    Alternating stars: each round every node with larger neighbours hangs them,
    then its smaller ones, on the smallest node it knows, until nothing moves.
    The number of rounds grows with the logarithm of the size. Minima are
    aggregated before they are shuffled and hubs are only ever joined, so AQE
    can split them. Null ends and self links are dropped; an empty table gives
    an empty table.
    """
    stars = materialize(
        links.where("a <> b")
        .select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        .distinct()
    )
    state = None
    while True:
        larger = _large_star(stars)
        stars = materialize(_small_star(larger))
        total = stars.agg(
            F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))
        ).first()
        if tuple(total) == state:
            break
        state = tuple(total)
    member = stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return member.unionByName(roots)


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        stars.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.where("v > u").join(smallest, "u")
        .select(F.col("m").alias("low"), F.col("v").alias("high"))
        .distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    smallest = stars.groupBy("high").agg(F.min("low").alias("m"))
    hung = stars.join(smallest, "high").where("low <> m")
    return (
        hung.select(F.col("m").alias("low"), F.col("low").alias("high"))
        .unionByName(smallest.select(F.col("m").alias("low"), "high"))
        .distinct()
    )
