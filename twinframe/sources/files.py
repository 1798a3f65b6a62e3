"""CSV in and out with a byte-order mark, and JSON metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read headered UTF-8 CSV.  With a schema, the header must agree with it."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write headered CSV; each part starts with a UTF-8 byte-order mark."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode(mode).option("header", True).csv(path)


def nested_record(results: DataFrame) -> DataFrame:
    """Long ``(method, family, metric, column, mean, std)`` rows as one JSON text per method.

    A record holds one entry per metric and column, so its size is set by the
    schema of the compared tables and never by their rows.
    """
    entry = F.struct("family", "metric", "column", "mean", "std")
    return (
        results.groupBy("method")
        .agg(F.array_sort(F.collect_list(entry)).alias("metrics"))
        .select("method", F.to_json(F.struct("method", "metrics")).alias("record"))
    )


def record_rows(records: DataFrame) -> DataFrame:
    """The metric rows of :func:`nested_record`."""
    entry = "struct<family:string,metric:string,column:string,mean:double,std:double>"
    parsed = F.from_json("record", f"metrics array<{entry}>")
    return records.select("method", F.inline(parsed["metrics"]))


def write_report(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write metric rows as JSON lines, one folder per method."""
    results.write.mode(mode).partitionBy("method").json(path)
