"""Session helpers: where to cut lineage, and how big a broadcast may get."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A lookup side is broadcast only when it was counted and lies under both bounds.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master, where all of Spark is one process, may leave it unset
    (as tests do) and gets one folder of its own per session: on a cluster such
    a folder would be private to one machine and lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="twinframe-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_buckets(spark: SparkSession) -> int:
    """How many ranges an ordered pass is cut into: as many as shuffle partitions."""
    return max(2, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _row_bytes(df: DataFrame):
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.greatest(F.size(F.col(f"`{field.name}`")), F.lit(0))
        width = width + 16
    return width


def fits_broadcast(
    df: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> bool:
    """Measure a (materialized) table, stopping the count just over ``max_rows``."""
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def groups_that_fit(
    df: DataFrame,
    by: str,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> dict[str, bool]:
    """Which groups of a (materialized) table may be broadcast: the smallest, while all of them fit together."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")).collect()
    rows = size = 0
    found = {}
    for group in sorted(sizes, key=lambda g: (g["bytes"], g[by])):
        rows, size = rows + group["rows"], size + group["bytes"]
        found[group[by]] = rows <= max_rows and size <= max_bytes
    return found
