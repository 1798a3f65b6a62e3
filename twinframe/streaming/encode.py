"""Encode a stream of rows, or decode a stream of latents, under a fitted state.

Both are row-wise, so they hold no stream state and need no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from twinframe.operators.encoder import EncoderState, decode, encode

#: Name of the observation that counts rows and unseen levels.
REJECTS = "rejects"


def encode_stream(
    stream: DataFrame, state: EncoderState, path: str, checkpoint: str, keep: Sequence[str] = ()
) -> StreamingQuery:
    """Append encoded rows to a Parquet folder until the source is read up.

    Every micro-batch counts its rows and, per categorical column, those whose level
    the state does not know; :func:`reject_counts` reads them.
    """
    return _append(observed(encode(stream, state, keep), state), path, checkpoint)


def observed(encoded: DataFrame, state: EncoderState) -> DataFrame:
    """Count rows and unseen levels of an encoded table or stream while it is written.

    An unseen level is a null in its place of ``z``; nothing is read or shuffled for it.
    """
    first = len(state.numeric)
    unseen = [
        F.count_if(F.get("z", F.lit(first + i)).isNull()).alias(f"_unseen{i}") for i in range(len(state.categorical))
    ]
    return encoded.observe(REJECTS, F.count(F.lit(1)).alias("n_rows"), *unseen)


def reject_counts(query: StreamingQuery, state: EncoderState) -> list[dict]:
    """``{batch, n_rows, unseen: {column: n}}`` of the micro-batches the query still reports, oldest first.

    Spark keeps the progress of the last ``spark.sql.streaming.numRecentProgressUpdates``
    batches; batches without rows are left out.
    """
    found = []
    for progress in query.recentProgress:
        seen = progress.observedMetrics.get(REJECTS)
        if seen is not None and seen["n_rows"]:
            unseen = {c: seen[f"_unseen{i}"] for i, c in enumerate(state.categorical)}
            found.append({"batch": progress.batchId, "n_rows": seen["n_rows"], "unseen": unseen})
    return found


def decode_stream(
    stream: DataFrame, state: EncoderState, path: str, checkpoint: str, keep: Sequence[str] = ()
) -> StreamingQuery:
    return _append(decode(stream, state, keep), path, checkpoint)


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
