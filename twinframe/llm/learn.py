"""What the classifiers share: a bounded labelled sample, hashed words, a gradient step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from twinframe.llm.tables import held_out
from twinframe.llm.text import mix, rolling, word_bounds

#: Bytes of words for the classifiers: letters and digits, upper case lowered.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NO_WORD = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80) for b in range(256)])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text"):
    """At most about ``rows`` labelled texts of each class: (texts, 0/1 labels, weights that restore the class shares).

    Only rows that are not held out are used; of a class with more rows, those
    of smallest id hash. An id with several labels counts as 1 if any is 1;
    null labels, ids and texts teach nothing.
    """
    known = (
        labels.where(~held_out(id_col) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    )
    sizes = {row["_label"]: row["count"] for row in known.groupBy("_label").count().collect()}
    keep = F.lit(False)
    for value, size in sizes.items():
        cut = (1 << 63) - 1 if size <= rows else int((1 << 64) * rows / size) - (1 << 63)
        keep = keep | ((F.col("_label") == value) & (F.xxhash64(F.lit(3), "_id") <= cut))
    chosen = F.broadcast(known.where(keep))  # bounded by ``rows`` per class
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
        .join(chosen, "_id").select("_id", "_text", "_label").toPandas().sort_values(["_id", "_text"])
    )
    y = found["_label"].to_numpy(np.int64)
    drawn = np.bincount(y, minlength=2)
    weight = np.array([sizes.get(int(v), 0) / drawn[v] for v in y], float) if len(y) else np.zeros(0)
    return [t.encode(errors="replace") for t in found["_text"]], y, weight / weight.mean() if len(y) else weight


def hashed_words(data: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of every word (letters and digits, lowered) of a buffer and of its first ``head`` bytes; start, end."""
    roll = rolling(21)
    start, end = word_bounds(data, NO_WORD)
    prefix = roll.of_bytes(np.frombuffer(LOWER, np.uint8)[data])
    stem = roll.slices(prefix, start, np.minimum(end, start + head))
    return mix(roll.slices(prefix, start, end)), mix(stem ^ np.uint64(head)), start, end


def places(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of every hash among the sorted keys; the number of keys for one that is not there."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, len(keys))


class Adam:
    """Gradient steps with running moments over a list of arrays."""

    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.mean = [np.zeros_like(v) for v in values]
        self.square = [np.zeros_like(v) for v in values]

    def move(self, slopes: list[np.ndarray]) -> None:
        self.step += 1
        for value, slope, mean, square in zip(self.values, slopes, self.mean, self.square):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            value -= self.rate * (mean / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
