"""Feature columns: one-hot, label and ordinal codes, standard scores, mixed vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinframe.functions.scalars import present
from twinframe.operators.lookup import lookup
from twinframe.operators.profile import index_levels, level_counts
from twinframe.session import fits_broadcast, groups_that_fit, materialize

#: A one-hot level becomes a column, so their number must suit a table's width.
MAX_ONE_HOT = 10_000


def level_list(rows: DataFrame, categorical: Sequence[str]) -> dict[str, list[str | None]]:
    """Levels per column in text order, for use as columns."""
    counts = level_counts(rows, categorical).select("column", "level")
    found = counts.limit(MAX_ONE_HOT + 1).collect()
    if len(found) > MAX_ONE_HOT:
        raise ValueError(f"more than {MAX_ONE_HOT} levels: too many for one-hot columns")
    levels = {c: [] for c in categorical}
    for row in sorted(found, key=lambda r: (r["level"] is not None, r["level"] or "")):
        levels[row["column"]].append(row["level"])
    return levels


def one_hot(rows: DataFrame, levels: dict[str, list[str | None]], keep: Sequence[str]) -> DataFrame:
    """0/1 column ``<column>=<level>`` per level.

    Frames encoded with the same ``levels`` have the same width and meaning.
    """
    return rows.select(
        *keep,
        *[
            F.col(f"`{c}`").cast("string").eqNullSafe(F.lit(level)).cast("int").alias(f"{c}={level}")
            for c, entries in levels.items()
            for level in entries
        ],
    )


def _label_dictionary(rows: DataFrame, column: str) -> DataFrame:
    return index_levels(level_counts(rows, [column])).select(
        "column", F.col("level").alias("_level"), F.col("idx").alias("_idx")
    )


def label_encode(rows: DataFrame, target: str, name: str = "label") -> DataFrame:
    """Number the target's distinct values 0.. by text order, over all given rows."""
    dictionary = materialize(_label_dictionary(rows, target))
    text = rows.withColumn("_text", F.col(f"`{target}`").cast("string"))
    joined = lookup(text, dictionary, "_text", "_level", ["_idx"], fits_broadcast(dictionary))
    return joined.withColumnRenamed("_idx", name).drop("_text")


def ordinal_encode(pair: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Replace levels by their text-order index among the real rows; -1 if unseen there."""
    real = pair.where(F.col("side") == "real")
    dictionary = materialize(level_dictionary(real, categorical))
    return with_codes(pair, dictionary, {c: c for c in categorical}, groups_that_fit(dictionary, "column"))


def level_dictionary(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Counted levels per column, null among them, numbered in text order."""
    return index_levels(level_counts(rows, categorical))


def with_codes(
    rows: DataFrame, dictionary: DataFrame, names: Mapping[str, str], small: Mapping[str, bool]
) -> DataFrame:
    """Replace levels by their numbers, -1 if unseen; ``names`` gives the dictionary's column of each."""
    for c, entry in names.items():
        entries = dictionary.where(F.col("column") == entry).select(
            F.col("level").alias("_level"), F.col("idx").alias("_idx")
        )
        text = rows.withColumn("_text", F.col(f"`{c}`").cast("string"))
        rows = (
            lookup(text, entries, "_text", "_level", ["_idx"], small.get(entry, True))
            .withColumn(c, F.coalesce("_idx", F.lit(-1)))
            .drop("_idx", "_text")
        )
    return rows


@dataclass(frozen=True)
class Moments:
    """Mean and population deviation per column; a constant column scales by 1."""

    mean: dict[str, float]
    scale: dict[str, float]

    def score(self, name: str):
        return (_known(name) - F.lit(self.mean[name])) / F.lit(self.scale[name])


def _known(name: str):
    """A number as double; NaN counts as null."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(present(value), value)


def fit_moments(rows: DataFrame, numeric: Sequence[str]) -> Moments:
    flat = rows.agg(
        *[f(_known(c)) for c in numeric for f in (F.avg, F.stddev_pop)]
    ).first()
    pairs = {c: (flat[2 * i], flat[2 * i + 1]) for i, c in enumerate(numeric)}
    return Moments(
        {c: m or 0.0 for c, (m, _) in pairs.items()}, {c: s or 1.0 for c, (_, s) in pairs.items()}
    )


def zscore(pair: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Standard scores of both sides under the moments of the real side."""
    moments = fit_moments(pair.where(F.col("side") == "real"), numeric)
    return pair.withColumns({c: moments.score(c) for c in numeric})


def encode_mixed(
    pair: DataFrame, ids: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """``(ids..., side, z)``: scaled numerics, then scaled ordinal codes, fitted on real.

    A null numeric lies at the real mean (0).  The moments of the codes come from
    the counted levels, not from a second pass over the rows.
    """
    real = pair.where(F.col("side") == "real")
    rows, parts = pair.select(*ids, "side", *[f"`{c}`" for c in (*numeric, *categorical)]), []
    if numeric:
        moments = fit_moments(real, numeric)
        parts += [F.coalesce(moments.score(c), F.lit(0.0)) for c in numeric]
    if categorical:
        dictionary = materialize(level_dictionary(real, categorical))
        n, idx = F.col("n").cast("double"), F.col("idx").cast("double")
        mean = F.sum(n * idx) / F.sum(n)
        found = {
            r["column"]: r
            for r in dictionary.groupBy("column")
            .agg(mean.alias("mean"), (F.sum(n * idx * idx) / F.sum(n)).alias("square"),
                 F.max("k").alias("k"))
            .collect()
        }
        rows = with_codes(rows, dictionary, {c: c for c in categorical}, groups_that_fit(dictionary, "column"))
        for c in categorical:
            if c not in found:
                parts.append(F.col(f"`{c}`").cast("double"))
                continue
            center = found[c]["mean"]
            spread = max(found[c]["square"] - center * center, 0.0) ** 0.5
            scale = spread if found[c]["k"] > 1 else 1.0
            parts.append((F.col(f"`{c}`").cast("double") - F.lit(center)) / F.lit(scale))
    return rows.select(*ids, "side", F.array(*parts).alias("z"))
