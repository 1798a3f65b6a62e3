"""Fit on a real table, draw synthetic rows, check and write them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.operators.diffusion import (
    CANDIDATES,
    STEPS,
    MixtureModel,
    choose_components,
    denoise_loss,
    fit_generator,
    forward_noise,
    independent_sample,
    mixture_sample,
    predict_noise,
    random_step,
    reverse_sample,
)
from twinframe.operators.encoder import EncoderState, decode, encode, fit_encoder
from twinframe.operators.profile import completeness, out_of_domain
from twinframe.operators.sampling import resampled_columns, split_train_val_test
from twinframe.session import materialize
from twinframe.sources.files import write_csv
from twinframe.sources.schema import expect_columns


@dataclass(frozen=True)
class Generator:
    """A fitted encoder and mixture, and the schedule they run under."""

    encoder: EncoderState
    model: MixtureModel
    steps: int = STEPS
    schedule: str = "cosine"

    def save(self, path: str) -> None:
        self.encoder.save(f"{path}/encoder")
        spark = self.encoder.grid.sparkSession
        rows = [
            (float(w), m.tolist(), v.tolist(), q.tolist(), self.steps, self.schedule)
            for w, m, v, q in zip(
                self.model.weights, self.model.means, self.model.values, self.model.vectors
            )
        ]
        spark.createDataFrame(
            rows,
            "weight double, mean array<double>, values array<double>, "
            "vectors array<array<double>>, steps int, schedule string",
        ).write.mode("overwrite").parquet(f"{path}/mixture")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Generator:
        rows = spark.read.parquet(f"{path}/mixture").collect()
        model = MixtureModel(
            *[np.array([r[c] for r in rows], float) for c in ("weight", "mean", "values", "vectors")]
        )
        encoder = EncoderState.load(spark, f"{path}/encoder")
        return cls(encoder, model, rows[0]["steps"], rows[0]["schedule"])


def train(
    rows: DataFrame,
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    components: int | None = 1,
    steps: int = STEPS,
    schedule: str = "cosine",
    seed: int = 42,
    weight: str | None = None,
) -> Generator:
    """Fit encoder and mixture.  The latents are ``cells``: a mixture has no atoms.

    ``components=None`` takes the number that :func:`component_choice` finds on the
    validation split.  ``weight`` names a column of row weights for the mixture.
    """
    encoder = fit_encoder(rows, numeric, categorical)
    # fitting is iterative; the encoded rows are computed once
    latents = materialize(encode(rows, encoder, [*ids, *([weight] if weight else [])], "cells", seed, ids))
    if components is None:
        components = component_choice(latents, ids, seed=seed, weight=weight).where("chosen").first()["components"]
    return Generator(encoder, fit_generator(latents, components, seed, weight), steps, schedule)


def component_choice(
    latents: DataFrame, ids: Sequence[str], candidates: Sequence[int] = CANDIDATES, seed: int = 42, weight: str | None = None
) -> DataFrame:
    """Mixtures fitted to the training split of the latents, judged on its validation split."""
    split = materialize(split_train_val_test(latents, ids, seed))
    train_rows, held = (split.where(F.col("split") == s) for s in ("train", "val"))
    return choose_components(train_rows, held, candidates, seed, weight)


def training_loss(rows: DataFrame, ids: Sequence[str], generator: Generator, seed: int = 42) -> DataFrame:
    """The denoising loss of a fitted generator over whole rows."""
    encoder = generator.encoder
    latents = encode(rows, encoder, ids, "cells", seed, ids)
    stepped = random_step(latents, ids, generator.steps, seed)
    noised = forward_noise(stepped, ids, encoder.width, generator.steps, generator.schedule, seed)
    return denoise_loss(predict_noise(noised, generator.model, generator.steps, generator.schedule))


def synthesize(spark: SparkSession, generator: Generator, n: int, seed: int = 42) -> DataFrame:
    """``n`` synthetic rows in table order, keyed by ``row_id``."""
    latents = reverse_sample(
        spark, generator.model, n, generator.steps, generator.schedule, seed
    )
    return decode(latents, generator.encoder, ["row_id"], "cells")


def baseline_mixture(spark: SparkSession, generator: Generator, n: int, seed: int = 42) -> DataFrame:
    """Synthetic rows straight from the mixture."""
    latents = mixture_sample(spark, generator.model, n, seed)
    return decode(latents, generator.encoder, ["row_id"], "cells")


def baseline_marginals(spark: SparkSession, encoder: EncoderState, n: int, seed: int = 42) -> DataFrame:
    """Synthetic rows whose columns keep their distribution but are independent."""
    latents = independent_sample(spark, encoder.width, n, seed)
    return decode(latents, encoder, ["row_id"], "cells")


def baseline_resampled(
    real: DataFrame, ids: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """Synthetic rows of real values: every column keeps its values exactly, and no tie to the others."""
    return resampled_columns(real, ids, numeric, categorical, n, seed)


def check_synthetic(synth: DataFrame, encoder: EncoderState) -> DataFrame:
    """``(column, n_rows, n_missing, n_out_of_domain)`` of a synthetic table."""
    foreign = (
        out_of_domain(synth, encoder.levels, encoder.categorical)
        .groupBy("column")
        .agg(F.sum("n").alias("n_out_of_domain"))
    )
    return (
        completeness(synth, encoder.numeric, encoder.categorical)
        .join(foreign, "column", "left")
        .withColumn("n_out_of_domain", F.coalesce("n_out_of_domain", F.lit(0)))
    )


def write_synthetic(synth: DataFrame, encoder: EncoderState, path: str) -> DataFrame:
    """Check the column contract, write CSV, and return the check of what was written."""
    table = synth.select(*[f"`{c}`" for c in encoder.order])
    expect_columns(table, encoder.order)
    stored = materialize(table)
    write_csv(stored, path, "overwrite")
    return check_synthetic(stored, encoder)
