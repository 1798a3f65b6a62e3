"""Denoising diffusion over latent tables, with a closed-form Gaussian-mixture denoiser.

The data operations (schedule, noising, loss, reverse process) are those of a
denoising diffusion model.  The noise predictor is the exact minimiser of the loss
for a Gaussian mixture fitted to the latent rows, so nothing is trained in Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinframe.functions.normal import with_probit
from twinframe.functions.scalars import clip, hash_key, hash_number, hash_uniform

# Fixed values of the noise schedules.
LINEAR_BETA = (1e-4, 0.02)
COSINE_OFFSET = 0.008
COSINE_BETA = (1e-6, 0.999)

STEPS = 1000
SAMPLE_LIMIT = 6.0

#: Rows drawn together by one random stream.
DRAW_BLOCK = 4096
RIDGE = 1e-6

#: Numbers of components that are tried on held-out rows.
CANDIDATES = (1, 2, 4, 8)


def noise_schedule(spark: SparkSession, steps: int = STEPS, schedule: str = "cosine") -> DataFrame:
    """``(t, beta, alpha, alpha_bar, sqrt_ab, sqrt_omab)`` for t = 0..steps-1."""
    t = F.col("t").cast("double")
    if schedule == "linear":
        low, high = LINEAR_BETA
        beta = F.lit(low) + (high - low) * t / F.lit(float(max(steps - 1, 1)))
    elif schedule == "cosine":
        def level(x: Column) -> Column:
            angle = (x / F.lit(float(steps)) + COSINE_OFFSET) / (1 + COSINE_OFFSET)
            return F.pow(F.cos(angle * F.lit(np.pi / 2)), F.lit(2.0))

        beta = clip(1 - level(t + 1) / level(t), *COSINE_BETA)
    else:
        raise ValueError(f"unknown schedule {schedule!r}")
    # the table has one row per step, so an ordered window over all of it is small
    product = F.exp(F.sum(F.log("alpha")).over(Window.orderBy("t")))
    return (
        spark.range(steps)
        .select(F.col("id").alias("t"))
        .withColumn("beta", beta)
        .withColumn("alpha", 1 - F.col("beta"))
        .withColumn("alpha_bar", product)
        .withColumns(
            {"sqrt_ab": F.sqrt("alpha_bar"), "sqrt_omab": F.sqrt(1 - F.col("alpha_bar"))}
        )
    )


def schedule_arrays(steps: int = STEPS, schedule: str = "cosine") -> tuple[np.ndarray, np.ndarray]:
    """(beta, alpha_bar) for tasks that walk the whole schedule."""
    t = np.arange(steps, dtype=float)
    if schedule == "linear":
        beta = np.linspace(*LINEAR_BETA, steps)
    elif schedule == "cosine":
        level = lambda x: np.cos((x / steps + COSINE_OFFSET) / (1 + COSINE_OFFSET) * np.pi / 2) ** 2
        beta = np.clip(1 - level(t + 1) / level(t), *COSINE_BETA)
    else:
        raise ValueError(f"unknown schedule {schedule!r}")
    return beta, np.exp(np.cumsum(np.log1p(-beta)))


def random_step(rows: DataFrame, ids: Sequence[str], steps: int = STEPS, seed: int = 42) -> DataFrame:
    """Add ``t``, a uniform step 0..steps-1 that depends on the row id alone."""
    number = hash_number(hash_key(seed, [*ids, F.lit("t")]))
    return rows.withColumn("t", F.pmod(number, F.lit(steps)).cast("long"))


def forward_noise(
    rows: DataFrame,
    ids: Sequence[str],
    width: int,
    steps: int = STEPS,
    schedule: str = "cosine",
    seed: int = 42,
) -> DataFrame:
    """Noise the latent array ``z`` at its step ``t``: adds ``noise`` and ``x_t``.

    Noise is a normal quantile of a hash of (seed, row, dimension).  The schedule is
    broadcast: it has one row per step.
    """
    index = range(width)
    uniform = {f"_u{i}": hash_uniform(hash_key(seed, [*ids, F.lit(i)])) for i in index}
    drawn = with_probit(rows.withColumns(uniform), {f"_e{i}": f"_u{i}" for i in index})
    table = noise_schedule(rows.sparkSession, steps, schedule).select("t", "sqrt_ab", "sqrt_omab")
    joined = (
        drawn.withColumn("noise", F.array(*[F.col(f"_e{i}") for i in index]))
        .drop(*uniform, *[f"_e{i}" for i in index])
        .join(F.broadcast(table), "t")
    )
    mixed = F.zip_with(
        "z", "noise", lambda z, e: F.col("sqrt_ab") * z + F.col("sqrt_omab") * e
    )
    return joined.withColumn("x_t", mixed)


def denoise_loss(
    rows: DataFrame, noise: str = "noise", predicted: str = "predicted", weight: str | None = None
) -> DataFrame:
    """``(loss)``: mean over rows of the mean squared error per dimension.

    Row weights multiply the error; their sum does not divide it.
    """
    squares = F.zip_with(noise, predicted, lambda a, b: (a - b) * (a - b))
    error = F.aggregate(squares, F.lit(0.0), lambda t, x: t + x) / F.size(noise)
    return rows.agg(F.avg(error * F.col(weight) if weight else error).alias("loss"))


@dataclass(frozen=True)
class MixtureModel:
    """Component weights, means and eigen-decomposed covariances; k * d * d numbers."""

    weights: np.ndarray
    means: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return self.means.shape[1]

    @classmethod
    def of(cls, weights, means, covariances) -> MixtureModel:
        kept = [i for i, w in enumerate(weights) if w > 1e-9]
        weights = np.asarray(weights, float)[kept]
        parts = [
            np.linalg.eigh(np.asarray(covariances[i], float) + RIDGE * np.eye(len(means[i])))
            for i in kept
        ]
        return cls(
            weights / weights.sum(),
            np.asarray(means, float)[kept],
            np.maximum(np.array([v for v, _ in parts]), RIDGE),
            np.array([q for _, q in parts]),
        )

    def predict_noise(self, x: np.ndarray, alpha_bar) -> np.ndarray:
        """Expected noise in rows ``x`` at noise level ``alpha_bar`` (scalar or per row)."""
        # one row of factors serves all rows of one noise level
        a = np.asarray(alpha_bar, float).reshape(-1, 1)
        logs, guesses = [], []
        for weight, mean, values, vectors in zip(
            self.weights, self.means, self.values, self.vectors
        ):
            spread = a * values + (1 - a)
            turned = (x - np.sqrt(a) * mean) @ vectors
            scaled = turned / spread
            guesses.append(np.sqrt(1 - a) * (scaled @ vectors.T))
            if len(self.weights) == 1:
                return guesses[0]
            logs.append(np.log(weight) - 0.5 * (np.log(spread) + turned * scaled).sum(axis=1))
        logs = np.array(logs)
        share = np.exp(logs - logs.max(axis=0))
        share /= share.sum(axis=0)
        return sum(s[:, None] * g for s, g in zip(share, guesses))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of the mixture's density at every row of ``x``."""
        logs = []
        for weight, mean, values, vectors in zip(self.weights, self.means, self.values, self.vectors):
            turned = (x - mean) @ vectors
            square = (turned * turned / values).sum(axis=1)
            logs.append(np.log(weight) - 0.5 * (square + np.log(2 * np.pi * values).sum()))
        logs = np.array(logs)
        top = logs.max(axis=0)
        return top + np.log(np.exp(logs - top).sum(axis=0))

    def draw(self, random: np.random.Generator, n: int) -> np.ndarray:
        component = random.choice(len(self.weights), size=n, p=self.weights)
        noise = random.standard_normal((n, self.width)) * np.sqrt(self.values[component])
        return self.means[component] + np.einsum("nij,nj->ni", self.vectors[component], noise)


def weighted_moments(latents: DataFrame, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of the arrays ``z``; a row of weight w counts as w equal rows.

    Two passes: the mean, then products about it. A task adds up its own rows, so what
    moves is one matrix per task; rows of null or no weight count nothing.
    """
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = latents.select("z", times.alias("_w")).where("_w > 0")

    def total(shape, part) -> np.ndarray:
        """Sum of ``part(z, w)`` over all rows, its last entry the weight."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros(int(np.prod(shape)) + 1)
            for batch in batches:
                if len(batch):
                    w = batch["_w"].to_numpy(float)
                    held += np.append(part(np.stack(batch["z"].to_numpy()), w).ravel(), w.sum())
            yield pd.DataFrame({"place": np.arange(len(held)), "part": held})

        sums = rows.mapInPandas(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
        return sums.orderBy("place").toPandas()["part"].to_numpy(float)

    width = rows.agg(F.max(F.size("z"))).first()[0]
    if not width:
        raise ValueError("no rows of positive weight to fit to")
    found = total((width,), lambda z, w: w @ z)
    mean = found[:-1] / found[-1]
    found = total((width, width), lambda z, w: ((z - mean) * w[:, None]).T @ (z - mean))
    return mean, found[:-1].reshape(width, width) / max(found[-1] - 1.0, 1.0)


def fit_generator(latents: DataFrame, components: int = 1, seed: int = 42, weight: str | None = None) -> MixtureModel:
    """Fit the mixture to latent arrays ``z`` with Spark ML.

    One component is the mean and covariance, two passes of tree aggregation.
    ``weight`` names a column of row weights; integer weights count as repeated rows.
    """
    if components == 1 and weight:
        mean, covariance = weighted_moments(latents, weight)
        return MixtureModel.of([1.0], [mean], [covariance])
    weights = [F.col(weight).cast("double").alias("weight")] if weight else []
    rows = latents.select(array_to_vector("z").alias("features"), *weights)
    if components == 1:
        found = rows.select(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s"))
        summary = found.select("s.mean", "s.std").first()
        mean, std = summary["mean"].toArray(), summary["std"].toArray()
        r = np.nan_to_num(Correlation.corr(rows, "features").first()[0].toArray())
        np.fill_diagonal(r, 1.0)
        return MixtureModel.of([1.0], [mean], [r * np.outer(std, std)])
    mixture = GaussianMixture(k=components, seed=seed, featuresCol="features")
    if weight:
        mixture, rows = mixture.setWeightCol("weight"), rows.where("weight > 0")
    model = mixture.fit(rows)
    shapes = model.gaussians
    return MixtureModel.of(
        model.weights,
        [g.mean.toArray() for g in shapes],
        [g.cov.toArray() for g in model.gaussiansDF.select("cov").collect()],
    )


def log_likelihood(latents: DataFrame, model: MixtureModel, weight: str | None = None) -> DataFrame:
    """``(n, log_likelihood)``: rows, and the (weighted) mean log-density of their arrays ``z``."""

    @F.pandas_udf("double")
    def density(z: pd.Series) -> pd.Series:
        return pd.Series(model.log_density(np.stack(z.to_numpy())) if len(z) else [], dtype=float)

    scored = latents.withColumn("_log", density("z"))
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("_log") * times), F.sum(times)).alias("log_likelihood"))


def choose_components(
    train: DataFrame, held: DataFrame, candidates: Sequence[int] = CANDIDATES, seed: int = 42, weight: str | None = None
) -> DataFrame:
    """``(components, n, log_likelihood, chosen)``: mixtures fitted to ``train``, judged on ``held``.

    The one of highest held-out log-likelihood is chosen, of equal ones the smallest;
    without held-out rows the smallest of all.
    """
    found = []
    for components in sorted(candidates):
        n, score = log_likelihood(held, fit_generator(train, components, seed, weight), weight).first()
        found.append((components, n, score))
    best = max(found, key=lambda f: (f[2] if f[2] is not None else float("-inf"), -f[0]))
    rows = [(*f, f[0] == best[0]) for f in found]
    return train.sparkSession.createDataFrame(rows, "components int, n long, log_likelihood double, chosen boolean")


def predict_noise(
    rows: DataFrame, model: MixtureModel, steps: int = STEPS, schedule: str = "cosine"
) -> DataFrame:
    """Add ``predicted``, the model's noise for ``x_t`` at step ``t``."""
    alpha_bar = schedule_arrays(steps, schedule)[1]

    @F.pandas_udf("array<double>")
    def predict(x: pd.Series, t: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(model.predict_noise(np.stack(x.to_numpy()), alpha_bar[t.to_numpy()])))

    return rows.withColumn("predicted", predict("x_t", "t"))


def loss_by_step(noised: DataFrame, bands: int = 10, steps: int = STEPS) -> DataFrame:
    """``(band, n, loss)``: the denoising loss in equal bands of the schedule."""
    squares = F.zip_with("noise", "predicted", lambda a, b: (a - b) * (a - b))
    error = F.aggregate(squares, F.lit(0.0), lambda t, x: t + x) / F.size("noise")
    band = F.floor(F.col("t") * bands / F.lit(float(steps))).alias("band")
    return noised.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("loss"))


def _draw_blocks(spark: SparkSession, n: int, block: int, draw) -> DataFrame:
    """``(row_id, z)`` from ``draw(block number, rows)``, one task input row per block.

    Each block has its own random stream, so neither the number of tasks nor a
    repeated task changes the rows, and nothing is shuffled.
    """
    blocks = -(-n // block)
    # about one block per task, up to what the driver schedules comfortably
    tasks = max(1, min(blocks, 50_000))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                start = number * block
                z = draw(int(number), min(block, n - start))
                yield pd.DataFrame({"row_id": np.arange(start, start + len(z)), "z": list(z)})

    return spark.range(0, blocks, 1, tasks).mapInPandas(rows, "row_id bigint, z array<double>")


def _stream(seed: int, block: int, purpose: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, (purpose << 48) + block]))


def reverse_sample(
    spark: SparkSession,
    model: MixtureModel,
    n: int,
    steps: int = STEPS,
    schedule: str = "cosine",
    seed: int = 42,
    block: int = DRAW_BLOCK,
) -> DataFrame:
    """``(row_id, z)``: n rows by the reverse process, noise to data in ``steps`` steps."""
    beta, alpha_bar = schedule_arrays(steps, schedule)

    def draw(number: int, size: int) -> np.ndarray:
        random = _stream(seed, number, 1)
        x = random.standard_normal((size, model.width))
        drawn = np.empty_like(x)
        for t in range(steps - 1, -1, -1):
            noise = model.predict_noise(x, alpha_bar[t])
            noise *= beta[t] / np.sqrt(1 - alpha_bar[t])
            x -= noise
            x /= np.sqrt(1 - beta[t])
            if t > 0:
                random.standard_normal(out=drawn)
                drawn *= np.sqrt(beta[t])
                x += drawn
            np.clip(x, -SAMPLE_LIMIT, SAMPLE_LIMIT, out=x)
        return x

    return _draw_blocks(spark, n, block, draw)


def mixture_sample(
    spark: SparkSession, model: MixtureModel, n: int, seed: int = 42, block: int = DRAW_BLOCK
) -> DataFrame:
    """``(row_id, z)``: n rows straight from the mixture, without the reverse process."""
    return _draw_blocks(spark, n, block, lambda b, size: model.draw(_stream(seed, b, 2), size))


def independent_sample(spark: SparkSession, width: int, n: int, seed: int = 42) -> DataFrame:
    """``(row_id, z)``: standard normals, so decoding keeps marginals and drops dependence."""
    index = range(width)
    rows = spark.range(n).select(F.col("id").alias("row_id"))
    uniform = {f"_u{i}": hash_uniform(hash_key(seed, ["row_id", F.lit(i)])) for i in index}
    drawn = with_probit(rows.withColumns(uniform), {f"_e{i}": f"_u{i}" for i in index})
    return drawn.select("row_id", F.array(*[F.col(f"_e{i}") for i in index]).alias("z"))
