import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import diffusion
from twinframe.operators.diffusion import MixtureModel


@pytest.mark.parametrize("schedule", ["linear", "cosine"])
def test_schedules(spark, schedule):
    rows = diffusion.noise_schedule(spark, 50, schedule).orderBy("t").collect()
    beta, alpha_bar = diffusion.schedule_arrays(50, schedule)
    assert [r["t"] for r in rows] == list(range(50))
    np.testing.assert_allclose([r["beta"] for r in rows], beta, rtol=1e-10)
    np.testing.assert_allclose([r["alpha_bar"] for r in rows], alpha_bar, rtol=1e-9)
    np.testing.assert_allclose([r["alpha_bar"] for r in rows], np.cumprod(1 - beta), rtol=1e-9)
    assert all(r["sqrt_ab"] ** 2 + r["sqrt_omab"] ** 2 == pytest.approx(1) for r in rows)
    if schedule == "linear":
        assert rows[0]["beta"] == pytest.approx(1e-4) and rows[-1]["beta"] == pytest.approx(0.02)
    else:
        assert rows[-1]["beta"] == pytest.approx(0.999)


def test_unknown_schedule(spark):
    with pytest.raises(ValueError):
        diffusion.noise_schedule(spark, 10, "square")


def noised(spark, n=4000, d=3, steps=40):
    rows = spark.range(n).select("id", F.array(*[F.lit(float(i)) for i in range(d)]).alias("z"))
    return diffusion.forward_noise(diffusion.random_step(rows, ["id"], steps), ["id"], d, steps)


def test_noise_is_standard_and_mixes_with_the_level(spark):
    rows = noised(spark).collect()
    e = np.array([r["noise"] for r in rows])
    assert np.abs(e.mean(axis=0)).max() < 0.06 and np.abs(e.std(axis=0) - 1).max() < 0.05
    assert np.abs(np.corrcoef(e.T) - np.eye(3)).max() < 0.06
    _, alpha_bar = diffusion.schedule_arrays(40)
    for r in rows[:50]:
        a = alpha_bar[r["t"]]
        want = math.sqrt(a) * np.array(r["z"]) + math.sqrt(1 - a) * np.array(r["noise"])
        np.testing.assert_allclose(r["x_t"], want, atol=1e-9)
    assert {r["t"] for r in rows} == set(range(40))


def test_noise_does_not_depend_on_partitioning(spark):
    a = sorted(map(str, noised(spark, 60).select("id", "x_t").collect()))
    rows = spark.range(60).repartition(7).select("id", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("z"))
    b = diffusion.forward_noise(diffusion.random_step(rows, ["id"], 40), ["id"], 3, 40)
    assert sorted(map(str, b.select("id", "x_t").collect())) == a


def test_loss_and_row_weights(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 0.0], 2.0), ([0.0, 2.0], [0.0, 0.0], 0.5)],
        "noise array<double>, predicted array<double>, w double",
    )
    assert diffusion.denoise_loss(rows).first()["loss"] == pytest.approx((0.5 + 2.0) / 2)
    assert diffusion.denoise_loss(rows, weight="w").first()["loss"] == pytest.approx((1.0 + 1.0) / 2)


def target(d=4, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(d, d))
    cov = a @ a.T
    scale = np.sqrt(np.diag(cov))
    return cov / np.outer(scale, scale)


def test_one_component_recovers_the_moments(spark):
    r = target()
    x = np.random.default_rng(1).multivariate_normal(np.arange(4), r, 3000)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "z array<double>")
    model = diffusion.fit_generator(rows)
    cov = model.vectors[0] @ np.diag(model.values[0]) @ model.vectors[0].T
    np.testing.assert_allclose(cov, np.cov(x.T), atol=1e-4)
    np.testing.assert_allclose(model.means[0], x.mean(axis=0), atol=1e-9)


def test_predictor_beats_no_prediction_and_a_wrong_one(spark):
    model = MixtureModel.of([1.0], [np.zeros(3)], [target(3)])
    x = np.random.default_rng(2).multivariate_normal(np.zeros(3), target(3), 2000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>")
    seen = diffusion.forward_noise(diffusion.random_step(rows, ["id"]), ["id"], 3)
    loss = lambda m: diffusion.denoise_loss(diffusion.predict_noise(seen, m)).first()["loss"]
    wrong = MixtureModel.of([1.0], [np.full(3, 2.0)], [np.eye(3)])
    assert loss(model) < 0.9 * loss(wrong) and loss(model) < 1.0


@pytest.mark.parametrize("reverse", [True, False])
def test_samples_recover_a_two_component_mixture(spark, reverse):
    model = MixtureModel.of(
        [0.7, 0.3], [[-1.0, 0.0], [1.5, 0.5]], [0.3 * target(2), 0.2 * np.eye(2)]
    )
    if reverse:
        drawn = diffusion.reverse_sample(spark, model, 6000, steps=300, block=1500)
    else:
        drawn = diffusion.mixture_sample(spark, model, 6000, block=1500)
    z = np.array([r["z"] for r in drawn.collect()])
    want = model.draw(np.random.default_rng(9), 60000)
    np.testing.assert_allclose(z.mean(axis=0), want.mean(axis=0), atol=0.06)
    np.testing.assert_allclose(np.cov(z.T), np.cov(want.T), atol=0.08)
    grid = np.linspace(-3, 3, 61)
    for j in range(2):
        gap = np.abs((z[:, j, None] < grid).mean(0) - (want[:, j, None] < grid).mean(0)).max()
        assert gap < 0.035


def test_draws_depend_on_seed_and_block_only(spark):
    model = MixtureModel.of([1.0], [np.zeros(2)], [np.eye(2)])
    rows = lambda seed: sorted(
        map(str, diffusion.reverse_sample(spark, model, 100, steps=20, seed=seed, block=16).collect())
    )
    assert rows(1) == rows(1) != rows(2)
    assert diffusion.reverse_sample(spark, model, 100, steps=20, block=16).count() == 100


def test_mixture_fit_with_two_components(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-3, 1, (400, 2)), rng.normal(3, 0.5, (200, 2))])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "z array<double>")
    model = diffusion.fit_generator(rows, 2, seed=1)
    assert sorted(model.weights) == pytest.approx([1 / 3, 2 / 3], abs=0.05)


def test_weights_count_as_repeated_rows(spark):
    """Integer weights equal copies; weight zero, null and negative count nothing."""
    rng = np.random.default_rng(12)
    rows = [(rng.normal(size=3).tolist(), w) for w in [0, None, -2, *rng.integers(1, 5, 80).tolist()]]
    latents = spark.createDataFrame(rows, "z array<double>, w int").repartition(3)
    copies = np.array([z for z, w in rows for _ in range(max(w or 0, 0))])
    mean, covariance = diffusion.weighted_moments(latents, "w")
    assert np.allclose(mean, copies.mean(axis=0)) and np.allclose(covariance, np.cov(copies.T))
    model = diffusion.fit_generator(latents, weight="w")
    again = diffusion.fit_generator(spark.createDataFrame([(z.tolist(),) for z in copies], "z array<double>"))
    assert np.allclose(model.means, again.means) and np.allclose(model.values, again.values)
    scored = diffusion.log_likelihood(latents.where("w > 0"), model, "w").first()
    assert scored["log_likelihood"] == pytest.approx(model.log_density(copies).mean())
    with pytest.raises(ValueError):
        diffusion.weighted_moments(latents.where("w < 0"), "w")


def test_log_density_of_a_mixture():
    weights, means = np.array([0.3, 0.7]), np.array([[0.0, 1.0], [2.0, -1.0]])
    covariances = [np.array([[1.0, 0.5], [0.5, 2.0]]), np.eye(2) * 0.3]
    model = diffusion.MixtureModel.of(weights, means, covariances)
    x = np.random.default_rng(1).normal(size=(20, 2))
    dense = np.zeros(20)
    for w, m, c in zip(weights, means, covariances):
        c = c + diffusion.RIDGE * np.eye(2)
        off = x - m
        dense += w * np.exp(-0.5 * (off @ np.linalg.inv(c) * off).sum(1)) / np.sqrt(np.linalg.det(2 * np.pi * c))
    assert np.allclose(model.log_density(x), np.log(dense))


def test_held_out_rows_choose_the_components(spark):
    """Two far groups need two components."""
    rng = np.random.default_rng(3)
    apart = np.concatenate([rng.normal(-4, 0.4, (150, 2)), rng.normal(4, 0.4, (150, 2))])
    for points, want in ((apart, {2}),):
        rng.shuffle(points)
        frames = [spark.createDataFrame([(p.tolist(),) for p in part], "z array<double>").coalesce(1) for part in (points[:200], points[200:])]
        found = diffusion.choose_components(*frames, candidates=(2, 1)).collect()
        assert [r["components"] for r in found] == [1, 2] and all(r["n"] == 100 for r in found)
        best = [r["components"] for r in found if r["chosen"]]
        assert len(best) == 1 and best[0] in want
        assert best[0] == max(found, key=lambda r: r["log_likelihood"])["components"]


def test_one_noise_level_is_worked_out_once(monkeypatch):
    """A level's factors serve all rows, and a single component needs no likelihoods."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    covariances = [np.diag([0.5, 1.0, 1.5, 2.0]), np.eye(4)]
    two = MixtureModel.of([0.3, 0.7], rng.normal(size=(2, 4)), covariances)
    assert (two.predict_noise(x, 0.4) == two.predict_noise(x, np.full(50, 0.4))).all()
    assert two.predict_noise(x[:0], 0.4).shape == (0, 4)
    one = MixtureModel.of([1.0], two.means[:1], covariances[:1])
    sizes, log = [], np.log
    monkeypatch.setattr(diffusion.np, "log", lambda v: sizes.append(np.size(v)) or log(v))
    one.predict_noise(x, 0.4)
    assert not sizes
    two.predict_noise(x, 0.4)
    assert max(sizes) == 4
