from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import encoder
from twinframe.operators.encoder import EncoderState, decode, encode, fit_encoder
from twinframe.sources.views import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_NUMERIC

NORMAL = NormalDist()


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, c string")


def latents(frame, state, keep=("id",), **options):
    return {r["id"]: r["z"] for r in encode(frame, state, list(keep), **options).collect()}


def expected_scores(x, points=2000):
    """Average of interpolation from below and from above, ends at the limits."""
    n, m = len(x), min(len(x), points)
    refs, ranked = np.arange(m) / (m - 1), np.append(np.sort(x), np.max(x))
    # whole-number ranks: rounding must not tear tied references apart
    at, part = np.divmod(np.arange(m) * (n - 1), m - 1)
    q = ranked[at] + (ranked[at + 1] - ranked[at]) * (part / (m - 1))
    p = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    p = np.where(x > q[-1] - 1e-7, 1.0, p)
    p = np.where(x < q[0] + 1e-7, 0.0, p)
    z = np.array([NORMAL.inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) for v in p])
    z = np.clip(z, -4.5, 4.5)
    return (z - z.mean()) / (z.std() or 1.0)


@pytest.mark.parametrize("points", [2000, 30])
def test_numeric_latents_equal_the_two_sided_interpolation(spark, points):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(200) < 0.3, 0.0, np.round(rng.gamma(2, 50, 200)))
    frame = table(spark, [(i, float(v), "a") for i, v in enumerate(x)])
    state = fit_encoder(frame, ["x"], ["c"], points)
    found = latents(frame, state)
    np.testing.assert_allclose([found[i][0] for i in range(200)], expected_scores(x, points), atol=1e-9)


def test_a_spike_at_the_minimum_goes_to_the_lower_limit(spark):
    x = [0.0] * 30 + [float(v) for v in range(1, 31)]
    frame = table(spark, [(i, v, "a") for i, v in enumerate(x)])
    state = fit_encoder(frame, ["x"], ["c"])
    mean, scale = state.moments["x"]
    assert latents(frame, state)[0][0] * scale + mean == pytest.approx(-4.5)


def test_constant_column_has_zero_latents(spark):
    frame = table(spark, [(i, 7.0, "a") for i in range(10)])
    state = fit_encoder(frame, ["x"], ["c"])
    assert all(z == [0.0, 0.0] for z in latents(frame, state).values())
    back = decode(encode(frame, state, ["id"]), state, ["id"]).collect()
    assert {(r["x"], r["c"]) for r in back} == {(7, "a")}


@pytest.mark.parametrize("k,centers", [(1, [0.0]), (2, [-0.6745, 0.6745]), (6, [-1.383, -0.674, -0.210, 0.210, 0.674, 1.383])])
def test_level_centers(spark, k, centers):
    frame = table(spark, [(i, float(i), "abcdef"[i % k]) for i in range(12)])
    state = fit_encoder(frame, ["x"], ["c"])
    got = [r["center"] for r in state.levels.orderBy("idx").collect()]
    assert got == pytest.approx(centers, abs=1e-3)


def test_levels_sort_as_text_and_null_is_a_level(spark):
    frame = table(spark, [(0, 1.0, "10"), (1, 1.0, "2"), (2, 1.0, "1"), (3, 1.0, None)])
    state = fit_encoder(frame, ["x"], ["c"])
    assert [r["level"] for r in state.levels.orderBy("idx").collect()] == [None, "1", "10", "2"]
    back = decode(encode(frame, state, ["id"]), state, ["id"])
    assert {r["id"]: r["c"] for r in back.collect()} == {0: "10", 1: "2", 2: "1", 3: None}


def test_unseen_level_and_null_number_become_null(spark):
    frame = table(spark, [(i, float(i), "ab"[i % 2]) for i in range(10)])
    state = fit_encoder(frame, ["x"], ["c"])
    found = latents(table(spark, [(0, 3.0, "zzz"), (1, None, "a"), (2, 99.0, "a"), (3, -99.0, "a")]), state)
    assert found[0][1] is None and found[1][0] is None
    mean, scale = state.moments["x"]
    assert found[2][0] * scale + mean == pytest.approx(4.5)
    assert found[3][0] * scale + mean == pytest.approx(-4.5)


@pytest.mark.parametrize("small", [True, False])
def test_roundtrip_keeps_categories_and_nearly_numbers(spark, household, monkeypatch, small):
    """Also with a dictionary too large to broadcast, through the shuffled join."""
    monkeypatch.setattr(encoder.EncoderState, "small", lambda self, column: small)
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    for mode in ("centers", "cells"):
        z = encode(household, state, ["c_custkey"], mode, 42, ["c_custkey"])
        back = {r["c_custkey"]: r for r in decode(z, state, ["c_custkey"], mode).collect()}
        rows = household.collect()
        assert len(back) == len(rows)
        for row in rows:
            assert all(back[row["c_custkey"]][c] == row[c] for c in HOUSEHOLD_CATEGORICAL)
            assert abs(back[row["c_custkey"]]["n_orders"] - row["n_orders"]) <= 1


def test_roundtrip_report(spark, household):
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    rows = encoder.roundtrip_error(household, state, ["c_custkey"]).collect()
    assert {r["column"] for r in rows} == {*HOUSEHOLD_NUMERIC, *HOUSEHOLD_CATEGORICAL}
    assert all(r["n_changed"] == 0 for r in rows if r["column"] in HOUSEHOLD_CATEGORICAL)


def test_nearest_center_decoding_equals_argmin(spark):
    frame = table(spark, [(i, float(i), f"{i % 7}") for i in range(70)])
    state = fit_encoder(frame, ["x"], ["c"])
    centers = np.array([NORMAL.inv_cdf((i + 0.5) / 7) for i in range(7)])
    values = [*np.linspace(-6, 6, 241), *((centers[1:] + centers[:-1]) / 2)]
    z = spark.createDataFrame([(i, [0.0, float(v)]) for i, v in enumerate(values)], "id long, z array<double>")
    got = {r["id"]: r["c"] for r in decode(z, state, ["id"]).collect()}
    for i, v in enumerate(values):
        gap = np.abs(v - centers)
        best = np.flatnonzero(gap <= gap.min() + 1e-12)
        assert int(got[i]) in best


def test_saved_state_gives_the_same_output(spark, household, tmp_path):
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL, order=household.columns[1:])
    state.save(str(tmp_path))
    again = EncoderState.load(spark, str(tmp_path))
    assert again.order == state.order
    first, second = (
        sorted(map(str, encode(household, s, ["c_custkey"]).collect())) for s in (state, again)
    )
    assert first == second
    columns = decode(encode(household, again, ["c_custkey"]), again).columns
    assert columns == household.columns[1:]


def test_cell_latents_are_normal_without_atoms(spark, household):
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    z = np.array([r["z"] for r in encode(household, state, ["c_custkey"], "cells", 1, ["c_custkey"]).collect()])
    assert np.abs(z.mean(axis=0)).max() < 0.2 and np.abs(z.std(axis=0) - 1).max() < 0.2
    assert all(len(np.unique(z[:, j])) == len(z) for j in range(5, 8))


def test_modes_are_checked(spark, household):
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    with pytest.raises(ValueError):
        encode(household, state, mode="other")
    with pytest.raises(ValueError):
        encode(household, state, mode="cells")


def test_encoding_is_a_narrow_plan(spark, household):
    """Nothing of the table itself is shuffled when the dictionary is small."""
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    encoded = encode(household, state, ["c_custkey"])
    assert "Exchange hashpartitioning" not in encoded._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["centers", "cells"])
def test_decoding_needs_no_python_worker(spark, household, mode):
    state = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    latents_ = spark.range(5).selectExpr("id", f"array_repeat(0.1D * id, {state.width}) AS z")
    text = decode(latents_, state, ["id"], mode)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_decoded_numbers_equal_the_interpolated_references(spark):
    """Also across spikes, beyond both ends and for missing latents."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random(300) < 0.4, 50.0, np.round(rng.gamma(2, 5000, 300)))
    frame = table(spark, [(i, float(v), "a") for i, v in enumerate(x)])
    state = fit_encoder(frame, ["x"], ["c"], 120)
    z = [*np.linspace(-6, 6, 400).tolist(), float("nan"), None]
    rows = spark.createDataFrame([(i, [v, 0.0]) for i, v in enumerate(z)], "id long, z array<double>")
    got = {r["id"]: r["x"] for r in decode(rows, state, ["id"], "cells").collect()}
    at, part = np.divmod(np.arange(120) * 299, 119)
    ranked = np.append(np.sort(x), np.max(x))
    references = ranked[at] + (ranked[at + 1] - ranked[at]) * (part / 119)
    for i, v in enumerate(z[:-2]):
        p = NORMAL.cdf(min(max(v, -4.5), 4.5))
        assert abs(got[i] - np.interp(p, np.arange(120) / 119, references)) <= 0.5 + 1e-6
    assert got[400] is None and got[401] is None


def test_a_column_without_numbers_encodes_and_decodes_to_null(spark):
    frame = table(spark, [(i, None, "ab"[i % 2]) for i in range(6)])
    state = fit_encoder(frame, ["x"], ["c"])
    encoded = encode(frame, state, ["id"])
    assert all(r["z"][0] is None for r in encoded.collect())
    assert {(r["x"], r["c"]) for r in decode(encoded, state, ["id"]).collect()} == {(None, "a"), (None, "b")}
    some = spark.createDataFrame([(1, [0.3, 0.0])], "id long, z array<double>")
    assert decode(some, state, ["id"]).first()["x"] is None


def test_cells_of_many_levels_take_a_slice_each(spark):
    """One level in a third of the rows beside 900 rare ones; every value decodes to the level whose share holds it."""
    levels = ["hot"] * 450 + [f"r{i:03d}" for i in range(900)]
    frame = table(spark, [(i, 1.0, c) for i, c in enumerate(levels)])
    state = fit_encoder(frame, ["x"], ["c"])
    ordered, n = sorted(levels), len(levels)
    # off the borders of the cells
    p = [(i + 0.5) / n for i in range(0, n, 3)]
    rows = spark.createDataFrame([(i, [0.0, NORMAL.inv_cdf(q)]) for i, q in enumerate(p)], "id long, z array<double>")
    decoded = decode(rows, state, ["id"], "cells")
    got = {r["id"]: r["c"] for r in decoded.collect()}
    assert [got[i] for i in range(len(p))] == [ordered[int(q * n)] for q in p]
    assert decoded.count() == len(p)
