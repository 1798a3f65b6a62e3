import numpy as np
import pytest

from twinframe.operators import sketches
from twinframe.operators.encoder import decode, encode, fit_encoder
from twinframe.sources.views import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_NUMERIC


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else float(v), "ab"[i % 2]) for i, v in enumerate(x)], "id long, x double, c string")


def brute_error(x, grid):
    x = np.array([v for v in x if v is not None and v == v])
    return max(
        max(r["p_max"] - (x <= r["value"]).mean(), (x < r["value"]).mean() - r["p_min"], 0.0) for r in grid.collect()
    )


def test_merged_sketches_keep_the_rank_error(spark):
    """A spike in a third of the rows, nulls and NaN, two batches of unequal size."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random(30_000) < 0.34, 7.0, rng.gamma(2, 100, 30_000)).tolist()
    x[5], x[6] = None, float("nan")
    parts = [sketches.sketch_encoder(table(spark, p), ["x"], ["c"]) for p in (x[:4000], x[4000:])]
    merged = parts[0].merged(parts[1])
    grid = merged.grid()
    row = sketches.rank_errors(table(spark, x), ["x"], grid).first()
    assert row["n_rows"] == 29_998 and row["rank_error"] <= sketches.RANK_ERROR
    assert row["rank_error"] == pytest.approx(brute_error(x, grid), abs=1e-12)
    known = [v for v in x if v is not None and v == v]
    ends = [r["value"] for r in grid.orderBy("value").collect()]
    assert (ends[0], ends[-1]) == (min(known), max(known))
    assert {(r["level"], r["n"]) for r in merged.levels.collect()} == {("a", 15_000), ("b", 15_000)}


def test_a_wrong_grid_is_measured_as_wrong(spark):
    x = [1.0] * 10 + [2.0] * 30 + [3.0] * 60
    grid = spark.createDataFrame([("x", 1.0, 0.0, 0.3), ("x", 2.5, 0.5, 0.5), ("x", 9.0, 1.0, 1.0)], "column string, value double, p_min double, p_max double")
    found = sketches.rank_errors(table(spark, x), ["x"], grid).first()
    assert found["rank_error"] == pytest.approx(brute_error(x, grid)) and found["rank_error"] == pytest.approx(0.2)


def test_saved_sketch_goes_on_and_encodes_nearly_as_the_exact_state(spark, household, tmp_path):
    one, two = (household.where(f"c_custkey {sign} 75") for sign in ("<=", ">"))
    sketches.sketch_encoder(one, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL).save(str(tmp_path))
    loaded = sketches.EncoderSketch.load(spark, str(tmp_path))
    assert loaded.numeric == HOUSEHOLD_NUMERIC and loaded.categorical == HOUSEHOLD_CATEGORICAL
    state = loaded.merged(sketches.sketch_encoder(two, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)).state()
    exact = fit_encoder(household, HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL)
    near, want = ({r["c_custkey"]: r["z"] for r in encode(household, s, ["c_custkey"]).collect()} for s in (state, exact))
    assert max(abs(a - b) for i in want for a, b in zip(near[i], want[i])) < 0.1
    back = {r["c_custkey"]: r for r in decode(encode(household, state, ["c_custkey"]), state, ["c_custkey"]).collect()}
    assert all(back[r["c_custkey"]][c] == r[c] for r in household.collect() for c in HOUSEHOLD_CATEGORICAL)


def test_a_column_without_numbers(spark):
    empty = sketches.sketch_encoder(table(spark, [None, None]), ["x"], ["c"])
    full = sketches.sketch_encoder(table(spark, [1.0, 2.0]), ["x"], ["c"])
    assert empty.grid().count() == 0
    assert [r["z"][0] for r in encode(table(spark, [5.0]), empty.state(), ["id"]).collect()] == [None]
    assert sorted(r["value"] for r in empty.merged(full).grid().collect()) == [1.0, 2.0]
