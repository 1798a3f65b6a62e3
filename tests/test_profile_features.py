import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import features, profile
from twinframe.operators.sampling import labelled_union


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(1, 2.0, "a", 10), (2, None, "b", 2), (3, float("nan"), None, 1), (4, float("inf"), "a", 2)],
        "id int, x double, c string, code int",
    )


def test_completeness_counts_null_nan_and_infinite(rows):
    got = {r["column"]: r["n_missing"] for r in profile.completeness(rows, ["x", "code"], ["c"]).collect()}
    assert got == {"x": 3, "code": 0, "c": 1}


def test_bounds_and_clip(spark):
    base = spark.createDataFrame([(1.0, 5), (3.0, 7)], "x double, y int")
    other = spark.createDataFrame([(0.0, 9), (2.0, 6), (None, 1)], "x double, y int")
    bounds = profile.numeric_bounds(base, ["x", "y"])
    got = profile.clip_columns(other, bounds, ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 7.0), (2.0, 6.0), (None, 5.0)]


def test_integer_codes_are_compared_as_text(rows):
    levels = profile.category_levels(rows, ["code"]).orderBy("idx").collect()
    assert [r["level"] for r in levels] == ["1", "10", "2"]
    assert [(r["below"], r["total"]) for r in levels] == [(0, 4), (1, 4), (2, 4)]


def test_out_of_domain_levels(spark, rows):
    levels = profile.level_counts(rows, ["c"])
    new = spark.createDataFrame([("a",), ("q",), ("q",), (None,)], "c string")
    assert [tuple(r) for r in profile.out_of_domain(new, levels, ["c"]).collect()] == [("c", "q", 2)]


def test_one_hot_width_is_shared_between_frames(spark):
    real = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    synth = spark.createDataFrame([(1, "b"), (2, "c"), (3, None)], "id int, c string")
    levels = features.level_list(real.unionByName(synth), ["c"])
    left, right = (features.one_hot(t, levels, ["id"]) for t in (real, synth))
    assert left.columns == right.columns == ["id", "c=None", "c=a", "c=b", "c=c"]
    assert [tuple(r) for r in right.orderBy("id").collect()] == [(1, 0, 0, 1, 0), (2, 0, 0, 0, 1), (3, 1, 0, 0, 0)]


def test_too_many_levels_for_one_hot_are_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_ONE_HOT", 5)
    with pytest.raises(ValueError):
        features.level_list(spark.range(10).select(F.col("id").cast("string").alias("c")), ["c"])


def test_ordinal_codes_of_unseen_levels(spark):
    pair = labelled_union(
        spark.createDataFrame([(1, "b"), (2, "a")], "id int, c string"),
        spark.createDataFrame([(3, "a"), (4, "zz")], "id int, c string"),
    )
    got = {r["id"]: r["c"] for r in features.ordinal_encode(pair, ["c"]).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: -1}


def test_mixed_vectors_are_standard_on_the_real_side(spark):
    rng = np.random.default_rng(0)
    make = lambda n, s: spark.createDataFrame(
        [(i, float(v), "abc"[i % 3], "k") for i, v in enumerate(rng.normal(s, 2, n))],
        "id int, x double, c string, one string",
    )
    pair = labelled_union(make(60, 0), make(40, 1))
    got = features.encode_mixed(pair, ["id"], ["x"], ["c", "one"]).where("side = 'real'").collect()
    z = np.array([r["z"] for r in got])
    np.testing.assert_allclose(z.mean(axis=0), 0, atol=1e-12)
    np.testing.assert_allclose(z.std(axis=0), [1, 1, 0], atol=1e-12)


def test_label_codes_cover_all_values(spark):
    rows = spark.createDataFrame([(1, "n"), (2, "m"), (3, "n")], "id int, y string")
    got = {r["id"]: r["label"] for r in features.label_encode(rows, "y").collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_nan_counts_as_null_in_standard_scores(spark):
    rows = [("real", float(v)) for v in (1, 2, 3)] + [("real", float("nan")), ("synth", 2.0), ("synth", None)]
    found = features.zscore(spark.createDataFrame(rows, "side string, v double"), ["v"])
    by_side = {"real": [], "synth": []}
    for row in found.collect():
        by_side[row["side"]].append(row["v"])
    assert sorted(v for v in by_side["real"] if v is not None) == pytest.approx([-1.5**0.5, 0, 1.5**0.5])
    assert by_side["real"].count(None) == 1 and by_side["synth"].count(None) == 1 and 0.0 in by_side["synth"]
