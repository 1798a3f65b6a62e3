import numpy as np
import pytest

from twinframe.operators import scores


def test_accuracy_and_macro_f1(spark):
    # class c is only predicted and class d only present: both score 0
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("d", "c")]
    got = scores.classification_metrics(spark.createDataFrame(rows, "y string, yhat string")).first()
    assert got["accuracy"] == 0.5
    assert got["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)


def test_auc_keeps_a_null_group(spark):
    rows = [(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.7)]
    got = scores.roc_auc(spark.createDataFrame(rows, "g string, y int, score double"), by=["g"]).collect()
    assert {r["g"]: r["auc"] for r in got} == {None: 1.0, "a": 0.0}


def test_auc_counts_pairs_with_ties_at_half(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 150), rng.integers(0, 9, 150) / 4.0
    rows = [(int(a), float(b)) for a, b in zip(y, s)]
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    want = ((gap > 0) + 0.5 * (gap == 0)).mean()
    got = scores.roc_auc(spark.createDataFrame(rows, "y int, score double")).first()["auc"]
    assert got == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert scores.roc_auc(rows).first()["auc"] is None


def test_regression_scores(spark):
    rows = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, yhat double")
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 2, 3])
    got = scores.regression_metrics(rows).first()
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_constant_target_has_no_r2(spark):
    rows = spark.createDataFrame([(1.0, 1.5), (1.0, 2.0)], "y double, yhat double")
    assert scores.regression_metrics(rows).first()["r2"] is None


def test_seed_summary_uses_population_deviation(spark):
    rows = spark.createDataFrame(
        [("m", "acc", 1.0), ("m", "acc", 2.0), ("m", "acc", 4.0)], "method string, metric string, value double"
    )
    got = scores.seed_summary(rows).first()
    assert got["std"] == pytest.approx(np.std([1, 2, 4]))
