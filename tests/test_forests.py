import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from twinframe.operators import forests
from twinframe.plans import evaluate


def table(spark, n=3000):
    """Two numbers (one with a null's stand-in, one of few values) and two 0/1 features; classes 0..2 and a value."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 97 == 0, -1.7976931348623157e308).otherwise(F.rand(1) * 10).alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        (F.col("id") % 2).cast("double").alias("c"),
        (F.col("id") % 3 == 0).cast("double").alias("d"),
        F.rand(2).alias("noise"),
    )
    label = F.when(F.col("a") < 3, 0.0).when(F.col("b") + F.col("c") * 3 > 5, 1.0).otherwise(2.0)
    value = 1e6 + F.greatest(F.col("a"), F.lit(-5.0)) * 20 + F.col("b") * F.col("c") * 5 + F.col("noise")
    coded = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(
        rows.withColumns({"label": F.when(F.col("noise") < 0.9, label).otherwise(F.floor(F.col("noise") * 30) % 3 * 1.0), "value": value})
    )
    return coded.repartition(5).localCheckpoint()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(forests, "BLOCK_ROWS", 256)
    monkeypatch.setattr(forests, "SHARE_ROWS", 1000)
    monkeypatch.setattr(forests, "LEVEL_TASKS", 8)


@pytest.mark.parametrize("target", ["label", "value"])
def test_scores_are_those_of_spark_ml(spark, monkeypatch, target):
    rows = table(spark).withColumn("y", F.col(target))
    error = F.avg((F.col("y") != F.col("prediction")).cast("double")) if target == "label" else F.avg(F.abs(F.col("y") - F.col("prediction")))
    train, test = rows.where("noise * 1000 % 10 < 7"), rows.where("noise * 1000 % 10 >= 7")
    found = {}
    for least in (0, 10**9):
        monkeypatch.setattr(evaluate, "FOREST_ROWS", least)
        model = evaluate._forest(train, 2, target == "label", 25, 3)
        assert isinstance(model, forests.Forest) == (least == 0)
        found[least] = model.transform(test).agg(error).first()[0]
    assert found[0] == pytest.approx(found[10**9], rel=0.35, abs=0.02)


def test_votes_are_the_leaf_shares_of_all_trees(spark):
    rows = table(spark, 1200).withColumn("y", F.col("label"))
    forest = forests.grow(rows, 2, 3, 6, 4, 9)
    found = forest.transform(rows).select("a", "b", "c", "d", "prediction", "probability").collect()
    for r in found[::50]:
        x, votes = [r["a"], r["b"], r["c"], r["d"]], np.zeros(3)
        for t in range(6):
            node = 0
            for _ in range(4):
                end, cuts = forest.ends[t, node], forest.cuts[forest.features[t, node]]
                node = 2 * node + 1 + int(end < len(cuts) and x[forest.features[t, node]] > cuts[end])
            votes += forest.leaves[t, node - 15] / 6
        np.testing.assert_allclose(r["probability"].toArray(), votes, atol=1e-12)
        assert votes.sum() == pytest.approx(1) and r["prediction"] == votes.argmax()


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_is_that_of_all_copies_of_its_rows(spark, monkeypatch, classes):
    """Every node of a tree grown over many blocks and tasks, against one search over all its rows."""
    monkeypatch.setattr(forests, "_merge", lambda *tree: None)
    rows = table(spark, 1500).withColumn("y", F.col("label" if classes else "value"))
    forest = forests.grow(rows, 2, classes, 2, 3, 5)
    x = rows.select(F.col("y"), forests.vector_to_array("features").alias("x"))
    blocks = forests._blocks(x, forests._cuts(x, 4, 2), 2).collect()
    assert len(blocks) > 5 and sum(b["n"] for b in blocks) == 1500
    bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(4, -1) for b in blocks], axis=1)
    y = np.concatenate([np.frombuffer(b["y"]) for b in blocks])
    m = 2
    for t in range(2):
        times = np.concatenate([forests._copies(5, t, b["block"], b["n"]) for b in blocks]).astype(float)

        def impurity(kept):
            w = times[kept]
            if classes:
                share = np.bincount(y[kept].astype(int), w, 3) / w.sum()
                return w.sum() * (1 - (share**2).sum())
            mean = (w * y[kept]).sum() / w.sum()
            return (w * (y[kept] - mean) ** 2).sum()

        def check(node, kept, level):
            if level == 3:
                leaf = forest.leaves[t, node - 7]
                want = np.bincount(y[kept].astype(int), times[kept], 3) / times[kept].sum() if classes else [(times * y)[kept].sum() / times[kept].sum()]
                return np.testing.assert_allclose(leaf, want, rtol=1e-9)
            best = []
            for f in forests._chosen(5, t, level, 4, m)[node - (2**level - 1)]:
                for end in range(31):
                    left = kept & (bins[f] <= end)
                    right = kept & (bins[f] > end)
                    if times[left].sum() and times[right].sum():
                        best.append(impurity(kept) - impurity(left) - impurity(right))
            f, end = forest.features[t, node], forest.ends[t, node]
            left, right = kept & (bins[f] <= end), kept & (bins[f] > end)
            if end == forests.BINS:
                assert not best or max(best) <= 1e-6 * max(impurity(kept), 1)
                return check(2 * node + 1, kept, level + 1)
            assert impurity(kept) - impurity(left) - impurity(right) == pytest.approx(max(best), rel=1e-6)
            check(2 * node + 1, left, level + 1)
            check(2 * node + 2, right, level + 1)

        check(0, np.ones(1500, bool), 0)


def test_copies_are_poisson_and_belong_to_tree_and_block():
    found = forests._copies(42, 7, 3, 200_000)
    shares = np.bincount(found) / len(found)
    assert shares[:4] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.005)
    assert found.max() >= 6 and abs(found.mean() - 1) < 0.01 and abs(found.var() - 1) < 0.02
    assert np.array_equal(found, forests._copies(42, 7, 3, 200_000))
    for other in ((42, 8, 3), (42, 7, 4), (43, 7, 3)):
        assert abs(np.corrcoef(found, forests._copies(*other, 200_000))[0, 1]) < 0.02


def test_one_class_or_value_makes_leaves_only(spark):
    rows = table(spark, 600).withColumn("y", F.lit(1.0))
    for classes in (2, 0):
        forest = forests.grow(rows, 2, classes, 3, 6, 1)
        assert (forest.ends == forests.BINS).all()
        assert {r["prediction"] for r in forest.transform(rows).collect()} == {1.0}


def test_sibling_leaves_of_one_class_are_merged():
    ends = np.array([[4, 5, 6]], np.uint8)
    features = np.array([[0, 1, 2]])
    found = np.zeros((1, 7, 2))
    found[0] = [[9, 6], [8, 1], [1, 5], [3, 1], [5, 0], [1, 2], [0, 3]]
    forests._merge(features, ends, found)
    assert ends.tolist() == [[4, forests.BINS, forests.BINS]] and features.tolist() == [[0, 0, 0]]
    found[0, 2] = [4, 2]
    forests._merge(features, ends, found)
    assert ends.tolist() == [[forests.BINS] * 3]


def test_unknown_values_are_refused(spark):
    rows = table(spark, 300)
    for missing in (None, float("nan")):
        with pytest.raises(ValueError):
            forests.grow(rows.withColumn("y", F.when(F.col("b") > 0, F.col("value")).otherwise(F.lit(missing).cast("double"))), 2, 0, 2, 2, 1)


def test_wide_rows_stay_with_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FOREST_ROWS", 0)
    monkeypatch.setattr(evaluate, "FOREST_WIDTH", 3)
    model = evaluate._forest(table(spark, 300).withColumn("y", F.col("value")), 2, False, 2, 1)
    assert isinstance(model, RandomForestRegressionModel)
