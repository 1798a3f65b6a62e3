"""Approximate neighbours against brute force."""

import numpy as np
import pytest

from tests.test_neighbors import brute, cloud, pair_of
from twinframe.operators import approx_neighbors, neighbors


def measured_recall(got, d, k):
    """Share of true neighbours among the rows, equally distant ones being as good."""
    kth = np.sort(d, axis=1)[:, k - 1]
    return sum(r["dist"] <= kth[r["id"]] * (1 + 1e-12) for r in got) / (len(d) * k)


@pytest.mark.parametrize("n,d,bucket,copies", [(1200, 24, 60, True)])
def test_recall_is_what_it_says(spark, n, d, bucket, copies):
    points, sides = cloud(3, n, d, copies)
    away, _ = brute(points, sides, 4)
    got = approx_neighbors.knn_approx(pair_of(spark, points, sides), "id", 4, bucket=bucket).collect()
    assert len(got) == n * 4 and got[0]["tables"] in (4, 8, 16, 32)
    true = measured_recall(got, away, 4)
    assert true >= 0.9 and got[0]["recall"] >= 0.9 and abs(true - got[0]["recall"]) < 0.06
    for r in got[::97]:
        assert r["dist"] == pytest.approx(np.linalg.norm(points[r["id"]] - points[r["neighbor"]]), abs=1e-9)
        assert r["same_side"] == (sides[r["neighbor"]] == sides[r["id"]])
    assert len({(r["id"], r["neighbor"]) for r in got}) == len(got)


def test_a_bucket_is_searched_in_blocks(spark, monkeypatch):
    """Most vectors on one side of every plane: a crowded bucket is cut, not capped."""
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(500, 5)) * 0.01, rng.normal(size=(100, 5)) * 50])
    sides = rng.random(600) < 0.5
    away, _ = brute(points, sides, 3)
    got = approx_neighbors.knn_approx(pair_of(spark, points, sides), "id", 3, bucket=40).collect()
    assert len(got) == 1800 and measured_recall(got, away, 3) >= 0.9


def test_too_few_tables_end_in_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(approx_neighbors, "TABLES", (1,))
    monkeypatch.setattr(approx_neighbors, "PROBES", 1)
    points, sides = cloud(4, 400, 12, False)
    pair = pair_of(spark, points, sides)
    got = approx_neighbors.knn_approx(pair, "id", 3, bucket=8)
    columns = ["id", "rank", "neighbor", "dist"]
    assert got.first()["tables"] == 0
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(
        map(tuple, neighbors.knn_pooled(pair, "id", 3).select(*columns).collect())
    )


def test_empty_and_small_pairs(spark):
    points, sides = cloud(5, 6, 2, False)
    pair = pair_of(spark, points, sides)
    assert approx_neighbors.knn_approx(pair.where("id < 0"), "id", 3).count() == 0
    got = approx_neighbors.knn_approx(pair, "id", 3)
    assert got.count() == 18 and got.first()["recall"] == 1.0
