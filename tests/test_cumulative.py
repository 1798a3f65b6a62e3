import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import cumulative


@pytest.fixture(params=["once", "refined"])
def path(request, monkeypatch):
    """Every ordered pass runs both below and above the size that one task sorts."""
    if request.param == "refined":
        monkeypatch.setattr(cumulative, "SORTED_ROWS", 3)
    return request.param


def long_rows(spark, columns):
    rows = [(c, None if v is None else float(v)) for c, vs in columns.items() for v in vs]
    return spark.createDataFrame(rows, "column string, value double")


def test_running_totals_of_numbers_text_and_structs(spark, path):
    values = list(range(200))
    rows = spark.createDataFrame(
        [(k, v, f"{v:04d}", v % 7) for k in ("a", "b") for v in values],
        "k string, v int, t string, n int",
    ).withColumn("s", F.struct("t", "v"))
    expected = np.cumsum([v % 7 for v in values])
    for order in ("v", "t", "s"):
        found = cumulative.running_totals(rows, ["k"], order, ["n"], buckets=5)
        got = {(r["k"], r["v"]): (r["cum_n"], r["total_n"]) for r in found.collect()}
        assert got == {
            (k, v): (expected[v], expected[-1]) for k in ("a", "b") for v in values
        }


def test_quantiles_with_a_hot_value_and_nulls(spark, path):
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.full(100, 3.25), rng.normal(size=200)])
    rows = long_rows(spark, {"x": [*hot, None, float("nan")], "one": [5.0]})
    ps = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {
        (r["column"], r["p"]): r["value"]
        for r in cumulative.exact_quantiles(rows, ps).collect()
    }
    for p in ps:
        assert got["x", p] == pytest.approx(np.quantile(hot, p), abs=1e-12)
        assert got["one", p] == 5.0


def test_weighted_quantiles_repeat_values(spark, path):
    rows = spark.createDataFrame(
        [("x", 1.0, 3), ("x", 2.0, 1), ("x", 10.0, 4)], "column string, value double, n long"
    )
    got = cumulative.exact_quantiles(rows, [0.5]).first()["value"]
    assert got == np.median([1, 1, 1, 2, 10, 10, 10, 10])


@pytest.mark.parametrize("n,points", [(1, 2000), (2, 2000), (37, 2000), (500, 40), (300, 300)])
def test_grid_equals_interpolated_quantiles(spark, path, n, points):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.gamma(2, 100, n), 1))
    grid = cumulative.quantile_grid(long_rows(spark, {"x": values}), points).orderBy("value")
    m = min(n, points)
    expected = np.quantile(values, np.linspace(0, 1, m)) if m > 1 else values[:1]
    rows = grid.collect()
    assert all(a["p_max"] < b["p_min"] for a, b in zip(rows, rows[1:]))
    full = [
        r["value"]
        for r in rows
        for _ in range(int(round((r["p_max"] - r["p_min"]) * max(m - 1, 1))) + 1)
    ]
    np.testing.assert_allclose(full, expected, atol=1e-9)


@pytest.mark.parametrize("n", [3, 5, 23, 100])
def test_tiles_equal_ntile(spark, path, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.5).alias("v"))
    rows.createOrReplaceTempView("tiles_source")
    want = {r["id"]: r["t"] for r in spark.sql("SELECT id, ntile(5) OVER (ORDER BY v, id) t FROM tiles_source").collect()}
    got = {r["id"]: r["t"] for r in cumulative.equal_tiles(rows, ["v", "id"], 5, "t").collect()}
    assert got == want
