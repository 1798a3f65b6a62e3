import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import fidelity
from twinframe.operators.sampling import labelled_union


def pair(spark, real, synth, schema="x double, c string"):
    return labelled_union(spark.createDataFrame(real, schema), spark.createDataFrame(synth, schema))


def test_identical_tables_score_zero(spark):
    rows = [(float(i % 17), "abc"[i % 3]) for i in range(50)]
    same = pair(spark, rows, rows)
    assert fidelity.ks_two_sample(same, ["x"]).first()[1:] == (0.0, 1.0)
    assert fidelity.tvd(same, ["c"]).first()["tvd"] == 0.0
    assert fidelity.corr_frobenius(same, ["x"]).first()[0] == 0.0


def test_disjoint_tables_score_one(spark):
    apart = pair(
        spark,
        [(float(i), "a") for i in range(20)],
        [(float(i + 100), "b") for i in range(20)],
    )
    row = fidelity.ks_two_sample(apart, ["x"]).first()
    assert row["ks_stat"] == 1.0 and row["p_value"] < 1e-6
    assert fidelity.tvd(apart, ["c"]).first()["tvd"] == 1.0


def test_nulls_are_dropped_by_ks_and_a_level_in_tvd(spark):
    found = pair(
        spark,
        [(1.0, "a"), (2.0, None), (None, "a"), (float("nan"), "a")],
        [(1.0, "a"), (2.0, "a"), (2.0, "a"), (1.0, "a")],
    )
    assert fidelity.ks_two_sample(found, ["x"]).first()["ks_stat"] == 0.0
    assert fidelity.tvd(found, ["c"]).first()["tvd"] == 0.25


def test_ks_equals_the_definition(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.3, 1, 200), 1)
    found = pair(spark, [(float(v), "") for v in a], [(float(v), "") for v in b])
    grid = np.union1d(a, b)
    gap = np.abs(
        np.searchsorted(np.sort(a), grid, side="right") / 300
        - np.searchsorted(np.sort(b), grid, side="right") / 200
    ).max()
    assert fidelity.ks_two_sample(found, ["x"]).first()["ks_stat"] == pytest.approx(gap, abs=1e-12)


def test_empty_side_gives_null_metrics(spark):
    empty = pair(spark, [(1.0, "a")], [])
    assert fidelity.ks_two_sample(empty, ["x"]).first()[1:] == (None, None)
    assert fidelity.tvd(empty, ["c"]).first()["tvd"] is None


def test_constant_column_has_zero_correlation_and_diagonal(spark):
    rows = spark.createDataFrame([(5.0, float(i)) for i in range(10)], "k double, x double")
    r = {(x["row"], x["col"]): x["r"] for x in fidelity.corr_matrix(rows, ["k", "x"]).collect()}
    assert r == {("k", "k"): 0.0, ("k", "x"): 0.0, ("x", "k"): 0.0, ("x", "x"): 1.0}


def test_correlation_uses_pairwise_present_rows(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 3))
    data[::7, 0] = np.nan
    data[::5, 2] = np.nan
    rows = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    got = {(x["row"], x["col"]): x["r"] for x in fidelity.corr_matrix(rows, ["a", "b", "c"]).collect()}
    import pandas as pd

    want = pd.DataFrame(data, columns=list("abc")).corr()
    for (i, j), r in got.items():
        assert r == pytest.approx(want.loc[i, j], abs=1e-12)


def test_summary_averages_rounded_values(spark):
    rng = np.random.default_rng(8)
    make = lambda shift: [
        (float(v), float(w), "ab"[int(v > 0)], "xyz"[i % 3])
        for i, (v, w) in enumerate(rng.normal(shift, 1, (90, 2)))
    ]
    found = labelled_union(
        spark.createDataFrame(make(0.0), "x double, y double, c string, d string"),
        spark.createDataFrame(make(0.4), "x double, y double, c string, d string"),
    )
    rows = fidelity.fidelity_summary(found, ["x", "y"], ["c", "d"]).collect()
    value = {(r["metric"], r["column"]): r["value"] for r in rows}
    assert len(rows) == 7
    assert value["avg_ks", ""] == pytest.approx(round((value["ks", "x"] + value["ks", "y"]) / 2, 4), abs=1e-4)


def test_partitioning_and_shuffle_settings_do_not_change_results(spark, data):
    from twinframe.sources.views import LINE_CATEGORICAL, LINE_NUMERIC, pair_shifted

    def run():
        rows = fidelity.fidelity_summary(pair_shifted(spark, data).repartition(5), LINE_NUMERIC, LINE_CATEGORICAL)
        return sorted(map(tuple, rows.collect()))

    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert dict((r[1:3], r[3]) for r in first)[("tvd", "l_returnflag")] > 0


def test_exact_tail_counts_all_orders():
    """Every order of n + m values, counted one by one."""
    from itertools import combinations

    for n in range(1, 9):
        for m in range(1, n + 1) if n > 6 else range(1, 9):
            widest = []
            for chosen in combinations(range(n + m), n):
                ones = np.zeros(n + m, int)
                ones[list(chosen)] = 1
                widest.append(np.abs(np.cumsum(ones) * m - np.cumsum(1 - ones) * n).max())
            widest = np.array(widest)
            for gap in np.unique(widest):
                want = (widest >= gap).mean()
                assert fidelity.exact_ks_tail(gap / (n * m), n, m) == pytest.approx(want, abs=1e-12)
            assert fidelity.exact_ks_tail(0.0, n, m) == 1.0


def test_exact_tail_nears_the_limit_distribution(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [[(float(x), "a") for x in rng.normal(shift, 1, 600)] for shift in (0, 0.1)]
    both = pair(spark, *rows)
    exact = fidelity.ks_two_sample(both, ["x"]).first()
    monkeypatch.setattr(fidelity, "EXACT_CELLS", 0)
    limit = fidelity.ks_two_sample(both, ["x"]).first()
    assert exact["ks_stat"] == limit["ks_stat"] and exact["p_value"] != limit["p_value"]
    assert exact["p_value"] == pytest.approx(limit["p_value"], abs=0.01)
