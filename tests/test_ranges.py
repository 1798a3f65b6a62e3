"""Order statistics by counted ranges against plain sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import ranges
from twinframe.operators.cumulative import exact_quantiles, quantile_grid
from twinframe.operators.fidelity import ks_two_sample

INF = float("inf")


def made(seed=1):
    """Columns that are even, skewed, tied, constant, infinite, tiny or empty."""
    r = random.Random(seed)
    columns = {
        "even": [r.uniform(-5, 5) for _ in range(700)],
        "skewed": [math.exp(r.gauss(0, 6)) for _ in range(700)],
        "tied": [float(r.randrange(4)) for _ in range(700)] + [0.5, -0.0],
        "constant": [3.25] * 300,
        "infinite": [-INF, INF, INF, *[r.random() for _ in range(50)]],
        "only_infinite": [-INF, INF, INF],
        "far": [-1.7e308, 1.7e308, 0.0, *[r.gauss(0, 1) for _ in range(200)]],
        "one": [7.0],
        "none": [],
    }
    rows = [(c, v) for c, values in columns.items() for v in [*values, None, float("nan")]]
    r.shuffle(rows)
    return columns, rows


@pytest.fixture(params=[(1 << 16, 10**6), (300, 40)])
def levels(request, monkeypatch):
    """Cells and counted rows: one look, and several."""
    monkeypatch.setattr(ranges, "CELLS", request.param[0])
    monkeypatch.setattr(ranges, "MIN_CELLS", 8)
    monkeypatch.setattr(ranges, "COUNTED_ROWS", request.param[1])


def test_values_at_every_rank(spark, levels):
    columns, rows = made()
    long = spark.createDataFrame(rows, "column string, value double").repartition(3).withColumn("n", F.lit(1))
    every = F.sequence(F.lit(0).cast("long"), F.col("total") + 3)
    sizes, found = ranges.values_at_ranks(long, every)
    got = {(r.column, r["rank"]): r.value for r in found.collect()}
    assert got == {(c, i): v for c, values in columns.items() for i, v in enumerate(sorted(values))}
    assert {r.column: r.total for r in sizes.collect()} == {c: len(v) for c, v in columns.items() if v}


def test_quantiles_of_counted_values(spark, levels):
    columns, rows = made(2)
    long = spark.createDataFrame(rows, "column string, value double").withColumn("n", F.lit(1) + F.pmod(F.xxhash64("value"), F.lit(3)))
    spread = long.withColumn("i", F.explode(F.expr("sequence(1, n)"))).drop("i", "n")
    p = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    weighted, plain = ({(r.column, r.p): r.value for r in exact_quantiles(x, p).collect()} for x in (long, spread))
    assert {k: repr(v) for k, v in weighted.items()} == {k: repr(v) for k, v in plain.items()}
    finite = {c: [r.value for r in spread.where((F.col("column") == c) & F.col("value").isNotNull() & ~F.isnan("value")).collect()] for c in ("even", "tied", "skewed")}
    for c, values in finite.items():
        assert np.allclose([plain[c, q] for q in p], np.quantile(values, p), rtol=1e-12)


def test_grid(spark, levels):
    columns, rows = made(3)
    grid = quantile_grid(spark.createDataFrame(rows, "column string, value double"), 40)
    found = {}
    for r in grid.collect():
        found.setdefault(r.column, []).append((r.value, r.p_min, r.p_max))
    for c in ("even", "skewed", "tied", "constant", "one"):
        values, cells = sorted(columns[c]), min(len(columns[c]), 40) - 1
        at = np.quantile(values, np.arange(cells + 1) / max(cells, 1)) if cells else np.array(values)
        assert np.allclose(np.unique(np.round(at, 12)), np.round(sorted(v for v, _, _ in found[c]), 12))
        assert min(p for _, p, _ in found[c]) == 0 and max(p for _, _, p in found[c]) == (1 if cells else 0)
    assert "none" not in found


@pytest.mark.parametrize("shift", [0.0, 0.3])
def test_widest_gaps(spark, levels, shift):
    r = random.Random(5)
    sides = {"real": [r.gauss(0, 1) for _ in range(400)], "synth": [round(r.gauss(shift, 1), 2) for _ in range(300)]}
    rows = [(s, v, float(i % 5), None if s == "real" else 1.0) for s, values in sides.items() for i, v in enumerate(values)]
    pair = spark.createDataFrame([*rows, ("real", None, float("nan"), None)], "side string, a double, b double, c double")
    found = {x.column: x for x in ks_two_sample(pair, ["a", "b", "c"]).collect()}
    at = np.sort(np.concatenate(list(sides.values())))
    share = [np.searchsorted(np.sort(v), at, "right") / len(v) for v in sides.values()]
    assert found["a"].ks_stat == pytest.approx(np.abs(share[0] - share[1]).max(), abs=1e-12)
    assert found["b"].ks_stat == 0 and found["c"].ks_stat is None and found["c"].p_value is None


def test_no_values_are_exchanged(spark, monkeypatch):
    """What crosses a shuffle is cells: far fewer rows than distinct values."""
    sent = []
    whole = ranges.materialize
    monkeypatch.setattr(ranges, "materialize", lambda df: sent.append(whole(df)) or sent[-1])
    monkeypatch.setattr(ranges, "CELLS", 512)
    monkeypatch.setattr(ranges, "COUNTED_ROWS", 1000)
    long = spark.range(200_000).select(F.lit("x").alias("column"), F.rand(3).alias("value"), F.lit(1).alias("n"))
    _, found = ranges.values_at_ranks(long, F.array(F.lit(100_000).cast("long")))
    assert found.count() == 1
    assert max(df.count() for df in sent) <= 512
