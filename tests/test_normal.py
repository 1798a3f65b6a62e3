import math
import random
from statistics import NormalDist

import pytest

from twinframe.functions.normal import normal_probabilities, normal_quantiles, with_normal_cdf, with_probit


def of_array(spark, values, function):
    rows = spark.createDataFrame([(values,)], "x array<double>")
    return rows.select(function("x").alias("y")).first()["y"]


def test_quantile_equals_the_standard_library(spark):
    draw = random.Random(3)
    p = [draw.random() for _ in range(500)] + [10.0 ** -draw.uniform(0, 14) for _ in range(500)]
    p += [1 - x for x in p] + [0.075, 0.925, 0.5]
    found = of_array(spark, p, normal_quantiles)
    assert found == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-12)


def test_probability_equals_erfc(spark):
    draw = random.Random(4)
    z = [draw.uniform(-8, 8) for _ in range(1000)] + [0.0, 0.67448975, -0.67448975, 5.656854249492381]
    found = of_array(spark, z, normal_probabilities)
    assert found == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=1e-12)


def test_outside_the_open_interval_is_missing(spark):
    assert of_array(spark, [0.0, 1.0, -1.0, math.nan, None], normal_quantiles) == [None] * 5
    assert of_array(spark, [], normal_quantiles) == []


@pytest.mark.parametrize("copies", [1, 3])
def test_columns_agree_with_arrays(spark, copies):
    """One column is compiled, several are packed into an array."""
    p = [1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, None, 0.0, 1.0]
    rows = spark.createDataFrame([(x,) for x in p], "p double")
    scored = with_probit(rows, {f"z{i}": "p" for i in range(copies)})
    for row in scored.collect():
        if row["p"] in (None, 0.0, 1.0):
            assert row["z0"] is None
        else:
            assert row["z0"] == pytest.approx(NormalDist().inv_cdf(row["p"]), abs=1e-12)
    back = with_normal_cdf(scored, {f"q{i}": f"z{i}" for i in range(copies)})
    for row in back.where("z0 is not null").collect():
        assert row["q0"] == pytest.approx(row["p"], rel=1e-12)
    assert back.where("z0 is null and q0 is not null").count() == 0
