"""Dictionary joins against plain Python; hot values and the number of shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from twinframe.operators import encoder, lookup
from twinframe.session import groups_that_fit, materialize


def made(spark, kinds=40):
    """A third of the rows one known value, a sixth one unknown value, a tenth null."""
    r = random.Random(6)
    pick = lambda: r.choices(["hot", "lost", None, f"v{r.randrange(kinds)}"], [10, 5, 3, 12])[0]
    rows = [(i, pick()) for i in range(3000)]
    entries = [("hot", 1.0, 900), (None, 2.0, 5), *[(f"v{i}", float(i), 10) for i in range(0, kinds, 2)]]
    return rows, spark.createDataFrame(rows, "id long, v string"), spark.createDataFrame(entries, "e string, x double, n long"), dict((e, x) for e, x, _ in entries)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("share", [1 / 1024, 0.05, 0.9])
def test_lookup(spark, monkeypatch, small, share):
    """Whatever counts as hot: every value, the largest, or none."""
    monkeypatch.setattr(lookup, "HOT_SHARE", share)
    rows, table, dictionary, known = made(spark)
    found = lookup.lookup(table, dictionary, "v", "e", ["x"], small, "n")
    assert found.columns == ["id", "v", "x"]
    assert sorted(map(tuple, found.collect())) == [(i, v, known.get(v)) for i, v in rows]


def test_hot_values(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.05)
    _, table, dictionary, _ = made(spark)
    name = lambda v: spark.range(1).select(F.xxhash64(F.lit(v).cast("string"))).first()[0]
    assert set(lookup.hot_values(table, "v")) == {name("hot"), name("lost"), name(None)}
    assert lookup.hot_entries(dictionary, "e", "n") == [name("hot")]
    assert lookup.hot_values(table.where("id < 0"), "v") == []


def test_a_hot_value_is_no_hot_key(spark, monkeypatch):
    """Rows of a value in a third of the table are spread over all tasks of the join."""
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.05)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in plain}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        _, table, dictionary, _ = made(spark)
        found = lookup.lookup(table, dictionary, "v", "e", ["x"], False)
        placed = found.where("v = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(placed) == 8 and max(r["count"] for r in placed) < 2 * sum(r["count"] for r in placed) / 8
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_one_large_dictionary_causes_one_shuffle(spark, monkeypatch):
    rows = [(i, f"k{i}", "ab"[i % 2], "xyz"[i % 3]) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, large string, two string, three string")
    state = encoder.fit_encoder(table, [], ["large", "two", "three"])
    monkeypatch.setattr(encoder, "groups_that_fit", lambda df, by: groups_that_fit(df, by, max_rows=100))
    assert state.small_levels == {"large": False, "two": True, "three": True}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        coded = encoder.encode(table, state, ["id"])
        plan = coded._jdf.queryExecution().executedPlan().toString()
        # the rows once, and the large dictionary once
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastHashJoin") >= 2
        assert coded.count() == 600 and coded.where("exists(z, x -> x is null)").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_groups_that_fit_together(spark):
    sizes = {"a": 3, "b": 10, "c": 100}
    table = materialize(spark.createDataFrame([(c, f"v{i}") for c, n in sizes.items() for i in range(n)], "c string, v string"))
    assert groups_that_fit(table, "c", max_rows=50) == {"a": True, "b": True, "c": False}
    assert groups_that_fit(table, "c", max_rows=12) == {"a": True, "b": False, "c": False}
