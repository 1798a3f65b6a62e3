import hashlib
import math

import pytest
from pyspark.sql import functions as F

from twinframe.operators import cumulative, sampling


def md5(seed, key):
    """The documented row order: every part with its length."""
    return hashlib.md5(":".join(f"{len(str(p))}.{p}" for p in (seed, key)).encode()).hexdigest()


@pytest.fixture(params=["one look", "several looks"])
def looks(request, monkeypatch):
    if request.param == "several looks":
        monkeypatch.setattr(cumulative, "SORTED_ROWS", 1)
        monkeypatch.setattr(sampling, "RANGE_DIGITS", 1)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 40, 200, 500])
def test_sample_takes_the_smallest_hashes(spark, looks, n):
    rows = spark.range(200)
    order = sorted(range(200), key=lambda i: md5(7, i))
    assert ids(sampling.sample_exact(rows, ["id"], n, 7)) == sorted(order[:n])


def test_split_sizes_follow_floor_floor_rest(spark, looks):
    rows = spark.range(187)
    split = sampling.split_by_seed(rows, ["id"], [42, 123])
    for seed in (42, 123):
        order = sorted(range(187), key=lambda i: md5(seed, i))
        got = {r["id"]: r["split"] for r in split.where(F.col("seed") == seed).collect()}
        first, second = math.floor(187 * 0.7), math.floor(187 * 0.15)
        assert {i for i, s in got.items() if s == "train"} == set(order[:first])
        assert {i for i, s in got.items() if s == "val"} == set(order[first : first + second])
        assert len(got) == 187


def test_split_of_the_published_row_count():
    assert (math.floor(18314 * 0.7), math.floor(18314 * 0.15)) == (12819, 2747)


def test_tiny_table_has_no_training_rows_to_lose(spark):
    got = sampling.split_train_val_test(spark.range(1), ["id"]).collect()
    assert [r["split"] for r in got] == ["test"]


def test_stratified_share_per_label_with_null(spark, looks):
    label = F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 60, "a").otherwise("b")
    rows = spark.range(200).withColumn("y", label)
    split = sampling.split_stratified(rows, ["id"], "y")
    assert split.count() == 200
    for row in split.groupBy("y").agg(
        F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n")
    ).collect():
        assert row["t"] == math.ceil(0.3 * row["n"])


def test_balanced_pair_cuts_to_the_smaller_side(spark):
    pair = spark.range(100).withColumn("side", F.when(F.col("id") < 30, "real").otherwise("synth"))
    sizes = {r["side"]: r["count"] for r in sampling.balanced_pair(pair, ["id"]).groupBy("side").count().collect()}
    assert sizes == {"real": 30, "synth": 30}


def test_samples_do_not_depend_on_partitioning(spark):
    a = ids(sampling.sample_exact(spark.range(300).repartition(1), ["id"], 77))
    b = ids(sampling.sample_exact(spark.range(300).repartition(13), ["id"], 77))
    assert a == b


def test_row_ids_number_rows_without_a_key(spark):
    rows = [("x", None), (None, "x"), ("a", "b")] + [("c", "c")] * 5
    table = spark.createDataFrame(rows, "a string, b string")
    got = sorted(tuple(r) for r in sampling.with_row_id(table).fillna("").collect())
    assert [r[0] for r in got] == list(range(8))
    assert got == sorted(tuple(r) for r in sampling.with_row_id(table.repartition(5)).fillna("").collect())
    assert sorted(r[1:] for r in got) == sorted((a or "", b or "") for a, b in rows)


def test_copies_of_a_row_are_numbered_in_runs_over_many_tasks(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 'hot' ELSE string(id % 300) END AS a")
    whole = sorted(tuple(r) for r in sampling.with_row_id(rows).collect())
    assert [r[0] for r in whole] == list(range(5000))
    monkeypatch.setattr(sampling, "RUN_ROWS", 7)
    numbered = sampling.with_row_id(rows)
    assert sorted(tuple(r) for r in numbered.collect()) == whole
    tasks = numbered.where("a = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 4000 and max(r["count"] for r in tasks) < 2000


def test_hashes_tell_nulls_and_separators_apart(spark):
    from twinframe.functions.scalars import hash_key

    rows = spark.createDataFrame([(None, "x"), ("x", None), ("x:1", ""), ("x", "1:")], "a string, b string")
    assert rows.select(hash_key(1, ["a", "b"]).alias("h")).distinct().count() == 4


@pytest.mark.parametrize("share", [0.3, 0.0, 1.0, 0.11])
def test_stratified_total_is_exact(spark, share):
    """One label in a third of the rows, one null, many single ones."""
    labels = ["a"] * 40 + ["b"] * 33 + [None] * 21 + [f"s{i}" for i in range(26)]
    rows = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    found = sampling.split_stratified_total(rows, ["id"], "label", test_share=share).collect()
    test = [r for r in found if r["split"] == "test"]
    assert len(found) == 120 and len(test) == math.ceil(120 * share)
    for label in set(labels):
        size, taken = labels.count(label), sum(r["label"] == label for r in test)
        assert math.floor(size * share) <= taken <= math.floor(size * share) + 1
        order = sorted((i for i, x in enumerate(labels) if x == label), key=lambda i: md5(42, i))
        assert sorted(r["id"] for r in test if r["label"] == label) == sorted(order[:taken])


def test_stratified_total_of_no_rows(spark):
    none = spark.createDataFrame([], "id int, label string")
    assert sampling.split_stratified_total(none, ["id"], "label").count() == 0


@pytest.mark.parametrize("n", [50, 20, 130, 0])
def test_resampled_columns_keep_their_values(spark, n):
    rows = [(i, float(i % 7), None if i % 5 == 0 else "xy"[i % 2]) for i in range(50)]
    real = spark.createDataFrame(rows, "id int, x double, c string")
    found = sorted(map(tuple, sampling.resampled_columns(real, ["id"], ["x"], ["c"], n).collect()))
    assert [r[0] for r in found] == list(range(n))
    for at, name in ((1, "x"), (2, "c")):
        order = sorted(rows, key=lambda r: hashlib.md5(f"2.42:{len(str(r[0]))}.{r[0]}:1.{name}".encode()).hexdigest())
        assert [r[at] for r in found] == [order[i * 50 // n][at] for i in range(n)]
