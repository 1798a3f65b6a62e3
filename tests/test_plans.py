import json

import pytest
from pyspark.sql import functions as F

from twinframe.operators.encoder import decode, encode, fit_encoder
from twinframe.operators.sampling import labelled_union
from twinframe.plans import evaluate, generate
from twinframe.session import materialize
from twinframe.sources import files, schema
from twinframe.sources.views import HOUSEHOLD_CATEGORICAL as CATEGORICAL, HOUSEHOLD_NUMERIC as NUMERIC
from twinframe.streaming.encode import decode_stream, encode_stream

ID = ["c_custkey"]


@pytest.fixture(scope="module")
def fitted(spark, household):
    return generate.train(household, ID, NUMERIC, CATEGORICAL, steps=100)


@pytest.fixture(scope="module")
def synth(spark, household, fitted):
    made = generate.synthesize(spark, fitted, 1500)
    return materialize(made.withColumnRenamed("row_id", "c_custkey"))


def test_synthetic_rows_are_complete_and_in_domain(household, fitted, synth):
    assert synth.count() == 1500
    assert synth.columns == [*ID, *NUMERIC, *CATEGORICAL]
    for row in generate.check_synthetic(synth, fitted.encoder).collect():
        assert (row["n_rows"], row["n_missing"], row["n_out_of_domain"]) == (1500, 0, 0)


def test_synthetic_rows_resemble_the_real_ones(spark, household, fitted, synth):
    def scores(made):
        pair = labelled_union(household.select(*ID, *NUMERIC, *CATEGORICAL), made)
        rows = evaluate.run_fidelity(pair, NUMERIC, CATEGORICAL).where("column = ''").collect()
        return {r["metric"]: r["mean"] for r in rows}

    ours = scores(synth)
    # 150 real rows: sampling error alone is about 0.08
    assert ours["avg_ks"] < 0.12 and ours["avg_tvd"] < 0.12
    alone = generate.baseline_marginals(spark, fitted.encoder, 1500)
    apart = scores(alone.withColumnRenamed("row_id", "c_custkey"))
    assert apart["avg_ks"] < 0.12
    assert ours["corr_frobenius"] < 0.5 * apart["corr_frobenius"]


def test_reloaded_generator_draws_the_same_rows(spark, fitted, tmp_path):
    fitted.save(str(tmp_path))
    again = generate.Generator.load(spark, str(tmp_path))
    rows = lambda g: sorted(map(str, generate.synthesize(spark, g, 50).collect()))
    assert rows(again) == rows(fitted)


def test_training_loss_is_below_that_of_no_model(household, fitted):
    assert generate.training_loss(household, ID, fitted).first()["loss"] < 1.0


def test_detection_of_a_shifted_table(household):
    real = household.select(*ID, *NUMERIC, *CATEGORICAL)
    shifted = real.withColumn("spend", F.col("spend") * 3)
    pair = labelled_union(real, shifted)
    rows = evaluate.run_detection(pair, ID, NUMERIC, CATEGORICAL, seeds=[42], trees=3).collect()
    auc = {r["metric"]: r["mean"] for r in rows}["auc"]
    assert auc > 0.8


def test_all_families_and_their_tables(household, synth, tmp_path):
    results = materialize(
        evaluate.run_all(
            household, {"ours": synth}, ID, NUMERIC, CATEGORICAL, "spend_quintile", "spend",
            seeds=[42], detection_trees=2, utility_trees=2,
        )
    )
    tables = evaluate.summary_tables(results)
    assert {n: t.columns[1] for n, t in tables.items()} == {
        "fidelity": "avg_ks", "detection": "accuracy", "classification": "accuracy", "regression": "rmse",
    }
    assert {r["method"] for r in tables["regression"].collect()} == {"ours", "Real (TRTR)"}
    record = files.nested_record(results).where("method = 'ours'").first()["record"]
    assert len(json.loads(record)["metrics"]) == results.where("method = 'ours'").count()
    files.write_report(results, str(tmp_path / "report"))
    assert results.sparkSession.read.json(str(tmp_path / "report")).count() == results.count()


def test_csv_keeps_mark_names_and_order(spark, tmp_path):
    rows = spark.createDataFrame(
        [tuple(i if c in schema.SURVEY_NUMERIC else str(i) for c in schema.SURVEY_COLUMNS) for i in range(5)],
        schema.survey_schema(),
    )
    path = str(tmp_path / "csv")
    files.write_csv(rows.coalesce(1), path)
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    again = files.read_csv(spark, path, schema.survey_schema())
    schema.expect_columns(again, schema.SURVEY_COLUMNS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    state = fit_encoder(again, schema.SURVEY_NUMERIC, schema.survey_categorical(), order=schema.SURVEY_COLUMNS)
    assert state.width == 27
    back = decode(encode(again, state), state)
    assert back.columns == schema.SURVEY_COLUMNS


def test_written_synthetic_table(spark, fitted, synth, tmp_path):
    path = str(tmp_path / "synthetic")
    checked = generate.write_synthetic(synth, fitted.encoder, path)
    assert checked.where("n_out_of_domain > 0 OR n_missing > 0").count() == 0
    assert files.read_csv(spark, path).count() == synth.count()


def test_schema_contract(spark):
    rows = spark.createDataFrame([(1, 2.0, "a")], "i int, x double, c string")
    assert schema.classify_columns(rows) == (["i", "x"], ["c"])
    assert schema.project_columns(rows, ["c", "i"]).columns == ["c", "i"]
    for names in (["x", "i", "c"], ["i", "x"], ["i", "x", "c", "d"]):
        with pytest.raises(ValueError):
            schema.expect_columns(rows, names)
    with pytest.raises(ValueError):
        schema.project_columns(rows, ["nope"])


def test_streams_encode_and_decode_like_tables(spark, household, fitted, tmp_path):
    state = fitted.encoder
    household.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(household.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = encode_stream(stream, state, str(tmp_path / "z"), str(tmp_path / "c1"), ID)
    query.awaitTermination(120)
    encoded = spark.read.parquet(str(tmp_path / "z"))
    want = sorted(map(str, encode(household, state, ID).collect()))
    assert sorted(map(str, encoded.collect())) == want
    back = spark.readStream.schema(encoded.schema).parquet(str(tmp_path / "z"))
    decode_stream(back, state, str(tmp_path / "out"), str(tmp_path / "c2"), ID).awaitTermination(120)
    decoded = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, decoded.collect())) == sorted(map(str, decode(encoded, state, ID).collect()))


def test_trees_grow_in_many_tasks(spark):
    """Encoded rows are narrow: dealt by bytes they would be one task, whatever their number."""
    rows = spark.range(0, 9000, 1, 1).selectExpr("double(id % 3) AS y", "double(id) AS v")
    dealt = evaluate._spread(rows)
    sizes = dealt.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) <= 2 * evaluate.TASK_ROWS
    assert sorted(dealt.collect()) == sorted(rows.collect())
    assert evaluate._spread(rows.limit(100)).rdd.getNumPartitions() == 1


def test_tasks_of_a_forest_grow_slower_than_large_tables():
    assert [evaluate._tasks(n) for n in (0, 2000, 2001, 80_000, 630_000)] == [0, 1, 2, 40, 40]
    assert evaluate._tasks(5_400_000) < 120


def test_tested_rows_walk_the_trees_in_many_tasks(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).coalesce(1)
    model = RandomForestClassifier(labelCol="y", numTrees=3, seed=1).fit(rows)
    monkeypatch.setattr(evaluate, "TASK_ROWS", 100)
    found = evaluate._predicted(model, rows)
    assert found.rdd.getNumPartitions() == 4
    assert found.count() == 400 and found.columns == ["y", "yhat"]
