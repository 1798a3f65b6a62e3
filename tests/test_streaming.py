"""Counts of unseen levels while a stream is encoded."""

from twinframe.operators.encoder import fit_encoder
from twinframe.streaming.encode import encode_stream, reject_counts


def test_unseen_levels_are_counted_per_batch(spark, tmp_path):
    schema = "id int, x double, c string, d string"
    known = [(i, float(i), "ab"[i % 2], None if i % 3 else "p") for i in range(20)]
    state = fit_encoder(spark.createDataFrame(known, schema), ["x"], ["c", "d"])
    batches = [
        [(1, 1.0, "a", "p"), (2, 2.0, "z", None), (3, None, "z", "q")],
        [(4, 4.0, "b", "q"), (5, 5.0, None, "r")],
        [(6, 6.0, "b", "p")],
    ]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={number}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    query = encode_stream(stream, state, str(tmp_path / "z"), str(tmp_path / "c"), ["id"])
    assert query.awaitTermination(100)
    found = reject_counts(query, state)
    want = [(3, 2, 1), (2, 1, 2), (1, 0, 0)]
    assert sorted((f["n_rows"], f["unseen"]["c"], f["unseen"]["d"]) for f in found) == sorted(want)
    assert len({f["batch"] for f in found}) == 3
    assert spark.read.parquet(str(tmp_path / "z")).count() == 6
