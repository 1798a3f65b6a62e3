"""Decontamination, records, mixing, language and the classifiers."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import sorted_rows
from tools.check_oracles import TABLES, compare
from twinframe.llm import op1_quality, op3_decontaminate, op5_toxicity, op6_records, op7_language, op9_mixing
from twinframe.llm.fm_index import FMIndex

P3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_fm_index_finds_every_occurrence():
    random = np.random.default_rng(4)
    text = np.concatenate([random.integers(1, 4, 300), [0], random.integers(1, 4, 200), [0]])
    index = FMIndex(text, 3)
    patterns = [random.integers(1, 4, n) for n in (1, 3, 5, 8)]
    padded = np.array([[0] * (8 - len(p)) + list(p) for p in patterns])
    start, stop = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, start, stop):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("slice_bytes", [100, 1 << 20])
def test_contamination(spark, docs, rows, slice_bytes):
    items = [(1, " ".join(rows[45][1].split()[25:60]).upper()), (20, "é ñ"), (3, rows[50][1]), (4, ""), (5, None), (None, "W3 w3"), (1, "日本")]
    windows = {}
    for i, t in items:
        w = P3.findall(low(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add("null" if i is None else str(i))
    want = []
    for r in rows:
        w = P3.findall(low(r[1]))
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit[a : a + k] = [1] * k
                    found |= windows[tuple(w[a : a + k])]
        want.append((r[0], len(w), sum(hit), sorted(found)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = op3_decontaminate.contamination(docs, benchmark, slice_bytes=slice_bytes)
    assert sorted_rows(got, "id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    assert got.where(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]) != F.col("n_hit")).count() == 0
    clean = op3_decontaminate.contaminated_dropped(docs, benchmark, slice_bytes=slice_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(w[2] == 0 for w in want)
    assert op3_decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_records_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    folder = op6_records.new_folder(spark, "test")
    files = op6_records.write_records(docs, folder, path, file_bytes=20_000)
    assert files.count() > 2
    got = sorted_rows(op6_records.read_records(files, folder), "id", "n_tokens", "crc")
    want = []
    for r in rows:
        ids = np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    assert got == sorted(want, key=repr)
    starts = op6_records.with_starts(op6_records.read_records(files, folder), files).orderBy("start").collect()
    assert [r.start for r in starts] == [0, *np.cumsum([r.n_tokens for r in starts]).tolist()][:-1]
    known = [r.id for r in starts if r.id is not None]
    assert known == sorted(known)
    one = files.orderBy("part").first()
    id_, ids = op6_records.fetch(folder, one.data, [one.n_records - 1])[0]
    assert ids[-1] == 2 and (id_, zlib.crc32(ids.astype("<u4").tobytes())) in {(r.id, r.crc) for r in starts}
    with open(one.data, "r+b") as file:
        file.seek(30)
        file.write(b"\xff\x00\xff")
    with pytest.raises(Exception, match="damaged"):
        op6_records.read_records(files, folder).collect()


def test_pieces_encode_as_whole_texts():
    import public_tokenizers

    encoder = op6_records.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", " x", "x ", "a\n b", "it's <|endoftext|> ok", "ñ½² x²y 3½ ​ z　w", "日本 語", "'s 're", "\tc\x1c d", "", "Foo, bar&&& 12"]
    for text in texts:
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == whole


def test_mix_meets_targets(docs, rows):
    found = op9_mixing.mix(docs)
    assert found.count() == len(rows)
    per = found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in per)
    assert found.where("taken > 3 * size").count() == 0
    assert sorted_rows(found, "id", "taken") == sorted_rows(op9_mixing.mix(docs.repartition(7)), "id", "taken")


def test_mix_equals_its_sql(spark, data):
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    got = entry.queries()["op9_mixing"](spark, data).toPandas()
    assert compare(got, base.execute(entry.oracle_sql()["op9_mixing"]).df()) == ""


def test_language(spark, docs, no_docs, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    found = op7_language.op7_language(spark, data).join(table, "doc_id").where("held_out and lang is not null").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    model = op7_language.fit(docs)
    odd = {r.id: r for r in op7_language.predict(docs, model).collect()}
    assert [odd[i].lang_pred for i in (63, 64, 65)] == ["und"] * 3 and odd[66].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert op7_language.predict(docs, op7_language.fit(no_docs)).where("lang_pred <> 'und'").count() == 0
    assert op7_language.rejected_dropped(docs).columns == docs.columns


@pytest.mark.parametrize("module,label,least", [(op1_quality, "quality", 0.9), (op5_toxicity, "toxic", 0.75)])
def test_classifiers(spark, docs, no_docs, module, label, least):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = module.fit(documents, labels)
    known = documents.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    scored = module.score(known, model).join(labels.withColumnRenamed("doc_id", "id"), "id").toPandas()
    ones, zeros = (scored.loc[scored[label] == v, "score"].to_numpy() for v in (1, 0))
    assert ((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros)).mean() > least
    odd = module.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert module.score(no_docs, model).count() == 0
    assert module.score(docs, module.fit(documents, labels.limit(0))).count() == docs.count()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        docs = after
    result = corpus_pipeline.run(spark, data)
    want = docs.groupBy("doc_id").count()
    assert sorted_rows(result.groupBy("doc_id").count(), "doc_id", "count") == sorted_rows(want, "doc_id", "count")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
