"""Every operator and pipeline stage on empty tables, odd rows and a very long text."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, sorted_rows, words
from twinframe.llm import (
    op1_quality,
    op2_suffix,
    op3_decontaminate,
    op5_toxicity,
    op6_records,
    op7_language,
    op8_substring,
    op9_mixing,
    op10_simhash,
)

FILTERS = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name,stage", FILTERS)
def test_stages_of_an_empty_table(spark, no_docs, data, name, stage):
    after = stage(spark, no_docs, data)
    assert after.columns == no_docs.columns and after.count() == 0


def test_operators_of_an_empty_table(spark, no_docs, tokenizer):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op3_decontaminate.contamination(no_docs, benchmark).count() == 0
    assert op9_mixing.mix(no_docs).count() == 0
    assert op6_records.round_trip(no_docs, tokenizer).count() == 0
    assert op7_language.predict(no_docs, op7_language.fit(no_docs)).count() == 0


@pytest.mark.parametrize("name,stage", FILTERS)
def test_stages_keep_rows_as_they_are(spark, docs, data, name, stage):
    """Odd rows, clashing column names: what a stage keeps is unchanged, nulls in every column included."""
    before = {tuple(r) for r in docs.collect()}
    after = stage(spark, docs, data)
    assert after.columns == docs.columns
    assert {tuple(r) for r in after.collect()} <= before


def test_rejected_languages(docs, rows):
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = op7_language.rejected_dropped(docs)
    assert sorted_rows(kept, *docs.columns) == sorted(want, key=repr)


def test_one_document_of_each_group_stays(docs, rows):
    groups = {r.id: r.component for r in op10_simhash.simhash_components(docs).collect() if r.id is not None}
    want = [r for r in rows if r[0] is None or groups[r[0]] == r[0]]
    kept = op10_simhash.near_duplicates_dropped(docs)
    assert sorted_rows(kept, *docs.columns) == sorted(want, key=repr)


def test_documents_repeat_as_the_mix_takes_them(docs):
    shares = {}
    for r in op9_mixing.mix(docs).where("size > 0").collect():
        shares.setdefault((r.id, r.tie), []).append(r.taken / r.size)
    want = {key: int(sum(s) / len(s) + 0.5) * len(s) for key, s in shares.items()}
    mixed = op9_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    found = {(r.doc_id, r.tie): r["count"] for r in mixed.groupBy("doc_id", F.xxhash64("text").alias("tie")).count().collect()}
    assert found == {key: n for key, n in want.items() if n}


def test_a_very_long_text(spark, tokenizer, data):
    """Two megabytes in one row; its middle stands in a short row, and its end repeats its start."""
    r = random.Random(9)
    body = words(r, 300_000, 100_000)
    head, middle = body[:60], body[150_000:150_100]
    rows = [(1, " ".join(middle), "en", "s"), (2, " ".join([*body, *head]), "en", "s"), (3, "other words", "en", "s")]
    docs = spark.createDataFrame([(*x, 0, "c", "i", "k", "s") for x in rows], SCHEMA)

    found = {x.id: x for x in op2_suffix.repeats_removed(docs).collect()}
    assert (found[1].n_removed, found[3].n_removed) == (found[1].n_bytes, 0)
    repeated = len(" ".join(middle)), len(" ".join(head))
    assert sum(repeated) + repeated[1] <= found[2].n_removed <= sum(repeated) + repeated[1] + 4
    found = {x.id: x for x in op8_substring.windows_removed(docs).collect()}
    assert [(found[i].n_words, found[i].n_removed) for i in (1, 2, 3)] == [(100, 0), (300_060, 100), (2, 0)]

    benchmark = spark.createDataFrame([("m", " ".join(middle[:30]))], "item_id string, text string")
    found = {x.id: x for x in op3_decontaminate.contamination(docs, benchmark).collect()}
    assert [(found[i].n_words, found[i].n_hit) for i in (1, 2, 3)] == [(100, 30), (300_060, 30), (2, 0)]

    assert op10_simhash.simhash_components(docs).where("id = component").count() == 3
    tokens = {x.doc_id: x.n_tokens for x in op6_records.round_trip(docs, tokenizer).collect()}
    assert tokens[2] > 300_060 > tokens[1] > 100
    assert op9_mixing.mix(docs).agg(F.sum("taken")).first()[0] == 300_162
    assert op7_language.predict(docs, op7_language.fit(docs)).where("lang_pred <> 'en'").count() == 0
    documents, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    for module in (op1_quality, op5_toxicity):
        scored = module.score(docs, module.fit(documents, labels))
        assert scored.where("score between 0 and 1").count() == 3
