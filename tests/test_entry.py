"""Registered queries against their SQL on the smallest tables.

``tools/check_oracles.py`` compares all of them at any scale; here a part that
covers every operator module.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

COMPARED = [
    "completeness", "category_levels", "out_of_domain", "ordinal_encode", "split_by_seed",
    "balanced_pair", "roc_auc", "regression_metrics", "fidelity_summary_shifted", "encode_rows",
    "decode_rows", "forward_noise", "knn_pooled", "inter_record",
]


@pytest.fixture(scope="module")
def database(data):
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return base


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["method", "metric", "column", "value"]
    assert rows.count() == 9


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, data, database, name):
    got = entry.queries()[name](spark, data).toPandas()
    assert len(got)
    assert compare(got, database.execute(entry.oracle_sql()[name]).df()) == ""
