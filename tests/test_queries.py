"""Registered queries at the smallest scale: names, oracles, and the flagship."""

import duckdb
import os

import pytest

import __spark_entry__ as entry_module
from tools.check import canonical


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["derive_parent", "category_expansion", "link_terms", "rrf_fuse", "apply_reviews", "gold_rank", "match_all_words", "knn_topk", "read_index_xml"])
def test_against_sql(spark, con, sf, name):
    import pandas as pd

    got = entry_module.queries()[name](spark, sf).toPandas()
    result = con.execute(entry_module.oracle_sql()[name])
    want = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    assert canonical(got) == canonical(want)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and min(r["rank"] for r in rows) == 1 and max(r["rank"] for r in rows) > 10
