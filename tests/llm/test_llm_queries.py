"""Registered corpus queries against their SQL on whole tables, and on empty tables."""

import pytest
from oracle import TABLES, compare, duck

from seqloom.llm.catalog import load

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows, problem = compare(spark, con, QUERIES[name], ORACLES.get(name), SMALL)
    assert rows and not problem, problem


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


def test_empty_pipeline(spark, empty_tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_tables).count() == 0
