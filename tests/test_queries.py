"""Every registered query against its SQL, on whole tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from seqloom.catalog.base import ORACLES, QUERIES

entry.queries()
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# the smallest tables have too few items for these queries' thresholds
NEEDS_MEDIUM = {"core_adaptive_window"}
# thresholds no row of the smallest tables reaches
EMPTY_WHEN_SMALL = {"core_listens", "pruned_interactions"}
# without SQL: compared with plain versions in test_fitted.py
IN_OTHER_TESTS = {"balanced_kmeans_codes", "collisions_resolved", "residual_kmeans_codes", "sid_index_from_vectors", "text_embeddings"}


@pytest.fixture(scope="module")
def connections():
    return {d: duck(d) for d in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in IN_OTHER_TESTS])
def test_query_matches_sql(spark, connections, name):
    folder = MEDIUM if name in NEEDS_MEDIUM else SMALL
    rows, problem = compare(spark, connections[folder], QUERIES[name], ORACLES.get(name), folder)
    assert not problem, problem
    assert rows > 0 or name in EMPTY_WHEN_SMALL


def test_entry_runs(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "valid", "test"}
