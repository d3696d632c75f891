"""A cross-section of the registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["bm25_search", "knn_filtered", "hybrid_search", "hierarchical_search", "link_parents", "neighbour_frame",
         "clean_technical", "extract_metadata", "sheet_to_chunks", "upsert_chunks", "quality_metrics", "session_memory_stream"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    assert ours == rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
