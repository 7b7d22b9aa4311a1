"""Every registered query against DuckDB on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from workload.queries import QUERIES
from workload.sample_tables import sample_book

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLE = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(smoke_dir):
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"create view {name} as select * from '{smoke_dir}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, smoke_dir, name):
    got = QUERIES[name](spark, smoke_dir)
    rows = got.collect()
    relation = duck.execute(ORACLE[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    expected = [tuple(row[columns.index(c)] for c in order) for row in relation.fetchall()]
    assert sorted((tuple(r[c] for c in order) for r in rows), key=repr) == sorted(expected, key=repr)


def rows(spark, name, sf="/root/testdata/sf0.01"):
    return QUERIES[name](spark, sf).count()


def test_filters_leave_something_out(spark, smoke_dir):
    """Each filtered view has rows, and fewer than the mart."""
    book = sample_book(spark, "/root/testdata/sf0.01")
    users, channels = book.stored_users.count(), book.stored_channels.count()
    for name in ("trending_users", "trending_users_tracked", "trending_users_tracked_holding", "limited_view"):
        assert 0 < rows(spark, name) < users, name
    for name in ("trending_channels", "trending_channels_of_user", "trending_channels_holding"):
        assert 0 < rows(spark, name) < channels, name
    assert any(r.repeated_keys for r in QUERIES["key_duplicates"](spark, "/root/testdata/sf0.01").collect())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
