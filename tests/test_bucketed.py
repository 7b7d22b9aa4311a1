"""Sides of the users mart dealt by account."""

import pytest
from pyspark.sql import functions as F

from flockmetrics.plans.book import MartBook
from flockmetrics.plans.users import account_sides, users_mart
from flockmetrics.sources.stored import remove, store, store_bucketed
from tests.test_daily import rows_of, world


@pytest.fixture
def inputs(spark, tables, clock):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    built = tables(**world(7), fids=[{"fid": n, "custody_address": bytearray([n] * 20)} for n in range(1, 7)])
    yield built
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_bucketed_sides_are_not_shuffled(inputs, clock):
    sides = account_sides(inputs, clock)
    dealt = sides.kept(lambda df, name: store_bucketed(df, name, "fid"))
    plain = sides.kept(store)
    with_buckets = formatted(users_mart(inputs, clock, sides=dealt, ordered=False))
    without = formatted(users_mart(inputs, clock, sides=plain, ordered=False))
    assert with_buckets.count("Bucketed: true") == 4
    exchanges = [text.split("\n\n")[0].count("Exchange (") for text in (with_buckets, without)]
    assert exchanges[1] - exchanges[0] == 4


def test_same_mart_and_nothing_left(spark, inputs, clock):
    book = MartBook(inputs, clock, bucketed=True)
    assert rows_of(book.users()) == rows_of(MartBook(inputs, clock).users())
    names = [side.stored_as for side in vars(book.sides).values()]
    assert all(spark.catalog.tableExists(name) for name in names)
    book.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_one_file_for_each_bucket_and_null_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("fid"), F.col("id").alias("v"))
    stored = store_bucketed(df, "numbers", "fid", 3)
    assert len(stored.inputFiles()) == 3
    assert rows_of(stored) == rows_of(df)
    remove(stored)
