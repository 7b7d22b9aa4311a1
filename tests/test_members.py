"""Members as bitmaps and short lists against plain pairs."""

import random

import pytest
from pyspark.sql import functions as F

from flockmetrics.operators import members as m
from flockmetrics.operators.members import keys_with_any, member_counts, member_ranges


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(3)
    groups = {
        "full": range(-40_000, 40_000, 7), "edge": [0, 1, 32_768, 32_769, -32_767, -32_768, 2**40],
        "odd": rnd.sample(range(1, 60_000), 3_000), "one": [77], "half": range(65_537, 98_305, 2),
    }
    rows = [(g, i) for g, ids in groups.items() for i in ids] + [("one", None), (None, 5)]
    return groups, spark.createDataFrame(rows, "g string, id long").cache()


def test_ranges_hold_every_member(pairs):
    groups, df = pairs
    ranges = member_ranges(df, "g", "id")
    counts = {r["g"]: r["members"] for r in member_counts(ranges, "g").collect()}
    assert counts == {g: len(ids) for g, ids in groups.items()} | {None: 1}
    kinds = ranges.select("n", F.bitmap_count("bits").alias("bits"), F.size("few").alias("few")).collect()
    assert {r["bits"] is None for r in kinds} == {True, False}
    for r in kinds:
        assert r["n"] == (r["bits"] if r["n"] >= m.DENSE else r["few"])


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("dense", [1, 512, 10**6])
def test_keys_with_any_equal_sets(spark, pairs, monkeypatch, broadcast, dense):
    groups, df = pairs
    monkeypatch.setattr(m, "fits_broadcast", lambda df: broadcast)
    ranges = member_ranges(df.filter("g is not null"), "g", "id", dense).cache()
    rnd = random.Random(dense)
    for ids in (
        [77], [2**40], [32_769, 99_999], [], [None], [-32_768], [0], list(range(65_538, 98_306, 2)), list(range(65_536, 98_306)),
        rnd.sample(range(-50_000, 60_000), 2_000), list(range(-39_999, -38_000, 7)),
    ):
        wanted = spark.createDataFrame([(i,) for i in ids], "id long")
        got = {r["g"] for r in keys_with_any(ranges, "g", wanted, "id", dense).collect()}
        assert got == {g for g, own in groups.items() if set(own) & set(ids)}
    ranges.unpersist()


def test_no_cell_grows_with_its_group(spark):
    """Ten million members: a bitmap for each range of ids, nothing longer."""
    everyone = spark.range(1, 10_000_001, numPartitions=8).select(F.lit("all").alias("g"), "id")
    ranges = member_ranges(everyone, "g", "id").agg(
        F.sum("n").alias("n"), F.count("*").alias("ranges"), F.max(F.octet_length("bits")).alias("bytes"), F.max(F.size("few")).alias("few")
    )
    row = ranges.first()
    assert (row["n"], row["ranges"], row["bytes"]) == (10_000_000, 306, 4096)
    assert (row["few"] or 0) < m.DENSE
