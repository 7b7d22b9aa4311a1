"""Members of groups by ranges of ids: a bitmap where a range is well filled, a short list where it is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.operators.joins import fits_broadcast, heavy_key_join

# Spark's bitmaps have 32,768 bits, 4,096 bytes: as many as this number of ids.
DENSE = 512
_WORDS = 512


def _ranges(ids: DataFrame, keys: list[str], member: str, dense: int) -> DataFrame:
    """Per key and range: n, and either ``bits`` or ``few`` (ids in order). A range holds at most 32,768
    different ids, so no cell grows with the group."""
    number = F.bitmap_bucket_number(member).alias("range")
    grouped = ids.filter(F.col(member).isNotNull()).groupBy(*keys, number).agg(
        F.count("*").alias("n"),
        F.bitmap_construct_agg(F.bitmap_bit_position(member)).alias("bits"),
        F.sort_array(F.collect_list(member)).alias("few"),
    )
    full = F.col("n") >= dense
    return grouped.select(*keys, "range", "n", F.when(full, F.col("bits")).alias("bits"), F.when(~full, F.col("few")).alias("few"))


def member_ranges(pairs: DataFrame, key: str, member: str, dense: int = DENSE) -> DataFrame:
    """(key, range, n, bits, few) from pairs that are distinct; members that are NULL are in no range."""
    return _ranges(pairs.select(key, member), [key], member, dense)


def member_counts(ranges: DataFrame, key: str) -> DataFrame:
    return ranges.groupBy(key).agg(F.sum("n").alias("members"))


def _word(bits: Column, i: Column) -> Column:
    """Eight bytes of a bitmap as a number; both sides of an intersection are read the same way."""
    return F.conv(F.hex(F.substring(bits, 8 * i + 1, F.lit(8))), 16, -10).cast("long")


def _has(bits: Column, member: Column) -> Column:
    at = F.bitmap_bit_position(member)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("long") % 2 == 1


def keys_with_any(ranges: DataFrame, key: str, ids: DataFrame, member: str, dense: int = DENSE) -> DataFrame:
    """Keys that have any of ``ids`` (distinct) as a member: a range meets the same range of ``ids`` only."""
    wanted = _ranges(ids.select(member), [], member, dense).select(
        "range", F.col("bits").alias("wanted_bits"), F.col("few").alias("wanted_few")
    )
    if fits_broadcast(wanted):
        met = ranges.join(F.broadcast(wanted), "range")
    else:
        # There are few ranges, and each may hold most groups.
        met = heavy_key_join(ranges, wanted, "range", "inner", spread_by=[key])
    words = F.sequence(F.lit(0), F.lit(_WORDS - 1))
    both = (
        F.when(
            F.col("bits").isNotNull() & F.col("wanted_bits").isNotNull(),
            F.exists(words, lambda i: _word(F.col("bits"), i).bitwiseAND(_word(F.col("wanted_bits"), i)) != 0),
        )
        .when(F.col("bits").isNotNull(), F.exists("wanted_few", lambda m: _has(F.col("bits"), m)))
        .when(F.col("wanted_bits").isNotNull(), F.exists("few", lambda m: _has(F.col("wanted_bits"), m)))
        .otherwise(F.arrays_overlap("few", "wanted_few"))
    )
    return met.filter(both).select(key).distinct()
