"""Ordered lists per group that keep NULL elements and are NULL, not empty, without elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_list(order: Sequence[Column], value: Column, condition: Column | None = None) -> Column:
    """Aggregate: values in ascending ``order``, NULL elements first; then by the value itself."""
    entry = F.struct(*(key.alias(f"k{i}") for i, key in enumerate(order)), value.alias("v"))
    if condition is not None:
        entry = F.when(condition, entry)
    entries = F.sort_array(F.collect_list(entry))
    return F.transform(F.when(F.size(entries) > 0, entries), lambda e: e["v"])


def top_k_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``place``.

    Every task cuts its part of a group to ``k`` rows before the shuffle, so a hot group is
    never gathered whole.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def top_k_list(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, k: int, name: str
) -> DataFrame:
    first_k = top_k_rows(df, keys, order, k)
    return first_k.groupBy(*keys).agg(ordered_list([F.col("place")], F.col(value)).alias(name))


def distinct_list(pairs: DataFrame, key: str, member: str, name: str, pieces: int = 64) -> DataFrame:
    """Sorted list of the members of each key, from pairs that are already distinct.

    Members are first packed into ``pieces`` short lists per key in separate tasks. The cell
    itself is as long as the key has members; use the pairs where that is not wanted.
    """
    piece = F.pmod(F.xxhash64(member), F.lit(pieces)).alias("_piece")
    packed = pairs.groupBy(key, piece).agg(F.collect_list(F.struct(F.col(member).alias("v"))).alias("_part"))
    whole = packed.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("_part"))).alias("_all"))
    return whole.select(key, F.transform("_all", lambda e: e["v"]).alias(name))
