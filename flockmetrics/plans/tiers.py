"""How many users or channels stand on each tier, and the change since last week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.functions.scores import change, label_of_level
from flockmetrics.settings import Settings, TierRule


def _by_tier(mart: DataFrame, level: str, last: str, what: str, rules: Sequence[TierRule]) -> DataFrame:
    """One pass: rows are counted per (tier now, tier last week), a handful of groups, and each
    group then adds to its tier of either week. A tier nobody stands on now has no row."""
    moves = mart.groupBy(level, last).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(level).alias("tier"), F.col("n").alias("now"), zero.alias("before")),
        F.struct(F.col(last).alias("tier"), zero.alias("now"), F.col("n").alias("before")),
    )
    counts = (
        moves.select(F.inline(sides))
        .groupBy("tier")
        .agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
        .filter(F.col("now") > 0)
    )
    return counts.select(
        label_of_level(rules, F.col("tier")).alias(level + "_name"),
        F.col("tier").alias(level),
        F.col("now").alias(what),
        change(F.col("now"), F.col("before")).alias("wow_" + what),
    ).orderBy(F.desc(level))


def users_by_tier(users: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return _by_tier(users, "fid_active_tier", "fid_active_tier_last", "users", settings.user_tiers)


def channels_by_tier(channels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return _by_tier(channels, "channel_tier", "channel_tier_last", "channels", settings.channel_tiers)
