"""Counts per person and per post that several marts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.scores import count_where
from flockmetrics.sources.tables import live_rows, not_deleted, rows_up_to_now

LIKE, RECAST = 1, 2


def followers(links: DataFrame, clock: Clock) -> DataFrame:
    """All undeleted follows per followed account, and those of the last week."""
    kept = rows_up_to_now(links, clock).filter(not_deleted(links, clock))
    return kept.groupBy(F.col("target_fid").alias("fid")).agg(
        F.count("*").alias("followers"),
        count_where(clock.this_week(links)).alias("wow_followers"),
    )


def by_others(reactions: DataFrame) -> DataFrame:
    """Reactions to somebody else's posts."""
    return reactions.filter(F.col("fid") != F.col("target_fid"))


def is_top_level() -> Column:
    return F.col("parent_hash").isNull()


def is_root() -> Column:
    return F.col("root_parent_hash").isNull()


def reactions_received(reactions: DataFrame, clock: Clock) -> DataFrame:
    """Likes and recasts per post in the activity window, not counting one's own."""
    return by_others(live_rows(reactions, clock)).groupBy(F.col("target_hash").alias("hash")).agg(
        count_where(F.col("reaction_type") == LIKE).alias("likes"),
        count_where(F.col("reaction_type") == RECAST).alias("recasts"),
    )


def replies_received(casts: DataFrame, clock: Clock) -> DataFrame:
    """Replies by others per thread root in the activity window; meant for live roots, as the
    author of any other root is not looked up.

    Replies are counted per (root, replier) first. Only the pair of a root and its own author
    has to be looked up, and that pair is unique on both sides, so a root that draws a third of
    all replies is spread over its repliers throughout.
    """
    live = live_rows(casts, clock)
    per_replier = (
        live.filter(F.col("root_parent_hash").isNotNull() & F.col("fid").isNotNull())
        .groupBy(F.col("root_parent_hash").alias("hash"), "fid")
        .agg(F.count("*").alias("n"))
    )
    return replies_by_others(per_replier, live)


def replies_by_others(per_replier: DataFrame, posts: DataFrame) -> DataFrame:
    """Replies per root from counts ``n`` per (root ``hash``, replier ``fid``), without those of a root's author."""
    authors = posts.select("hash", "fid", F.lit(True).alias("is_author"))
    return (
        per_replier.join(authors, ["hash", "fid"], "left")
        .filter(F.col("is_author").isNull())
        .groupBy("hash")
        .agg(F.sum("n").alias("replies"))
    )


def engaged_rows(posts: DataFrame, received: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts with their likes and recasts, NULL without any reaction, and replies, 0 without any."""
    count = F.when(F.col("fid").isNull(), 0).otherwise(F.coalesce("replies", F.lit(0)))
    return posts.join(received, "hash", "left").join(replies, "hash", "left").withColumn("replies", count)


def engaged_casts(casts: DataFrame, reactions: DataFrame, clock: Clock) -> DataFrame:
    """One slim row per live post of the activity window with what it received.

    ``likes`` and ``recasts`` stay NULL without any reaction; ``replies`` is 0 without replies.
    """
    live = live_rows(casts, clock)
    posts = live.select(
        "hash",
        "fid",
        "parent_url",
        "root_parent_url",
        is_top_level().alias("is_top_level"),
        is_root().alias("is_root"),
        clock.this_week(live).alias("this_week"),
        clock.last_week(live).alias("last_week"),
    )
    return engaged_rows(posts, reactions_received(reactions, clock), replies_received(casts, clock))
