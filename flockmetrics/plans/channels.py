"""Channels mart: one row per channel that was ever posted in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.links import anchor, channel_name, url_slug
from flockmetrics.functions.scores import (
    avg_where,
    change,
    count_where,
    sum_only_where,
    sum_where,
    tier_label,
    tier_level,
    weighted_score,
)
from flockmetrics.operators.domains import linked_posts, top_domains
from flockmetrics.operators.lists import distinct_list, top_k_list
from flockmetrics.operators.rollups import engaged_casts
from flockmetrics.settings import CHANNEL_URL, SPACER, Settings
from flockmetrics.sources.tables import DAY, SocialTables, not_deleted, rows_up_to_now, thread_channel_key

WEEKS = (("this_week", ""), ("last_week", "_last"))
TIER_COUNTS = ("active_npc", "active_user", "active_star", "active_influencer", "active_vip")
LEADING_TIER = 3
USER_DETAILS = ("fname", "fid_active_tier", "total_transactions", "trading_volume_usd", "contracts_deployed")
ROLLING = ("rolling_casts", "rolling_replies", "rolling_likes", "rolling_recasts")


def in_channel() -> Column:
    return thread_channel_key().isNotNull()


def cast_engagement(engaged: DataFrame) -> DataFrame:
    """Live channel posts of the activity window with their likes, recasts and replies."""
    return engaged.filter(in_channel()).withColumn("parent_url", thread_channel_key()).drop("root_parent_url")


def caster_activity(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per channel and author: posts, engagement and rolling counts of both weeks."""
    score = weighted_score(F.col("likes"), F.col("recasts"), F.col("replies"), settings.engagement)
    measures = [F.sum(F.when(F.col("this_week") & F.col("is_root"), 1).otherwise(0)).alias("casts_in_channel")]
    for week, suffix in WEEKS:
        inside = F.col(week)
        measures += [
            count_where(inside).alias("active" + suffix),
            sum_where(inside, score).alias("engagement" + suffix),
            count_where(inside & F.col("is_top_level")).alias("rolling_casts" + suffix),
            count_where(inside & ~F.col("is_top_level")).alias("rolling_replies" + suffix),
            sum_only_where(inside, F.col("likes")).alias("rolling_likes" + suffix),
            sum_only_where(inside, F.col("recasts")).alias("rolling_recasts" + suffix),
        ]
    return posts.groupBy("parent_url", "fid").agg(*measures)


def caster_summary(activity: DataFrame, users: DataFrame) -> DataFrame:
    """Activity with the author's standing in the users mart.

    Mart rows of one account that differ (several names) each get a row; equal ones are merged
    into one and multiply its sums by ``copies``. ``counted`` marks one row per author, so sums
    that have nothing to do with the mart take each author once.
    """
    standing = users.groupBy("fid", *USER_DETAILS).agg(F.count("*").alias("copies"))
    first = F.row_number().over(Window.partitionBy("fid").orderBy(*USER_DETAILS)) == 1
    standing = standing.withColumn("counted", first)
    # An author has one row per channel, so no author holds many.
    joined = activity.join(standing, "fid", "left")
    copies = F.coalesce("copies", F.lit(1))
    return (
        joined.withColumn("counted", F.coalesce("counted", F.lit(True)))
        .withColumns({name: F.col(name) * copies for name in ("casts_in_channel", "engagement", "engagement_last")})
        .drop("copies")
    )


def channel_cast_stats(summary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per channel: rolling counts, engagement, active authors per tier, means over transacting authors."""
    measures = []
    for _, suffix in WEEKS:
        seen = F.col("active" + suffix) > 0
        known = F.when(F.col("counted") & seen, F.col("fid"))
        casters = (
            F.approx_count_distinct(known, settings.sketch_error)
            if settings.approx_casters
            else F.count(known)  # one counted row per author
        )
        measures += [casters.alias("casters" + suffix), F.sum("engagement" + suffix).alias("engagement" + suffix)]
        measures += [F.sum(F.when(F.col("counted"), F.col(name + suffix))).alias(name + suffix) for name in ROLLING]
        measures += [
            count_where(seen & (F.col("fid_active_tier") == tier)).alias(name + suffix)
            for tier, name in enumerate(TIER_COUNTS)
        ]
    transacting = F.col("total_transactions") > 0
    means = {
        "avg_txs": "total_transactions",
        "avg_volume_usd": "trading_volume_usd",
        "avg_contracts_deployed": "contracts_deployed",
    }
    measures += [avg_where(transacting, F.col(source)).alias(name) for name, source in means.items()]
    return summary.groupBy("parent_url").agg(*measures)


def sketched_counts(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per channel: posts, replies and authors of both weeks, counted by sketches."""
    measures = []
    for week, suffix in WEEKS:
        kinds = {
            "rolling_casts": F.when(F.col(week) & F.col("is_top_level"), F.col("hash")),
            "rolling_replies": F.when(F.col(week) & ~F.col("is_top_level"), F.col("hash")),
            "casters": F.when(F.col(week), F.col("fid")),
        }
        measures += [F.approx_count_distinct(kind, settings.sketch_error).alias(name + suffix) for name, kind in kinds.items()]
    return posts.groupBy("parent_url").agg(*measures)


def top_casters(summary: DataFrame, k: int = 10) -> DataFrame:
    order = [F.col("casts_in_channel").desc(), F.col("fname").asc_nulls_last(), F.col("fid").asc()]
    return top_k_list(summary, ["parent_url"], order, "fname", k, "top_casters")


def influential_casters(summary: DataFrame, k: int = 10) -> DataFrame:
    """Influencers and vips by tier, then posts; a channel without any has no row."""
    order = [
        F.col("fid_active_tier").desc(),
        F.col("casts_in_channel").desc(),
        F.col("fname").asc_nulls_last(),
        F.col("fid").asc(),
    ]
    leaders = summary.filter(F.col("fid_active_tier") >= LEADING_TIER)
    return top_k_list(leaders, ["parent_url"], order, "fname", k, "influential_casters")


def channel_members(casts: DataFrame, clock: Clock) -> DataFrame:
    """Bridge of channels and everyone who ever posted there, with the first post's time.

    Filters look members up here; the list column of the mart is for display.
    """
    kept = rows_up_to_now(casts, clock).filter(not_deleted(casts, clock) & in_channel())
    return kept.groupBy(thread_channel_key().alias("parent_url"), "fid").agg(
        F.min("created_at").alias("first_cast_at")
    )


def extend_members(known: DataFrame, casts: DataFrame, clock: Clock, since: Clock) -> DataFrame:
    """The bridge as of ``clock`` from the one stored as of ``since``: only later days are read.

    A post that was deleted in between stays in the stored rows; rebuild the bridge where that matters.
    """
    later = F.col("created_at") > since.instant(casts, "created_at")
    if DAY in casts.columns:
        later = later & (F.col(DAY) >= F.to_date(since.instant(casts, "created_at")))
    new = channel_members(casts.filter(later), clock)
    return known.unionByName(new).groupBy("parent_url", "fid").agg(F.min("first_cast_at").alias("first_cast_at"))


def channel_ages(members: DataFrame, clock: Clock) -> DataFrame:
    """Calendar days since the first post."""
    today = F.to_date(clock.instant(members, "first_cast_at"))
    age = F.datediff(today, F.to_date(F.min("first_cast_at"))).cast("long")
    return members.groupBy("parent_url").agg(age.alias("channel_age"))


def channel_domains(linked: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Top three sites linked from each channel this week."""
    this_week = linked.filter(F.col("this_week") & in_channel())
    return top_domains(this_week, thread_channel_key(), "parent_url", settings.ignored_domains)


def with_member_lists(channels: DataFrame, members: DataFrame) -> DataFrame:
    """Channels with everyone who ever posted there as a list in the last column.

    The list is for display; nothing in this package reads it, as ``members`` says the same.
    """
    lists = distinct_list(members, "parent_url", "fid", "all_caster_fids")
    return channels.join(lists, "parent_url", "left").select(*channels.columns, "all_caster_fids")


def by_engagement(mart: DataFrame) -> DataFrame:
    return mart.orderBy(F.desc_nulls_last("engagement"), F.asc("parent_url"))


def as_is(df: DataFrame, name: str) -> DataFrame:
    """Keeps nothing: every reader computes ``df`` for itself."""
    return df


def channels_mart(
    tables: SocialTables,
    clock: Clock,
    users: DataFrame,
    settings: Settings = Settings(),
    engaged: DataFrame | None = None,
    linked: DataFrame | None = None,
    members: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = as_is,
    member_lists: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Mart columns after the raw channel key ``parent_url``, which joins and filters use.

    ``users`` is the users mart; ``engaged``, ``linked`` and ``members`` pass in stored rows of
    ``engaged_casts``, ``linked_posts`` and ``channel_members``. ``keep(df, name)`` may store results
    that are read several times. Without ``member_lists`` the last column is left out.
    """
    if engaged is None:
        engaged = engaged_casts(tables.casts, tables.reactions, clock)
    if linked is None:
        linked = linked_posts(tables.casts, clock)
    if members is None:
        members = keep(channel_members(tables.casts, clock), "channel_members")
    activity = caster_activity(cast_engagement(engaged), settings)
    summary = keep(caster_summary(activity, users), "caster_summary")

    slugs = tables.early_channels.select("parent_url", "channel_id")
    joined = (
        channel_ages(members, clock)
        .join(channel_cast_stats(summary, settings), "parent_url", "left")
        .join(top_casters(summary), "parent_url", "left")
        .join(influential_casters(summary), "parent_url", "left")
        .join(channel_domains(linked, settings), "parent_url", "left")
    )
    named = joined.join(slugs, "parent_url", "left")

    # A channel without a post in two weeks has counted 0 posts and casters, but no sums.
    counts = [name + suffix for name in ("rolling_casts", "rolling_replies", "casters") for _, suffix in WEEKS]
    named = named.withColumns({name: F.coalesce(name, F.lit(0)) for name in counts})

    def tier_inputs(suffix: str) -> dict[str, Column]:
        return {
            "casts": F.col("rolling_casts" + suffix),
            "engagement": F.col("engagement" + suffix),
            "casters": F.col("casters" + suffix),
            "stars": F.col("active_star" + suffix),
            "leaders": F.col("active_influencer" + suffix) + F.col("active_vip" + suffix),
        }

    def wow(name: str) -> Column:
        return change(F.col(name), F.col(name + "_last"))

    slug = F.coalesce("channel_id", url_slug(F.col("parent_url")))
    page = F.coalesce(F.concat(F.lit(CHANNEL_URL), slug), "parent_url")
    mart = named.select(
        "parent_url",
        tier_label(settings.channel_tiers, tier_inputs("")).alias("channel_tier_name"),
        tier_level(settings.channel_tiers, tier_inputs("")).alias("channel_tier"),
        tier_level(settings.channel_tiers, tier_inputs("_last")).alias("channel_tier_last"),
        anchor(page, channel_name(F.col("channel_id"), F.col("parent_url"))).alias("channel"),
        "channel_age",
        F.slice("influential_casters", 1, 3).alias("influential_casters"),
        F.col("rolling_casts").alias("rolling_7_casts"),
        wow("rolling_casts").alias("wow_cast"),
        "engagement",
        wow("engagement").alias("wow_engage"),
        F.lit(SPACER).alias("split_1"),
        "active_npc",
        wow("active_npc").alias("wow_npc"),
        "active_user",
        wow("active_user").alias("wow_active_user"),
        "active_star",
        wow("active_star").alias("wow_star"),
        "active_influencer",
        wow("active_influencer").alias("wow_influencer"),
        "active_vip",
        wow("active_vip").alias("wow_vip"),
        F.lit(SPACER).alias("split_0"),
        F.col("rolling_replies").alias("rolling_7_replies"),
        wow("rolling_replies").alias("wow_reply"),
        F.col("rolling_likes").alias("rolling_7_likes"),
        wow("rolling_likes").alias("wow_likes"),
        F.col("rolling_recasts").alias("rolling_7_recasts"),
        wow("rolling_recasts").alias("wow_recasts"),
        F.lit(SPACER).alias("split_2"),
        "avg_txs",
        "avg_volume_usd",
        "avg_contracts_deployed",
        "top_domains",
        F.slice("top_casters", 1, 3).alias("top_casters"),
    )
    if member_lists:
        mart = with_member_lists(mart, members)
    return by_engagement(mart) if ordered else mart
