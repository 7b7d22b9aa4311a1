"""Users mart: one row per account that posted in the activity window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.links import anchor, channel_name
from flockmetrics.functions.scores import change, sum_where, tier_label, tier_level, weighted_score
from flockmetrics.operators.domains import linked_posts, top_domains
from flockmetrics.operators.joins import dimension_join
from flockmetrics.operators.lists import ordered_list
from flockmetrics.operators.rollups import engaged_casts, followers
from flockmetrics.operators.wallets import address_book, wallet_totals
from flockmetrics.settings import PROFILE_URL, SPACER, Settings
from flockmetrics.sources.tables import SocialTables, channel_key, rows_up_to_now

COUNTS = ("casts", "got_replies", "got_likes", "got_recasts")
WEEKLY_COUNTS = (*COUNTS, *(f"{name}_last" for name in COUNTS))


def user_channel_activity(engaged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Posts, replies, likes and recasts per author and channel, this week and last.

    The week is the post's. Posts outside any channel form one group with a NULL channel.
    """
    times = F.greatest(F.lit(1), F.col("replies")) if settings.repeat_likes else F.lit(1)
    values = {
        "casts": F.lit(1),
        "got_replies": F.col("replies"),
        "got_likes": F.col("likes") * times,
        "got_recasts": F.col("recasts") * times,
    }
    sums = [
        sum_where(F.col(week), value).alias(name + suffix)
        for week, suffix in (("this_week", ""), ("last_week", "_last"))
        for name, value in values.items()
    ]
    return engaged.groupBy("fid", channel_key().alias("parent_url")).agg(*sums)


def user_activity(per_channel: DataFrame, early_channels: DataFrame) -> DataFrame:
    """Sums over an author's channels and the channel names, most posts this week first."""
    slugs = early_channels.select("parent_url", "channel_id")
    named = dimension_join(per_channel, slugs, "parent_url", "left", spread_by=["fid"])
    name = channel_name(F.col("channel_id"), F.col("parent_url"))
    return named.groupBy("fid").agg(
        *(F.sum(count).alias(count) for count in WEEKLY_COUNTS),
        ordered_list([-F.col("casts")], name, F.col("parent_url").isNotNull()).alias("all_channels"),
    )


def _tier_inputs(settings: Settings, suffix: str, follower_count: Column) -> dict[str, Column]:
    likes, recasts, replies = (F.col(f"got_{kind}{suffix}") for kind in ("likes", "recasts", "replies"))
    return {
        "followers": follower_count,
        "casts": F.col("casts" + suffix),
        "score": weighted_score(likes, recasts, replies, settings.tier_score),
    }


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Different profiles, one row each. Rows that differ in addresses only are kept apart where the
    table has that column."""
    details = [c for c in ("fid", "fname", "verified_addresses") if c in profiles.columns]
    return profiles.select(*details).distinct().select("fid", "fname")


@dataclass(frozen=True)
class AccountSides:
    """What the users mart joins by account and no post takes part in."""

    followers: DataFrame
    profiles: DataFrame
    signed_up: DataFrame
    wallets: DataFrame

    def kept(self, keep: Callable[[DataFrame, str], DataFrame]) -> AccountSides:
        """Each side as ``keep(df, name)`` stores it, such as ``store_bucketed`` by ``fid``."""
        return AccountSides(**{name: keep(df, name) for name, df in vars(self).items()})


def account_sides(
    tables: SocialTables, clock: Clock, addresses: DataFrame | None = None, follow_counts: DataFrame | None = None
) -> AccountSides:
    if addresses is None:
        addresses = address_book(tables.fids, tables.verifications)
    return AccountSides(
        followers=followers(tables.links, clock) if follow_counts is None else follow_counts,
        profiles=profile_rows(tables.profiles),
        signed_up=rows_up_to_now(tables.fids, clock).select("fid", F.col("created_at").alias("signed_up_at")),
        wallets=wallet_totals(addresses, tables.wallet_activity),
    )


def users_mart(
    tables: SocialTables,
    clock: Clock,
    settings: Settings = Settings(),
    engaged: DataFrame | None = None,
    linked: DataFrame | None = None,
    addresses: DataFrame | None = None,
    ordered: bool = True,
    follow_counts: DataFrame | None = None,
    sides: AccountSides | None = None,
) -> DataFrame:
    """``engaged``, ``linked``, ``addresses`` and ``follow_counts`` pass in rows of ``engaged_casts``,
    ``linked_posts``, ``address_book`` and ``followers``, ``sides`` those of ``account_sides``; ``ordered`` sorts by
    followers."""
    if engaged is None:
        engaged = engaged_casts(tables.casts, tables.reactions, clock)
    activity = user_activity(user_channel_activity(engaged, settings), tables.early_channels)
    if linked is None:
        linked = linked_posts(tables.casts, clock)
    domains = top_domains(linked, F.col("fid"), "fid", settings.ignored_domains)
    if sides is None:
        sides = account_sides(tables, clock, addresses, follow_counts)
    now = clock.instant(tables.fids, "created_at")

    joined = (
        activity.join(sides.followers, "fid", "left")
        .join(sides.profiles, "fid", "left")
        .join(sides.signed_up, "fid", "left")
        .join(sides.wallets, "fid", "left")
        .join(domains, "fid", "left")
    )

    def engagement(suffix: str = "") -> Column:
        parts = (F.col(f"got_{kind}{suffix}") for kind in ("likes", "recasts", "replies"))
        return weighted_score(*parts, settings.engagement)

    this_week = _tier_inputs(settings, "", F.col("followers"))
    last_week = _tier_inputs(settings, "_last", F.col("followers") - F.col("wow_followers"))

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    def wow(count: str) -> Column:
        return change(F.col(count), F.col(count + "_last"))

    mart = joined.select(
        tier_label(settings.user_tiers, this_week).alias("fid_active_tier_name"),
        tier_level(settings.user_tiers, this_week).alias("fid_active_tier"),
        tier_level(settings.user_tiers_last, last_week).alias("fid_active_tier_last"),
        "fid",
        "fname",
        anchor(F.concat(F.lit(PROFILE_URL), "fname"), F.col("fname")).alias("fname_link"),
        F.timestamp_diff("DAY", F.col("signed_up_at"), now).alias("account_age"),
        F.array_size("all_channels").cast("long").alias("channels"),
        F.slice("all_channels", 1, 3).alias("top_channels"),
        F.slice("top_domains", 1, 2).alias("top_domains"),
        or_zero("followers"),
        or_zero("wow_followers"),
        "casts",
        wow("casts").alias("wow_casts"),
        engagement().alias("engagement"),
        change(engagement(), engagement("_last")).alias("wow_engage"),
        or_zero("total_transactions"),
        F.coalesce("trading_volume_usd", F.lit(0.0)).alias("trading_volume_usd"),
        or_zero("contracts_deployed"),
        F.lit(SPACER).alias("split_0"),
        "got_likes",
        wow("got_likes").alias("wow_likes"),
        "got_recasts",
        wow("got_recasts").alias("wow_recasts"),
        "got_replies",
        wow("got_replies").alias("wow_replies"),
        "addresses",
        "all_channels",
        F.col("top_domains").alias("all_domains"),
    )
    return by_followers(mart) if ordered else mart


def by_followers(mart: DataFrame) -> DataFrame:
    return mart.orderBy(F.desc_nulls_last("followers"), F.asc("fid"), F.asc_nulls_last("fname"))
