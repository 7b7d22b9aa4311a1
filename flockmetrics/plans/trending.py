"""The marts narrowed by optional filters: account or channel age, channel, people, holdings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.text import contains_text
from flockmetrics.operators.joins import fits_broadcast, heavy_key_join
from flockmetrics.operators.members import keys_with_any
from flockmetrics.operators.wallets import address_book, token_holders
from flockmetrics.plans.channels import as_is, with_member_lists
from flockmetrics.settings import RESULT_LIMIT
from flockmetrics.sources.tables import SocialTables, live_rows

# Parameter texts that stand for "no filter".
ALL_CHANNELS, NO_FILTER, NONE, ALL_USERS, ALL = "all channels", "no filter", "none", "all users", "all"
ACTIONS = ("reply", "follow", "react")


def _optional(text: str | None, unset: str) -> str | None:
    return None if text is None or text == unset else text


@dataclass(frozen=True)
class UserFilters:
    max_age_days: int
    channel: str | None = None
    tracked_user: str | None = None
    action: str = ALL
    held_token: str | None = None
    sort_by: str = "followers"

    @classmethod
    def from_texts(
        cls, days_old: str | int, channel: str, tracked_user: str, action: str, held_token: str, sort_by: str
    ) -> UserFilters:
        """Parameters as texts, with the phrases that switch a filter off."""
        return cls(
            int(days_old),
            _optional(channel, ALL_CHANNELS),
            _optional(tracked_user, NO_FILTER),
            action,
            _optional(held_token, NONE),
            sort_by,
        )


@dataclass(frozen=True)
class ChannelFilters:
    max_age_days: int
    username: str | None = None
    held_token: str | None = None
    sort_by: str = "engagement"

    @classmethod
    def from_texts(cls, days_old: str | int, username: str, held_token: str, sort_by: str) -> ChannelFilters:
        return cls(int(days_old), _optional(username, ALL_USERS), _optional(held_token, NONE), sort_by)


def fid_of_name(profiles: DataFrame, name: str) -> DataFrame:
    """The lowest id registered under a name: one row, with NULL if there is none."""
    return profiles.filter(F.col("fname") == name).agg(F.min("fid").alias("fid"))


def reply_targets(replies: DataFrame, casts: DataFrame) -> DataFrame:
    """Replies with ``target_fid``: who wrote the post ``parent_hash`` that is answered directly, NULL
    when it is unknown.

    ``replies`` is read twice. If they are few they go to the posts, so that all posts ever are
    scanned but not shuffled.
    """
    wanted = replies.select(F.col("parent_hash").alias("hash"))
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    parents = casts.select("hash", F.col("fid").alias("target_fid")).join(wanted, "hash", "left_semi")
    parents = parents.withColumnRenamed("hash", "parent_hash")
    return heavy_key_join(replies, parents, "parent_hash", "left", spread_by=["fid"])


def interaction_targets(
    tables: SocialTables, clock: Clock, name: str, keep: Callable[[DataFrame, str], DataFrame] = as_is
) -> DataFrame:
    """Whom a user replied to, followed and reacted to in the activity window, tagged by action.

    ``keep(df, name)`` may store the user's replies, which are read twice.
    """
    person = F.broadcast(fid_of_name(tables.profiles, name))  # a global aggregate: one row

    def done_by_person(df: DataFrame) -> DataFrame:
        return live_rows(df, clock).join(person, "fid", "left_semi")

    replies = keep(done_by_person(tables.casts).select("fid", "parent_hash").distinct(), "replies")
    replied = reply_targets(replies, tables.casts).select("fid", "target_fid").distinct()
    followed = done_by_person(tables.links).select("fid", "target_fid").distinct()
    reacted = done_by_person(tables.reactions).select("fid", "target_fid").distinct()
    return tagged(dict(zip(ACTIONS, (replied, followed, reacted), strict=True)))


def tagged(rows_by_action: Mapping[str, DataFrame]) -> DataFrame:
    """All rows with the action they stand for."""
    return reduce(DataFrame.unionByName, (rows.withColumn("action", F.lit(action)) for action, rows in rows_by_action.items()))


def _sorted_top(df: DataFrame, sort_by: str, tie_breakers: Sequence[str], limit: int) -> DataFrame:
    if sort_by not in df.columns:
        raise ValueError(f"cannot sort by {sort_by!r}; columns are {df.columns}")
    return df.orderBy(F.desc_nulls_last(sort_by), *map(F.asc_nulls_last, tie_breakers)).limit(limit)


def _holders(tables: SocialTables, addresses: DataFrame | None, token: str) -> DataFrame:
    if addresses is None:
        addresses = address_book(tables.fids, tables.verifications)
    return token_holders(addresses, tables.wallet_activity, token)


def trending_users(
    users: DataFrame,
    tables: SocialTables,
    clock: Clock,
    filters: UserFilters,
    limit: int = RESULT_LIMIT,
    addresses: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = as_is,
) -> DataFrame:
    """``addresses`` passes in stored ``address_book`` rows, here and for channels."""
    found = users.filter(F.col("account_age") <= filters.max_age_days)
    if filters.channel is not None:
        found = found.filter(F.exists("all_channels", lambda name: contains_text(name, filters.channel)))
    if filters.tracked_user is not None:
        targets = interaction_targets(tables, clock, filters.tracked_user, keep)
        if filters.action != ALL:
            targets = targets.filter(F.col("action") == filters.action)
        found = found.join(targets.select(F.col("target_fid").alias("fid")), "fid", "left_semi")
    if filters.held_token is not None:
        found = found.join(_holders(tables, addresses, filters.held_token), "fid", "left_semi")
    return _sorted_top(found.select(*users.columns), filters.sort_by, ("fid", "fname"), limit)


def trending_channels(
    channels: DataFrame,
    members: DataFrame,
    tables: SocialTables,
    filters: ChannelFilters,
    limit: int = RESULT_LIMIT,
    addresses: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = as_is,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """``channels`` is the mart without member lists: people are looked up in the bridge
    ``members``, and lists are made for the channels that are left. With a token, any holder
    among the members is enough; ``ranges``, the ``member_ranges`` of the bridge, answers that without
    shuffling pairs. ``keep(df, name)`` may store the rows before that."""
    found = channels.filter(F.col("channel_age") <= filters.max_age_days)
    if filters.username is not None:
        person = F.broadcast(fid_of_name(tables.profiles, filters.username.lower()))
        theirs = members.join(person, "fid", "left_semi").select("parent_url")
        found = found.join(theirs, "parent_url", "left_semi")
    if filters.held_token is not None:
        holders = _holders(tables, addresses, filters.held_token)
        if ranges is not None:
            held_in = keys_with_any(ranges, "parent_url", keep(holders, "holders"), "fid")
        else:
            # A person has one row per channel, so no person holds many.
            held_in = members.join(holders, "fid", "left_semi")
        found = found.join(held_in.select("parent_url").distinct(), "parent_url", "left_semi")
    top = keep(_sorted_top(found.select(*channels.columns), filters.sort_by, ("parent_url",), limit), "trending_channels")
    shown = members.join(top.select("parent_url"), "parent_url", "left_semi")
    return with_member_lists(top, shown).orderBy(F.desc_nulls_last(filters.sort_by), F.asc("parent_url"))
