"""What the marts are built on, brought forward from one run to the next.

A run reads the rows created since the run before, a log of changes to older rows, and the state
that run has stored; posts, reactions and follows of earlier days are not read again. All states but
the posts are sums: a row that stands counts +1, one that is deleted later -1.

| state | one row per | what |
|---|---|---|
| ``follows`` | followed account | follows that stand |
| ``members`` | channel, author and day | posts that stand, time of the first |
| ``reactions`` | post and day of the window | likes, recasts and reactions by others |
| ``replies`` | thread root, replier and day of the window | replies |
| ``posts`` | post of the window | who, where, when and the linked site, but no text |

Windows begin at an instant. The days after their first are added up from the state; if the first is not
whole, its part is counted from the rows of that one day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.links import link_domain
from flockmetrics.functions.scores import count_where
from flockmetrics.operators.rollups import LIKE, RECAST, by_others, engaged_rows, is_root, is_top_level, replies_by_others
from flockmetrics.settings import LINK_START
from flockmetrics.sources.state import StateStore
from flockmetrics.sources.stored import remove, store
from flockmetrics.sources.tables import DAY, SocialTables, not_deleted, rows_up_to_now, rows_within, thread_channel_key

INSERT, DELETE = "insert", "delete"


@dataclass(frozen=True)
class Changes:
    """Rows of days that have been read before: tables with the columns of their input and ``change``.

    ``insert``: the row has come late. ``delete``: the row stood in the run before and has
    ``deleted_at`` now. The log of a run holds each row once, with its last change; a row that came late and is
    deleted already is an ``insert``. Rows created since the run before are found without the log.
    """

    casts: DataFrame | None = None
    links: DataFrame | None = None
    reactions: DataFrame | None = None


def deletions_between(df: DataFrame, clock: Clock, since: Clock) -> DataFrame:
    """The log of a table without one: rows of before ``since`` that were deleted up to now. Reads the
    whole table, though few columns of it."""
    gone = (F.col("deleted_at") > since.instant(df, "deleted_at")) & (F.col("deleted_at") <= clock.instant(df, "deleted_at"))
    return rows_up_to_now(df, since).filter(gone).withColumn("change", F.lit(DELETE))


def rows_since(df: DataFrame, clock: Clock, since: Clock) -> DataFrame:
    """Rows created after ``since``; a table laid out by ``created_day`` reads no earlier day."""
    start = since.instant(df, "created_at")
    if DAY in df.columns:
        df = df.filter(F.col(DAY) >= F.to_date(start))
    return rows_up_to_now(df.filter(F.col("created_at") > start), clock)


class DailyState:
    """States as of ``clock``. Each is brought forward when it is first asked for, and only once for
    an instant: a run that is repeated, also after it died, finds what it has completed.
    """

    def __init__(self, tables: SocialTables, clock: Clock, states: StateStore, changes: Changes = Changes()) -> None:
        self.tables, self.clock, self.states, self.changes = tables, clock, states, changes

    # --- Bringing a state forward ---

    def _bring(self, name: str, first: Callable[[], DataFrame], step: Callable[[DataFrame, Clock], DataFrame]) -> DataFrame:
        known = self.states.latest(name, self.clock.as_of)
        if known is None:
            return self.states.commit(name, first(), self.clock.as_of)
        if known.as_of == self.clock.as_of:
            return self.states.read(known)
        return self.states.commit(name, step(self.states.read(known), replace(self.clock, as_of=known.as_of)), self.clock.as_of)

    def _standing(self, name: str) -> DataFrame:
        """All rows that stand, with the sign they count by."""
        df = getattr(self.tables, name)
        return rows_up_to_now(df, self.clock).filter(not_deleted(df, self.clock)).withColumn("sign", F.lit(1))

    def _signed(self, name: str, since: Clock) -> DataFrame:
        """Rows that count more or less than at ``since``."""
        df, log = getattr(self.tables, name), getattr(self.changes, name)
        new = rows_since(df, self.clock, since).filter(not_deleted(df, self.clock)).withColumn("sign", F.lit(1))
        if log is None:
            return new
        before = F.col("created_at").isNull() | (F.col("created_at") <= since.instant(log, "created_at"))
        stands = not_deleted(log, self.clock)
        sign = F.when((F.col("change") == INSERT) & stands, 1).when((F.col("change") == DELETE) & ~stands, -1)
        changed = log.filter(before).withColumn("sign", sign).filter(F.col("sign").isNotNull())
        return new.unionByName(changed.select(*[c for c in new.columns if c in changed.columns]), allowMissingColumns=True)

    # --- Days of the window ---

    @property
    def _start(self) -> datetime:
        return self.clock.as_of - timedelta(days=self.clock.active_days)

    @property
    def _first_day(self) -> datetime:
        return self._start.replace(hour=0, minute=0, second=0, microsecond=0)

    def _of_window_days(self, df: DataFrame) -> DataFrame:
        """Rows from the begin of the window's first day on."""
        day = F.lit(self._first_day.date())
        if DAY in df.columns:
            df = df.filter(F.col(DAY).isNull() | (F.col(DAY) >= day))
        start = F.lit(self._first_day.isoformat(sep=" ")).cast(df.schema["created_at"].dataType)
        return df.filter(F.col("created_at") >= start)

    def _tiles(self, name: str, table: str, tile: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
        """Signed counts per key and day of the window."""

        def first() -> DataFrame:
            return tile(self._of_window_days(self._standing(table)))

        def step(known: DataFrame, since: Clock) -> DataFrame:
            kept = known.filter(F.col("day") >= F.lit(self._first_day.date()))
            both = kept.unionByName(tile(self._of_window_days(self._signed(table, since))))
            return both.groupBy(*keys, "day").agg(*(F.sum(c).alias(c) for c in counts)).filter(F.col("n") != 0)

        return self._bring(name, first, step)

    def _window(self, tiles: DataFrame, table: str, tile: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Tiles of the exact window: whole days, and the part of the first that is inside."""
        if self._start == self._first_day:
            return tiles
        df = getattr(self.tables, table)
        tomorrow = self._first_day + timedelta(days=1)
        part = rows_within(df, self.clock, self.clock.active_days).filter(not_deleted(df, self.clock))
        if DAY in df.columns:
            part = part.filter(F.col(DAY) == F.lit(self._first_day.date()))
        part = part.filter(F.col("created_at") < F.lit(tomorrow.isoformat(sep=" ")).cast(df.schema["created_at"].dataType))
        return tiles.filter(F.col("day") > F.lit(self._first_day.date())).unionByName(tile(part.withColumn("sign", F.lit(1))))

    # --- States ---

    @cached_property
    def follow_totals(self) -> DataFrame:
        def count(rows: DataFrame) -> DataFrame:
            return rows.groupBy(F.col("target_fid").alias("fid")).agg(F.sum("sign").alias("followers"))

        def step(known: DataFrame, since: Clock) -> DataFrame:
            both = known.unionByName(count(self._signed("links", since)))
            return both.groupBy("fid").agg(F.sum("followers").alias("followers")).filter(F.col("followers") != 0)

        return self._bring("follows", lambda: count(self._standing("links")), step)

    @cached_property
    def member_days(self) -> DataFrame:
        keys = ["parent_url", "fid", "day"]

        def tile(rows: DataFrame) -> DataFrame:
            added = F.col("sign") > 0
            return rows.filter(thread_channel_key().isNotNull()).groupBy(
                thread_channel_key().alias("parent_url"), "fid", F.to_date("created_at").alias("day")
            ).agg(
                F.sum("sign").alias("n"),
                F.min(F.when(added, F.col("created_at"))).alias("first_cast_at"),
                F.min(F.when(~added, F.col("created_at"))).alias("gone_at"),
            )

        def step(known: DataFrame, since: Clock) -> DataFrame:
            both = known.withColumn("gone_at", F.lit(None).cast(known.schema["first_cast_at"].dataType)).unionByName(
                tile(self._signed("casts", since))
            )
            summed = both.groupBy(*keys).agg(
                F.sum("n").alias("n"), F.min("first_cast_at").alias("first_cast_at"), F.min("gone_at").alias("gone_at")
            )
            merged = store(summed.filter(F.col("n") > 0), "member-days")
            self._passing.append(merged)
            return self._with_true_firsts(merged)

        self._passing: list[DataFrame] = []
        state = self._bring("members", lambda: tile(self._standing("casts")).drop("gone_at"), step)
        for table in self._passing:
            remove(table)
        return state

    def _with_true_firsts(self, merged: DataFrame) -> DataFrame:
        """Where the first post of a day was deleted and others of that day stand, that day is read again for them."""
        lost = merged.filter(F.col("gone_at") <= F.col("first_cast_at"))
        days = [row.day for row in lost.select("day").distinct().collect()]
        if not days:
            return merged.drop("gone_at")
        casts = self._standing("casts")
        day = F.col(DAY) if DAY in casts.columns else F.to_date("created_at")
        again = casts.filter(day.isin(days)).groupBy(
            thread_channel_key().alias("_url"), F.col("fid").alias("_fid"), F.to_date("created_at").alias("_day")
        ).agg(F.min("created_at").alias("_first"))
        same = (F.col("parent_url") == F.col("_url")) & F.col("fid").eqNullSafe(F.col("_fid")) & (F.col("day") == F.col("_day"))
        mended = lost.join(again, same, "left").withColumn("first_cast_at", F.col("_first"))
        whole = merged.filter(F.col("gone_at").isNull() | (F.col("gone_at") > F.col("first_cast_at")) | F.col("first_cast_at").isNull())
        return whole.drop("gone_at").unionByName(mended.select(*[c for c in merged.columns if c != "gone_at"]))

    @staticmethod
    def _reaction_tile(rows: DataFrame) -> DataFrame:
        def signed(kind: int) -> Column:
            return F.sum(F.when(F.col("reaction_type") == kind, F.col("sign")).otherwise(0))

        return by_others(rows).groupBy(F.col("target_hash").alias("hash"), F.to_date("created_at").alias("day")).agg(
            F.sum("sign").alias("n"), signed(LIKE).alias("likes"), signed(RECAST).alias("recasts")
        )

    @staticmethod
    def _reply_tile(rows: DataFrame) -> DataFrame:
        replies = rows.filter(F.col("root_parent_hash").isNotNull() & F.col("fid").isNotNull())
        return replies.groupBy(F.col("root_parent_hash").alias("hash"), "fid", F.to_date("created_at").alias("day")).agg(F.sum("sign").alias("n"))

    @cached_property
    def reaction_days(self) -> DataFrame:
        return self._tiles("reactions", "reactions", self._reaction_tile, ("hash",), ("n", "likes", "recasts"))

    @cached_property
    def reply_days(self) -> DataFrame:
        return self._tiles("replies", "casts", self._reply_tile, ("hash", "fid"), ("n",))

    @cached_property
    def posts(self) -> DataFrame:
        """Posts of the window's days that stand. Their texts are read once, for the linked site."""

        def slim(rows: DataFrame) -> DataFrame:
            linked = F.contains(F.col("text"), F.lit(LINK_START))
            return rows.select(
                "hash", "fid", "parent_url", "root_parent_url", is_top_level().alias("is_top_level"), is_root().alias("is_root"), "created_at",
                linked.alias("linked"), F.when(linked, link_domain(F.col("text"))).alias("domain"),
            )

        def step(known: DataFrame, since: Clock) -> DataFrame:
            changed = self._signed("casts", since)
            gone = changed.filter("sign < 0").select("hash")
            stay = self._of_window_days(known)
            if self.changes.casts is not None:
                stay = stay.join(gone, "hash", "left_anti")
            return stay.unionByName(slim(self._of_window_days(changed.filter("sign > 0"))))

        return self._bring("posts", lambda: slim(self._of_window_days(self._standing("casts"))), step)

    # --- What marts read ---

    def followers(self) -> DataFrame:
        """As ``rollups.followers``."""
        links = self.tables.links
        week = rows_within(links, self.clock, self.clock.recent_days).filter(not_deleted(links, self.clock))
        recent = week.groupBy(F.col("target_fid").alias("fid")).agg(F.lit(0).cast("long").alias("followers"), F.count("*").alias("wow_followers"))
        both = self.follow_totals.withColumn("wow_followers", F.lit(0).cast("long")).unionByName(recent)
        summed = both.groupBy("fid").agg(F.sum("followers").alias("followers"), F.sum("wow_followers").alias("wow_followers"))
        return summed.filter(F.col("followers") > 0)

    def channel_members(self) -> DataFrame:
        """As ``channels.channel_members``."""
        return self.member_days.groupBy("parent_url", "fid").agg(F.min("first_cast_at").alias("first_cast_at"))

    def _live_posts(self) -> DataFrame:
        live = self.posts.filter(self.clock.within(self.posts, self.clock.active_days))
        return live.withColumns({"this_week": self.clock.this_week(live), "last_week": self.clock.last_week(live)})

    def engaged_casts(self) -> DataFrame:
        """As ``rollups.engaged_casts``."""
        live = self._live_posts()
        reactions = self._window(self.reaction_days, "reactions", self._reaction_tile)
        received = reactions.groupBy("hash").agg(F.sum("likes").alias("likes"), F.sum("recasts").alias("recasts"))
        replies = self._window(self.reply_days, "casts", self._reply_tile)
        per_replier = replies.groupBy("hash", "fid").agg(F.sum("n").alias("n"))
        slim = live.select("hash", "fid", "parent_url", "root_parent_url", "is_top_level", "is_root", "this_week", "last_week")
        return engaged_rows(slim, received, replies_by_others(per_replier, live))

    def linked_posts(self) -> DataFrame:
        """As ``domains.linked_posts``."""
        return self._live_posts().filter("linked").select("fid", "parent_url", "root_parent_url", "this_week", "domain")

    # --- Sketches ---

    def sketches(self, width: int = 12) -> DataFrame:
        """Mergeable sketches per channel and day of the window: posts, replies and authors."""
        def step(known: DataFrame, since: Clock) -> DataFrame:
            # Sketches cannot forget, so days that a deletion has touched are sketched anew from the posts.
            fresh = F.to_date(since.instant(self.posts, "created_at"))
            log = self.changes.casts
            touched = [] if log is None else [r.day for r in self._of_window_days(log).select(F.to_date("created_at").alias("day")).distinct().collect()]
            anew = F.coalesce((F.col("day") >= fresh) | F.col("day").isin(touched), F.lit(False))
            kept = known.filter((F.col("day") >= F.lit(self._first_day.date())) & ~anew)
            return kept.unionByName(daily_sketches(self.posts.filter((F.to_date("created_at") >= fresh) | F.to_date("created_at").isin(touched)), width))

        return self._bring(f"sketches-{width}", lambda: daily_sketches(self.posts, width), step)


SKETCHED = ("rolling_casts", "rolling_replies", "casters")


def daily_sketches(posts: DataFrame, width: int = 12) -> DataFrame:
    """(parent_url, day) with a sketch of 2^width registers for each of ``SKETCHED``."""
    kinds = {
        "rolling_casts": F.when(F.col("is_top_level"), F.col("hash")),
        "rolling_replies": F.when(~F.col("is_top_level"), F.col("hash")),
        "casters": F.col("fid"),
    }
    channel = thread_channel_key()
    return posts.filter(channel.isNotNull()).groupBy(channel.alias("parent_url"), F.to_date("created_at").alias("day")).agg(
        *(F.hll_sketch_agg(value, width).alias(name) for name, value in kinds.items())
    )


def sketched_weeks(sketches: DataFrame, clock: Clock) -> DataFrame:
    """Counts of both weeks per channel from the sketches of their days.

    Weeks begin with a day here: of a clock that does not stand at midnight the first day counts
    whole, and a post exactly a week old counts in one week.
    """
    first = [(clock.as_of - timedelta(days=back)).date() for back in (clock.active_days, clock.recent_days)]
    inside = {"": F.col("day") >= F.lit(first[1]), "_last": (F.col("day") >= F.lit(first[0])) & (F.col("day") < F.lit(first[1]))}
    unions = [
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(week, F.col(name)))), F.lit(0)).alias(name + suffix)
        for suffix, week in inside.items() for name in SKETCHED
    ]
    return sketches.groupBy("parent_url").agg(*unions)
