"""All marts over one set of tables, each stored once and read by those that build on it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from flockmetrics.clock import Clock
from flockmetrics.operators.domains import linked_posts
from flockmetrics.operators.members import member_ranges
from flockmetrics.operators.rollups import engaged_casts
from flockmetrics.operators.wallets import address_book
from flockmetrics.plans.channels import by_engagement, channel_members, channels_mart, with_member_lists
from flockmetrics.plans.daily import DailyState
from flockmetrics.plans.tiers import channels_by_tier, users_by_tier
from flockmetrics.plans.trending import ChannelFilters, UserFilters, trending_channels, trending_users
from flockmetrics.plans.users import AccountSides, account_sides, by_followers, users_mart
from flockmetrics.plans.words import trending_words
from flockmetrics.settings import PREVIEW_ROWS, Settings
from flockmetrics.sources.catalogue import EDITION, Catalogue, table_version
from flockmetrics.sources.stored import remove, store, store_bucketed
from flockmetrics.sources.tables import SocialTables

# What each result is built on; results come after everything they need.
DEPENDENCIES = {
    "users": (),
    "users_by_tier": ("users",),
    "trending_users": ("users",),
    "trending_words": ("users",),
    "channels": ("users",),
    "channels_by_tier": ("channels",),
    "trending_channels": ("channels",),
}

# Tables and stored results that each stored result is computed from, and whether settings matter to it.
READS = {
    "engaged_casts": (("casts", "reactions"), (), False),
    "linked_posts": (("casts",), (), False),
    "address_book": (("fids", "verifications"), (), False),
    "channel_members": (("casts",), (), False),
    "member_ranges": ((), ("channel_members",), False),
    "users": (
        ("early_channels", "fids", "links", "profiles", "wallet_activity"), ("engaged_casts", "linked_posts", "address_book"), True
    ),
    "caster_summary": ((), ("engaged_casts", "users"), True),
    "channels": (("early_channels",), ("engaged_casts", "linked_posts", "channel_members", "caster_summary"), True),
}


class MartBook:
    """``keep`` decides what happens to shared results: ``store`` writes them to the shared
    folder; pass ``lambda df, name: df`` to keep everything one lazy plan. With ``daily``, a state of the same
    tables and clock, posts, reactions and follows of days it knows are not read again.

    With a ``catalogue`` the results named in ``READS`` are found again by later books, also of other sessions,
    while their tables, clock, settings and time zone are the same; a changed table leaves what does not depend on it.
    ``versions`` names the state of tables that are not read from files, or saves looking at their files.

    ``bitmaps`` looks holders of a token up in ranges of members, and ``bucketed`` stores what the users mart joins by
    account dealt by account, for callers that build several marts from one book."""

    def __init__(
        self,
        tables: SocialTables,
        clock: Clock,
        settings: Settings = Settings(),
        keep: Callable[[DataFrame, str], DataFrame] = store,
        daily: DailyState | None = None,
        catalogue: Catalogue | None = None,
        versions: Mapping[str, str] | None = None,
        bitmaps: bool = False,
        bucketed: bool = False,
    ) -> None:
        if daily is not None and daily.clock != clock:
            raise ValueError("the daily state is of another clock")
        self.tables, self.clock, self.settings, self.daily = tables, clock, settings, daily
        self.catalogue, self._versions = catalogue, dict(versions or {})
        self.bitmaps, self.bucketed = bitmaps, bucketed
        self._kept: list[DataFrame] = []

        def kept(df: DataFrame, name: str) -> DataFrame:
            if catalogue is not None and name in READS:
                return catalogue.result(name, self.key(name), lambda: df)
            result = keep(df, name)
            self._kept.append(result)
            return result

        self.keep = kept

    def _version(self, table: str) -> str:
        if table not in self._versions:
            self._versions[table] = table_version(getattr(self.tables, table))
        return self._versions[table]

    def key(self, name: str) -> str:
        """What a stored result is known by: everything it is computed from."""
        tables, results, with_settings = READS[name]
        parts = [
            str(EDITION), name, repr(self.clock), self.tables.casts.sparkSession.conf.get("spark.sql.session.timeZone"),
            repr(self.settings) + repr(self.settings.common_words) if with_settings else "",
            *(f"{table}={self._version(table)}" for table in tables),
            *(f"{result}={self.key(result)}" for result in results),
        ]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.catalogue is not None:
            # Plans are not even made for what is found.
            return self.catalogue.result(name, self.key(name), build)
        return self.keep(build(), name)

    def forget_others(self) -> list[str]:
        """Remove catalogued results of other tables, clocks and settings; nobody may be reading them."""
        return self.catalogue.keep_only({name: self.key(name) for name in READS}) if self.catalogue is not None else []

    def close(self) -> None:
        """Remove the stored results; DataFrames of this book cannot be read afterwards."""
        for result in self._kept:
            if hasattr(result, "stored_at"):
                remove(result)
        self._kept.clear()

    @cached_property
    def engaged(self) -> DataFrame:
        def build() -> DataFrame:
            return self.daily.engaged_casts() if self.daily else engaged_casts(self.tables.casts, self.tables.reactions, self.clock)

        return self._stored("engaged_casts", build)

    @cached_property
    def linked(self) -> DataFrame:
        def build() -> DataFrame:
            return self.daily.linked_posts() if self.daily else linked_posts(self.tables.casts, self.clock)

        return self._stored("linked_posts", build)

    @cached_property
    def addresses(self) -> DataFrame:
        return self._stored("address_book", lambda: address_book(self.tables.fids, self.tables.verifications))

    @cached_property
    def members(self) -> DataFrame:
        def build() -> DataFrame:
            return self.daily.channel_members() if self.daily else channel_members(self.tables.casts, self.clock)

        return self._stored("channel_members", build)

    @cached_property
    def ranges(self) -> DataFrame:
        return self._stored("member_ranges", lambda: member_ranges(self.members, "parent_url", "fid"))

    def _bucketed(self, df: DataFrame, name: str) -> DataFrame:
        result = store_bucketed(df, name, "fid")
        self._kept.append(result)
        return result

    @cached_property
    def sides(self) -> AccountSides:
        sides = account_sides(self.tables, self.clock, self.addresses, self.daily.followers() if self.daily else None)
        return sides.kept(self._bucketed) if self.bucketed else sides

    @cached_property
    def stored_users(self) -> DataFrame:
        def build() -> DataFrame:
            return users_mart(
                self.tables, self.clock, self.settings, self.engaged, self.linked, ordered=False, sides=self.sides
            )

        return self._stored("users", build)

    @cached_property
    def stored_channels(self) -> DataFrame:
        """The channels mart without its member lists."""
        def build() -> DataFrame:
            return channels_mart(
                self.tables, self.clock, self.stored_users, self.settings, self.engaged, self.linked, self.members,
                self.keep, member_lists=False, ordered=False,
            )

        return self._stored("channels", build)

    def users(self) -> DataFrame:
        return by_followers(self.stored_users)

    def channels(self) -> DataFrame:
        return by_engagement(with_member_lists(self.stored_channels, self.members))

    def users_by_tier(self) -> DataFrame:
        return users_by_tier(self.stored_users, self.settings)

    def channels_by_tier(self) -> DataFrame:
        return channels_by_tier(self.stored_channels, self.settings)

    def trending_words(self, channel: str | None = None) -> DataFrame:
        return trending_words(
            self.tables.casts, self.tables.stopwords, self.stored_users, self.clock, self.settings, channel
        )

    def trending_users(self, filters: UserFilters) -> DataFrame:
        return trending_users(
            self.stored_users, self.tables, self.clock, filters, addresses=self.addresses, keep=self.keep
        )

    def trending_channels(self, filters: ChannelFilters) -> DataFrame:
        return trending_channels(
            self.stored_channels, self.members, self.tables, filters, addresses=self.addresses, keep=self.keep,
            ranges=self.ranges if self.bitmaps and filters.held_token is not None else None,
        )

    def result(self, name: str, *args) -> DataFrame:
        """A result by its name in ``DEPENDENCIES``."""
        if name not in DEPENDENCIES:
            raise KeyError(f"no result {name!r}; known are {sorted(DEPENDENCIES)}")
        return getattr(self, name)(*args)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> tuple[DataFrame, DataFrame, str]:
    """The first rows of a result, summary statistics of those rows, and its schema as text."""
    head = df.limit(rows)
    return head, head.describe(), df.schema.treeString()
