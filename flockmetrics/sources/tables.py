"""The nine input tables and how windows are read from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockmetrics.clock import Clock

DAY = "created_day"

REQUIRED_COLUMNS = {
    "casts": (
        "hash", "fid", "parent_hash", "root_parent_hash", "parent_url", "root_parent_url",
        "text", "created_at", "deleted_at",
    ),
    "reactions": ("fid", "target_fid", "target_hash", "reaction_type", "created_at", "deleted_at"),
    "links": ("fid", "target_fid", "created_at", "deleted_at"),
    "fids": ("fid", "custody_address", "created_at"),
    "verifications": ("fid", "claim"),
    "profiles": ("fid", "fname"),
    "early_channels": ("channel_id", "parent_url"),
    "wallet_activity": (
        "wallet", "txs", "nft_volume_usd", "dex_volume_usd", "contracts_deployed",
        "erc20_addresses", "nft_addresses",
    ),
    "stopwords": ("stopwords",),
}


@dataclass(frozen=True)
class SocialTables:
    """Input tables as DataFrames. ``casts.hash`` must be unique (see ``quality``)."""

    casts: DataFrame
    reactions: DataFrame
    links: DataFrame
    fids: DataFrame
    verifications: DataFrame
    profiles: DataFrame
    early_channels: DataFrame
    wallet_activity: DataFrame
    stopwords: DataFrame

    def __post_init__(self) -> None:
        for name, needed in REQUIRED_COLUMNS.items():
            missing = set(needed) - set(getattr(self, name).columns)
            if missing:
                raise ValueError(f"table {name} lacks columns {sorted(missing)}")

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str] | None = None) -> SocialTables:
        """Tables or views of the session catalog; ``names`` maps ours to the catalog's."""
        names = names or {}
        return cls(**{name: spark.table(names.get(name, name)) for name in cls.names()})

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> SocialTables:
        return cls(**{name: spark.read.parquet(f"{folder}/{name}") for name in cls.names()})


def not_deleted(df: DataFrame, clock: Clock) -> Column:
    """Rows that stand; in a replay also those that were deleted only later."""
    stands = F.col("deleted_at").isNull()
    return stands | (F.col("deleted_at") > clock.instant(df, "deleted_at")) if clock.replay else stands


def rows_up_to_now(df: DataFrame, clock: Clock) -> DataFrame:
    """Rows created until now, or at an unknown time. A table laid out by ``created_day``, the date
    of ``created_at``, does not read later days."""
    if not clock.replay:
        return df
    if DAY in df.columns:
        df = df.filter(F.col(DAY).isNull() | (F.col(DAY) <= F.to_date(clock.instant(df, "created_at"))))
    return df.filter(F.col("created_at").isNull() | clock.up_to_now(df))


def rows_within(df: DataFrame, clock: Clock, days: int) -> DataFrame:
    """Rows of a trailing window; a table laid out by ``created_day`` reads no earlier days either."""
    if DAY in df.columns:
        df = df.filter(F.col(DAY) >= F.to_date(clock.instant(df, "created_at", days)))
        if clock.replay:
            df = df.filter(F.col(DAY) <= F.to_date(clock.instant(df, "created_at")))
    return df.filter(clock.within(df, days))


def live_rows(df: DataFrame, clock: Clock) -> DataFrame:
    """Undeleted rows of the activity window."""
    return rows_within(df, clock, clock.active_days).filter(not_deleted(df, clock))


def channel_key() -> Column:
    """Channel a post is filed under for its author and for word statistics."""
    return F.coalesce("parent_url", "root_parent_url")


def thread_channel_key() -> Column:
    """Channel a post is filed under for channel statistics: the thread's channel goes first."""
    return F.coalesce("root_parent_url", "parent_url")
