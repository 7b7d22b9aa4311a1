"""The fixed instant every time window is measured from."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    """``as_of`` plus the two trailing windows, in days.

    ``as_of`` has no zone: it is read in the session time zone for TIMESTAMP columns and
    literally for TIMESTAMP_NTZ columns. With ``replay`` (the default) rows created after
    ``as_of`` are ignored and later deletions have not happened, so a past day can be recomputed; without it the windows are open
    at the top, as they are when ``as_of`` is the present.
    """

    as_of: datetime
    recent_days: int = 7
    active_days: int = 14
    replay: bool = True

    def __post_init__(self) -> None:
        if self.as_of.tzinfo is not None:
            raise ValueError("as_of must not carry a time zone; it is read in the session's")

    def instant(self, df: DataFrame, column: str, days_back: int = 0) -> Column:
        """``as_of - days_back`` as a constant of the column's own type.

        Matching the type keeps casts off the column, so the comparison reaches the scan.
        """
        moment = self.as_of - timedelta(days=days_back)
        return F.lit(moment.isoformat(sep=" ")).cast(df.schema[column].dataType)

    def up_to_now(self, df: DataFrame, column: str = "created_at") -> Column:
        if not self.replay:
            return F.lit(True)
        return F.col(column) <= self.instant(df, column)

    def within(self, df: DataFrame, days: int, column: str = "created_at") -> Column:
        """Inclusive trailing window of ``days`` days."""
        return (F.col(column) >= self.instant(df, column, days)) & self.up_to_now(df, column)

    def this_week(self, df: DataFrame, column: str = "created_at") -> Column:
        return self.within(df, self.recent_days, column)

    def last_week(self, df: DataFrame, column: str = "created_at") -> Column:
        """Closed at both ends: a row exactly ``recent_days`` old counts in both weeks."""
        return F.col(column).between(
            self.instant(df, column, self.active_days), self.instant(df, column, self.recent_days)
        )
