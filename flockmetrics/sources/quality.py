"""Keys that should be unique: duplicates multiply rows and sums of the marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.sources.tables import SocialTables

UNIQUE_KEYS = {
    "casts": "hash",
    "fids": "fid",
    "profiles": "fid",
    "early_channels": "parent_url",
    "wallet_activity": "wallet",
}


def duplicate_keys(tables: SocialTables) -> DataFrame:
    """Per table: how many keys occur more than once and how many rows they hold."""

    def report(name: str, key: str) -> DataFrame:
        rows = getattr(tables, name)
        repeated = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        return repeated.agg(
            F.count("*").alias("repeated_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_with_repeated_key"),
        ).select(F.lit(name).alias("table_name"), "*")

    return reduce(DataFrame.unionByName, (report(name, key) for name, key in UNIQUE_KEYS.items()))
