"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_PARTS = 1_000
LEAST_HEAVY_ROWS = 100_000
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 * 1024 * 1024


def heavy_key_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    how: str,
    spread_by: Sequence[str],
    parts: int = HEAVY_PARTS,
    least_rows: int = LEAST_HEAVY_ROWS,
) -> DataFrame:
    """Equi join whose heavy left keys, NULL included, are spread over several tasks.

    ``spread_by`` names left columns that differ within one key. Only right rows of heavy keys are
    repeated, so the right side may be large. A key is heavy if it holds more than one ``parts``-th of the left rows, so there are fewer than
    ``parts`` heavy keys, whatever the data. Each is cut into pieces of about that size. The left
    keys are read once more to find them, so pass a plan that is cheap to read again.
    """
    piece = max(big.count() // parts, least_rows)
    heavy = F.broadcast(
        big.groupBy(F.col(on).alias("_key"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > piece)
        .select("_key", F.ceil(F.col("_n") / piece).cast("int").alias("_pieces"))
    )
    pieces = F.coalesce("_pieces", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread_by), pieces).cast("int").alias("_salt")
    every_salt = F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_salt")
    # NULL is a key like any other on the left: its rows match nothing but must be spread.
    same_key = F.col(on).eqNullSafe(F.col("_key"))
    left = big.join(heavy, same_key, "left").select(*big.columns, salt)
    right = small.filter(F.col(on).isNotNull()).join(heavy, same_key, "left").select(*small.columns, every_salt)
    return left.join(right, [on, "_salt"], how).drop("_salt")


def _bytes(df: DataFrame) -> Column:
    """Width of a row: texts by their length, lists and structures by that of their spelling."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind.startswith(("array", "map", "struct", "variant")):
            return F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
        return F.lit(8)

    return sum((width(name, kind) for name, kind in df.dtypes), F.lit(0).cast("long"))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the data, measured now, is small enough to copy to every executor."""
    n, total = df.agg(F.count("*"), F.sum(_bytes(df))).first()
    return n <= rows and (total or 0) <= size


def dimension_join(big: DataFrame, dimension: DataFrame, on: str, how: str, spread_by: Sequence[str]) -> DataFrame:
    """Join to a reference table: copied to every executor if it is measured to be small, otherwise
    a shuffle that cuts only heavy keys.

    Measuring runs a job over ``dimension``, so pass a stored table rather than a long plan.
    """
    if fits_broadcast(dimension):
        return big.join(F.broadcast(dimension), on, how)
    return heavy_key_join(big, dimension, on, how, spread_by)
