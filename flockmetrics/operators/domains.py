"""Most linked sites per author or channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.links import link_domain
from flockmetrics.operators.lists import top_k_list
from flockmetrics.settings import LINK_START
from flockmetrics.sources.tables import live_rows


def linked_posts(casts: DataFrame, clock: Clock) -> DataFrame:
    """Site of the first link of each live post that has one, with whom and where to count it.

    Texts are by far the widest column; users and channels both count from these rows, so that
    the texts need to be read only once.
    """
    # The plain substring test spares most texts the pattern search.
    live = live_rows(casts, clock).filter(F.contains(F.col("text"), F.lit(LINK_START)))
    return live.select(
        "fid",
        "parent_url",
        "root_parent_url",
        clock.this_week(live).alias("this_week"),
        link_domain(F.col("text")).alias("domain"),
    )


def top_domains(linked: DataFrame, key: Column, name: str, ignored: Sequence[str], k: int = 3) -> DataFrame:
    """Up to ``k`` sites per key by number of posts linking there first, ties by name."""
    counted = (
        linked.select(key.alias(name), "domain")
        .filter(~F.col("domain").isin(*ignored))  # a NULL domain fails this as well
        .groupBy(name, "domain")
        .agg(F.count("*").alias("n"))
    )
    order = [F.col("n").desc(), F.col("domain").asc()]
    return top_k_list(counted, [name], order, "domain", k, "top_domains")
