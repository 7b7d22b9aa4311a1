"""Addresses of people, their on-chain totals and holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.functions.chain import address_bytes, claim_address, holds_token
from flockmetrics.operators.joins import heavy_key_join


def address_book(fids: DataFrame, verifications: DataFrame) -> DataFrame:
    """Custody and verified addresses per person, repeats and unreadable claims (NULL) included."""
    custody = fids.select("fid", F.col("custody_address").alias("address"))
    verified = verifications.select("fid", claim_address(F.col("claim")).alias("address"))
    return custody.unionByName(verified)


def volume() -> Column:
    """Traded volume; NULL when either part is unknown."""
    return F.col("nft_volume_usd") + F.col("dex_volume_usd")


def wallet_totals(book: DataFrame, wallet_activity: DataFrame) -> DataFrame:
    """On-chain totals and the list of addresses per person, repeats and NULLs included.

    ``book`` is read several times, so store it where claims are many. Claims are counted per
    person and address first, so a person with very many broken or equal claims is one row; an
    address claimed by many people is spread over them. The list is made apart from the sums.
    """
    totals = wallet_activity.select(
        F.col("wallet").alias("address"),
        "txs",
        volume().alias("volume"),
        "contracts_deployed",
    )
    pairs = book.filter(F.col("address").isNotNull()).groupBy("fid", "address").agg(F.count("*").alias("claims"))
    sums = (
        heavy_key_join(pairs, totals, "address", "inner", spread_by=["fid"])
        .groupBy("fid")
        .agg(
            F.sum(F.col("txs") * F.col("claims")).alias("total_transactions"),
            F.sum(F.col("volume") * F.col("claims")).alias("trading_volume_usd"),
            F.sum(F.col("contracts_deployed") * F.col("claims")).alias("contracts_deployed"),
        )
    )
    return address_lists(book).join(sums, "fid", "left").select(
        "fid", "total_transactions", "trading_volume_usd", "contracts_deployed", "addresses"
    )


def address_lists(book: DataFrame) -> DataFrame:
    """Every claim of a person in one list. Claims are counted before they meet; the cell itself is
    as long as the person has claims."""
    counted = book.groupBy("fid", "address").agg(F.count("*").cast("int").alias("claims"))
    entry = F.struct(F.col("address").alias("v"), "claims")
    lists = counted.groupBy("fid").agg(F.sort_array(F.collect_list(entry)).alias("_each"))
    repeated = F.flatten(F.transform("_each", lambda e: F.array_repeat(e["v"], e["claims"])))
    return lists.select("fid", repeated.alias("addresses"))


def token_holders(book: DataFrame, wallet_activity: DataFrame, token: str) -> DataFrame:
    """People with a wallet holding the given token or collection; nobody for unreadable hex."""
    holding = holds_token(F.col("erc20_addresses"), F.col("nft_addresses"), address_bytes(F.lit(token)))
    wallets = wallet_activity.filter(holding).select(F.col("wallet").alias("address")).distinct()
    readable = book.filter(F.col("address").isNotNull())
    return heavy_key_join(readable, wallets, "address", "left_semi", spread_by=["fid"]).select("fid").distinct()
