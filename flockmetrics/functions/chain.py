"""Wallet addresses out of text and JSON claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address_bytes(text: Column) -> Column:
    """Hex text, with or without ``0x``, as bytes; NULL for anything that is not whole bytes."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(digits.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(digits))


def claim_address(claim: Column) -> Column:
    """The address named in a JSON claim; NULL when the claim is broken or names none."""
    return address_bytes(F.get_json_object(claim, "$.address"))


def holdings(erc20: Column, nft: Column) -> Column:
    """Tokens and collections in one list; NULL when either is unknown."""
    return F.concat(erc20, nft)


def holds_token(erc20: Column, nft: Column, token: Column) -> Column:
    """NULL when either list of holdings is unknown."""
    return F.array_contains(holdings(erc20, nft), token)
