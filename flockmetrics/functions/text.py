"""Cleaning post text and cutting it into words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flockmetrics.settings import ADDRESS_PATTERN, LINK_PATTERN, PUNCTUATION, TAG_PATTERN

# White space other than a plain space (no-break spaces are not white space), next to a space or an
# end of the text. Words are cut at plain spaces, so removing it once from the whole text trims
# every word.
_WHITE = r"\t-\r\x1C-\x1F\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
_EDGE_WHITESPACE = rf"[{_WHITE}]+(?= |\z)|(?<=\A| )[{_WHITE}]+"


def clean_text(text: Column, punctuation: str = PUNCTUATION) -> Column:
    for unwanted in (LINK_PATTERN, punctuation, ADDRESS_PATTERN, TAG_PATTERN):
        text = F.regexp_replace(text, unwanted, "")
    return text


def words_of(text: Column, punctuation: str = PUNCTUATION) -> Column:
    """Lower-case words of a text, trimmed; line breaks inside a word stay."""
    return pieces(F.regexp_replace(F.lower(clean_text(text, punctuation)), _EDGE_WHITESPACE, ""))


def pieces(text: Column) -> Column:
    """What lies between plain spaces."""
    return F.split(text, " ")


def is_integer(word: Column) -> Column:
    """Whether a word is a 32-bit integer. Only runs of digits are cast: a failing cast is slow."""
    return F.when(word.rlike("^[+-]?[0-9]+$"), word.try_cast("int").isNotNull()).otherwise(False)


def is_telling(word: Column, common_words: Sequence[str]) -> Column:
    """Longer than two characters, not a 32-bit integer and not a common word."""
    return (F.length(word) > 2) & ~word.isin(*common_words) & ~is_integer(word)


def contains_text(text: Column, part: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in ``part`` are wildcards, a backslash is itself."""
    return F.lower(text).like("%" + part.lower().replace("\\", "\\\\") + "%")
