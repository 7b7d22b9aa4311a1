"""Link text, hosts, channel slugs and anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flockmetrics.settings import LINK_PATTERN


def link_domain(text: Column) -> Column:
    """Host of the first https link, without ``www.``; NULL without a link, '' for a bare scheme."""
    link = F.regexp_substr(text, F.lit(LINK_PATTERN))
    return F.replace(F.try_element_at(F.split(link, "/"), F.lit(3)), F.lit("www."), F.lit(""))


def url_slug(url: Column) -> Column:
    """Sixth '/'-separated part of a channel url, or NULL."""
    return F.try_element_at(F.split(url, "/"), F.lit(6))


def channel_name(channel_id: Column, url: Column) -> Column:
    return F.coalesce(channel_id, url_slug(url), url)


def anchor(url: Column, label: Column) -> Column:
    return F.concat(F.lit('<a href="'), url, F.lit('">'), label, F.lit("</a>"))
