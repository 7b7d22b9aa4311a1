"""Trending words: TF-IDF and distinct authors per word, this week against last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockmetrics.clock import Clock
from flockmetrics.functions.scores import change, max_where
from flockmetrics.functions.text import contains_text, is_telling, words_of
from flockmetrics.operators.joins import dimension_join, fits_broadcast, heavy_key_join
from flockmetrics.settings import RESULT_LIMIT, Settings
from flockmetrics.sources.tables import channel_key, live_rows


def active_authors(users: DataFrame, least_tier: int = 1) -> DataFrame:
    return users.filter(F.col("fid_active_tier") >= least_tier).select("fid")


def posts_with_text(casts: DataFrame, clock: Clock, channel: str | None = None) -> DataFrame:
    """Live channel posts. The optional channel filter looks at the post's own channel only, so replies
    that carry just the thread's channel do not pass it."""
    posts = live_rows(casts, clock).filter(channel_key().isNotNull())
    if channel is not None:
        posts = posts.filter(contains_text(F.col("parent_url"), channel))
    this_week = F.when(clock.this_week(casts), 1).otherwise(0).alias("this_week")
    return posts.select("hash", "fid", this_week, "text")


def channel_posts(casts: DataFrame, authors: DataFrame, clock: Clock, channel: str | None = None) -> DataFrame:
    """Live channel posts by the given authors, with their texts."""
    # A small set of authors goes to the texts; with a large one only prolific authors are cut up.
    return dimension_join(posts_with_text(casts, clock, channel), authors, "fid", "left_semi", spread_by=["hash"])


def active_terms(
    casts: DataFrame, stopwords: DataFrame, authors: DataFrame, clock: Clock, settings: Settings = Settings(), channel: str | None = None
) -> DataFrame:
    """``term_frequency`` of the posts of the given authors; texts never leave the task that reads them.

    A small set of authors is sent to the texts. A large one meets the counts per author and word
    instead: they are made where the texts are read and are all that is shuffled.
    """
    posts = posts_with_text(casts, clock, channel)
    if fits_broadcast(authors):
        return term_frequency(telling_words(posts.join(F.broadcast(authors), "fid", "left_semi"), stopwords, settings))
    terms = term_frequency(telling_words(posts, stopwords, settings))
    return heavy_key_join(terms, authors, "fid", "left_semi", spread_by=["word"])


def telling_words(posts: DataFrame, stopwords: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per word occurrence that is neither a stopword, a number, common nor short."""
    words = posts.select("this_week", "fid", "hash", F.explode(words_of(F.col("text"), settings.punctuation)).alias("word"))
    words = words.filter(is_telling(F.col("word"), settings.common_words))
    stop = stopwords.select(F.regexp_replace("stopwords", settings.punctuation, "").alias("word")).distinct()
    return dimension_join(words, stop, "word", "left_anti", spread_by=["hash"]).select("this_week", "fid", "word")


def term_frequency(words: DataFrame) -> DataFrame:
    """Occurrences per week, author and word; an author's week is one document."""
    return words.groupBy("this_week", "fid", "word").agg(F.count("*").alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """Authors and occurrences per week and word; ``terms`` holds each author once per word."""
    return terms.groupBy("this_week", "word").agg(F.count("fid").alias("df"), F.sum("tf").alias("tf"))


def total_documents(terms: DataFrame) -> DataFrame:
    """Authors with at least one word per week: at most two rows."""
    # The (always true) condition keeps ``tf`` in the plan, so the shuffle of ``terms`` is shared
    # with ``document_frequency`` instead of being computed twice.
    authors = terms.groupBy("this_week", "fid").agg(F.sum("tf").alias("n")).filter(F.col("n") > 0)
    return authors.groupBy("this_week").agg(F.count("fid").alias("total_docs"))


def inverse_document_frequency(frequencies: DataFrame, totals: DataFrame) -> DataFrame:
    idf = F.log10(F.col("total_docs").cast("double") / F.col("df").cast("double"))
    return frequencies.join(F.broadcast(totals), "this_week", "left").withColumn("idf", idf)


def weekly_tfidf(weighted: DataFrame) -> DataFrame:
    """One row per word. A word's IDF is the same for all authors of a week, so the sum of
    tf * idf is the weekly frequency times IDF and needs no join back to the authors."""

    def of_week(week: int, value: Column) -> Column:
        return max_where(F.col("this_week") == week, value)

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    measures = []
    for week, suffix in ((1, ""), (0, "_last")):
        measures += [
            of_week(week, F.col("idf")).alias("idf" + suffix),
            or_zero(of_week(week, F.col("tf"))).alias("tf" + suffix),
            or_zero(of_week(week, F.col("tf") * F.col("idf"))).alias("tfidf" + suffix),
            or_zero(of_week(week, F.col("df"))).alias("casters" + suffix),
        ]
    return weighted.groupBy("word").agg(*measures)


def trending_words(
    casts: DataFrame,
    stopwords: DataFrame,
    users: DataFrame,
    clock: Clock,
    settings: Settings = Settings(),
    channel: str | None = None,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """The words with most authors this week, among those with enough of them."""
    terms = active_terms(casts, stopwords, active_authors(users), clock, settings, channel)
    weighted = inverse_document_frequency(document_frequency(terms), total_documents(terms))
    frequent = weekly_tfidf(weighted).filter(F.col("casters") >= settings.min_casters)
    first = frequent.orderBy(F.desc("casters"), F.asc("word")).limit(limit)
    # Numbered after the cut, so the one-task window sees no more than ``limit`` rows.
    ranking = F.row_number().over(Window.orderBy(F.desc("casters"), F.asc("word"))).cast("long")

    def wow(name: str) -> Column:
        return change(F.col(name), F.col(name + "_last"), missing_before=0).alias(name + "_wow")

    pairs = [column for name in ("casters", "tf", "idf", "tfidf") for column in (F.col(name), wow(name))]
    return first.select(ranking.alias("ranking"), "word", *pairs).orderBy("ranking")
