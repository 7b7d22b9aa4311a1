"""Shapes of physical plans that must hold at scale."""

import re

import pytest

from flockmetrics.operators.rollups import engaged_casts
from flockmetrics.plans import channels, trending, words
from flockmetrics.plans.users import users_mart
from workload.sample_tables import SAMPLE_SETTINGS, sample_book


@pytest.fixture(scope="module")
def book(spark, smoke_dir):
    return sample_book(spark, smoke_dir)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to copy."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_or_python(book, no_broadcast):
    marts = (
        users_mart(book.tables, book.clock, SAMPLE_SETTINGS),
        channels.channels_mart(book.tables, book.clock, book.stored_users, SAMPLE_SETTINGS),
        book.trending_words(),
    )
    for df in marts:
        plan = plan_of(df)
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert unwanted not in plan


def test_scans_are_narrow_and_filtered(spark, book):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(engaged_casts(book.tables.casts, book.tables.reactions, book.clock))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 4 and all("text" not in line.split("Batched")[0] for line in scans)
    pushed = [line.split("PushedFilters: ")[1] for line in scans]
    assert all("IsNull(deleted_at)" in line and "GreaterThanOrEqual(created_at" in line for line in pushed)


def test_replies_never_meet_the_posts_of_a_root_one_by_one(book, no_broadcast):
    plan = plan_of(engaged_casts(book.tables.casts, book.tables.reactions, book.clock))
    assert plan.count("partial_count(1)") == 1 and "partial_sum(n" in plan


def test_top_lists_are_cut_before_the_shuffle(book, no_broadcast):
    plan = plan_of(channels.channels_mart(book.tables, book.clock, book.stored_users, SAMPLE_SETTINGS))
    assert plan.count("Partial") >= 3 and plan.count("WindowGroupLimit") >= 6


def test_global_rank_only_over_the_cut(book):
    plan = plan_of(book.trending_words())
    window, cut = plan.index("Window [row_number()"), plan.index("TakeOrderedAndProject")
    assert window < cut  # the window reads the cut
    assert "Exchange SinglePartition" not in plan


def test_word_counts_are_shuffled_once(book):
    live = book.trending_words()
    live.collect()
    plan = plan_of(live).split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_users_mart_reads_stored_engagement_once(book, no_broadcast):
    plan = plan_of(users_mart(book.tables, book.clock, SAMPLE_SETTINGS, book.engaged, book.linked, ordered=False))
    assert plan.count("/engaged_casts-") == plan.count("/linked_posts-") == 1 and "/casts-" not in plan


def test_member_lists_are_made_only_where_shown(book):
    assert "all_caster_fids" not in book.stored_channels.columns
    plan = plan_of(book.channels_by_tier())
    assert "collect_list" not in plan


def test_large_right_sides_are_not_repeated(book, no_broadcast):
    activity = channels.caster_activity(channels.cast_engagement(book.engaged))
    for df in (
        channels.caster_summary(activity, book.stored_users),
        channels.channels_mart(book.tables, book.clock, book.stored_users, SAMPLE_SETTINGS, member_lists=False),
    ):
        plan = plan_of(df)
        assert "_salt" not in plan and "explode(sequence" not in plan


def test_few_replies_go_to_the_posts(book, no_broadcast):
    replies = book.tables.casts.filter("fid = 4 and parent_hash is not null").select("fid", "parent_hash").distinct()
    plan = plan_of(trending.reply_targets(replies, book.tables.casts))
    assert "BroadcastHashJoin [hash" in plan and "LeftSemi" in plan


def test_author_filter_does_not_fix_the_partitioning_of_word_counts(book, no_broadcast, monkeypatch):
    monkeypatch.setattr("flockmetrics.operators.joins.fits_broadcast", lambda df: False)
    authors = words.active_authors(book.stored_users)
    posts = words.channel_posts(book.tables.casts, authors, book.clock)
    plan = plan_of(words.term_frequency(words.telling_words(posts, book.tables.stopwords)))
    assert "_salt" in plan and "partial_count" in plan


def test_texts_are_never_shuffled_for_word_counts(spark, book, no_broadcast, monkeypatch):
    """Also with more authors than can be sent to the texts; results are the same."""
    authors = words.active_authors(book.stored_users)
    few = words.active_terms(book.tables.casts, book.tables.stopwords, authors, book.clock)
    assert "BroadcastHashJoin" in plan_of(few)
    expected = sorted(map(tuple, few.select("this_week", "fid", "word", "tf").collect()))
    trending_before = book.trending_words().collect()
    monkeypatch.setattr(words, "fits_broadcast", lambda df: False)
    many = words.active_terms(book.tables.casts, book.tables.stopwords, authors, book.clock)
    assert sorted(map(tuple, many.select("this_week", "fid", "word", "tf").collect())) == expected
    assert book.trending_words().collect() == trending_before
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    shown = many._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"\) Exchange\s+Input \[\d+\]: \[(.*?)\]", shown)
    assert moved and not any(re.search(r"\btext#", columns) for columns in moved)
