from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flockmetrics import Clock, Settings
from flockmetrics.operators.rollups import engaged_casts
from flockmetrics.plans import channels, words
from flockmetrics.plans.book import DEPENDENCIES, MartBook, preview
from flockmetrics.plans.tiers import channels_by_tier, users_by_tier
from flockmetrics.plans.trending import (
    ChannelFilters,
    UserFilters,
    fid_of_name,
    interaction_targets,
    trending_channels,
    trending_users,
)
from flockmetrics.plans.users import users_mart
from flockmetrics.settings import TierRule
from tests.conftest import AS_OF

DAY = timedelta(days=1)
BASE, MUSIC = "https://h/~/channel/base", "https://h/~/channel/music"


def padded(n):
    return n.to_bytes(20, "big")


def holding(wallet, token):
    return {"wallet": padded(wallet), "txs": 1, "nft_volume_usd": 1.0, "dex_volume_usd": 1.0, "contracts_deployed": 0,
            "erc20_addresses": [padded(token)], "nft_addresses": []}


WORLD = {
    "casts": [
        {"hash": 1, "fid": 1, "parent_url": BASE, "text": "see https://a.b/1 gm"},
        {"hash": 2, "fid": 1, "parent_url": MUSIC, "text": "https://www.c.d"},
        {"hash": 3, "fid": 1, "parent_url": MUSIC, "created_at": AS_OF - 8 * DAY, "text": "song"},
        {"hash": 4, "fid": 2, "parent_hash": 1, "root_parent_hash": 1, "root_parent_url": BASE, "text": "hello"},
        {"hash": 5, "fid": 3, "text": "no channel"},
        {"hash": 6, "fid": 2, "parent_url": BASE, "created_at": AS_OF - 400 * DAY, "text": "old"},
        {"hash": 7, "fid": 4, "parent_url": "https://old", "created_at": AS_OF - 40 * DAY, "text": "old"},
        {"hash": 8, "fid": 5, "parent_url": MUSIC, "root_parent_url": BASE, "text": "both"},
        {"hash": 9, "fid": 6, "parent_url": BASE, "created_at": AS_OF + DAY, "text": "future"},
    ],
    "reactions": [
        {"fid": 7, "target_fid": 1, "target_hash": 1, "reaction_type": 1},
        {"fid": 8, "target_fid": 1, "target_hash": 1, "reaction_type": 2},
        {"fid": 2, "target_fid": 1, "target_hash": 3, "reaction_type": 1},
    ],
    "links": [{"fid": f, "target_fid": 1, "created_at": AS_OF - f * DAY} for f in (2, 3, 9)],
    "fids": [{"fid": f, "custody_address": padded(f), "created_at": AS_OF - 10 * DAY} for f in (1, 2, 5)],
    "profiles": [{"fid": 1, "fname": "ann"}, {"fid": 2, "fname": "bob"}, {"fid": 5, "fname": None}],
    "early_channels": [{"channel_id": "base-id", "parent_url": BASE}],
    "wallet_activity": [holding(1, 70), holding(2, 70), holding(5, 71)],
}
SMALL_TIERS = (TierRule(4, "four", {"followers": 4, "casts": 1, "score": 1}), TierRule(3, "three", {"followers": 3, "casts": 1, "score": 1}), TierRule(0, "zero", {}))
SETTINGS = Settings(user_tiers=SMALL_TIERS, user_tiers_last=SMALL_TIERS)


@pytest.fixture(scope="module")
def world(tables):
    return tables(**WORLD)


@pytest.fixture(scope="module")
def book(world, clock):
    return MartBook(world, clock, SETTINGS)


@pytest.fixture(scope="module")
def by_fid(book):
    return {r.fid: r for r in book.users().collect()}


def test_users_mart_rows(by_fid):
    assert set(by_fid) == {1, 2, 3, 5}
    ann = by_fid[1]
    assert (ann.fid_active_tier_name, ann.fid_active_tier, ann.fid_active_tier_last) == ("three", 3, 0)
    assert (ann.followers, ann.wow_followers, ann.casts, ann.wow_casts) == (3, 2, 2, 1)
    assert (ann.got_likes, ann.got_recasts, ann.got_replies) == (1, 1, 1)
    assert (ann.engagement, ann.wow_engage, ann.wow_likes) == (14, 13, 0)
    assert ann.all_channels == ["base-id", "music"] and ann.channels == 2
    assert ann.all_domains == ["a.b", "c.d"]
    assert ann.fname_link == '<a href="https://warpcast.com/ann">ann</a>'
    assert (ann.account_age, ann.total_transactions, ann.trading_volume_usd) == (10, 1, 2.0)


def test_user_without_channel_profile_or_wallet(by_fid):
    row = by_fid[3]
    assert row.all_channels is None and row.channels is None and row.top_channels is None
    assert row.fname is None and row.fname_link is None and row.account_age is None
    assert (row.followers, row.total_transactions, row.addresses) == (0, 0, None)


def test_user_without_reactions_has_no_engagement(by_fid):
    row = by_fid[2]
    assert row.got_likes is None and row.engagement is None and row.fid_active_tier == 0


def test_users_mart_sorted_by_followers(book):
    counts = [r.followers for r in book.users().select("followers").collect()]
    assert counts == sorted(counts, reverse=True)


def test_duplicate_profiles_multiply_user_rows(tables, clock):
    twice = tables(**WORLD | {"profiles": [{"fid": 1, "fname": "ann"}, {"fid": 1, "fname": "anna"}, {"fid": 1, "fname": "ann"}]})
    names = [r.fname for r in users_mart(twice, clock, SETTINGS).filter("fid = 1").collect()]
    assert sorted(names) == ["ann", "anna"]


def test_present_clock_sees_later_rows(tables, world):
    now = Clock(AS_OF, replay=False)
    assert 6 in {r.fid for r in users_mart(world, now, SETTINGS).select("fid").collect()}


def test_channels_mart(book):
    rows = {r.parent_url: r for r in book.channels().collect()}
    assert set(rows) == {BASE, MUSIC, "https://old"}
    base = rows[BASE]
    assert base.channel == '<a href="https://warpcast.com/~/channel/base-id">base-id</a>'
    assert (base.channel_age, base.rolling_7_casts, base.rolling_7_replies) == (400, 2, 1)
    assert (base.engagement, base.wow_engage) == (14, 14)
    assert (base.rolling_7_likes, base.rolling_7_recasts, base.wow_likes) == (1, 1, None)
    assert base.top_casters == ["ann", None, "bob"] and base.influential_casters == ["ann"]
    assert (base.active_npc, base.active_influencer, base.avg_txs) == (2, 1, 1.0)
    assert base.all_caster_fids == [1, 2, 5] and base.top_domains == ["a.b"]
    music = rows[MUSIC]
    assert (music.rolling_7_casts, music.wow_cast, music.rolling_7_likes) == (1, 0, None)
    assert music.channel == '<a href="https://warpcast.com/~/channel/music">music</a>'


def test_silent_channel_counts_zero_posts_but_has_no_sums(book):
    row = next(r for r in book.channels().collect() if r.parent_url == "https://old")
    assert (row.rolling_7_casts, row.wow_cast, row.channel_tier) == (0, 0, 0)
    assert row.engagement is None and row.active_npc is None and row.top_casters is None
    assert row.channel == '<a href="https://old">https://old</a>'


def test_duplicate_mart_rows_multiply_engagement_but_not_casts(world, clock):
    engaged = engaged_casts(world.casts, world.reactions, clock)
    users = users_mart(world, clock, SETTINGS, engaged)
    twice = users.unionByName(users.filter("fid = 1")).unionByName(users.filter("fid = 1").withColumn("fname", F.lit("anna")))
    activity = channels.caster_activity(channels.cast_engagement(engaged))
    plain, doubled = (
        {r.parent_url: r for r in channels.channel_cast_stats(channels.caster_summary(activity, mart)).collect()}
        for mart in (users, twice)
    )
    assert doubled[BASE].engagement == 3 * plain[BASE].engagement
    assert doubled[BASE].active_influencer == 2 * plain[BASE].active_influencer
    for name in ("rolling_casts", "rolling_likes", "casters"):
        assert doubled[BASE][name] == plain[BASE][name]


def test_sketched_casters_close_to_exact(book):
    summary = channels.caster_summary(channels.caster_activity(channels.cast_engagement(book.engaged)), book.stored_users)
    exact, sketched = (
        {r.parent_url: r.casters for r in channels.channel_cast_stats(summary, Settings(approx_casters=on)).collect()}
        for on in (False, True)
    )
    assert exact == sketched


def test_tier_counts_add_up(book):
    total = users_by_tier(book.stored_users, SETTINGS).agg(F.sum("users")).first()[0]
    assert total == book.stored_users.count()
    by_channel = {r.channel_tier: r for r in channels_by_tier(book.stored_channels).collect()}
    assert sum(r.channels for r in by_channel.values()) == 3


def test_tier_left_empty_disappears_and_new_tier_has_no_past(spark):
    mart = spark.createDataFrame([(3, 0), (3, 0), (0, 4)], "fid_active_tier int, fid_active_tier_last int")
    got = [tuple(r) for r in users_by_tier(mart).collect()]
    assert got == [("🥇 influencer", 3, 2, 2), ("🤖 npc", 0, 1, -1)]


def naive_words(posts, stop, common):
    """posts: (week, fid, word) occurrences -> per word (casters, tf, tfidf) this week."""
    import math

    kept = [(w, f, t) for w, f, t in posts if t not in stop and t not in common and len(t) > 2]
    fids = {f for w, f, _ in kept if w}
    found = {}
    for word in {t for _, _, t in kept}:
        uses = [f for w, f, t in kept if w and t == word]
        if uses:
            found[word] = (len(set(uses)), len(uses), len(uses) * math.log10(len(fids) / len(set(uses))))
    return found


def test_trending_words_against_plain_python(tables, clock):
    vocabulary = ["alpha", "beta", "Gamma,", "you're", "today", "delta"]
    posts, rows = [], []
    for fid in range(30):
        for n in range(3):
            text = " ".join(vocabulary[(fid * 5 + n * k) % 6] for k in range(1, 4))
            week = n != 2
            created = AS_OF - DAY if week else AS_OF - 10 * DAY
            rows.append({"hash": len(rows), "fid": fid, "parent_url": BASE, "text": text, "created_at": created})
            posts += [(week, fid, t.lower().replace(",", "").replace("'", "")) for t in text.split(" ")]
    world = tables(casts=rows, stopwords=[{"stopwords": "you're"}, {"stopwords": "no"}, {"stopwords": "no"}])
    users = world.casts.select("fid", F.lit(1).alias("fid_active_tier")).distinct()
    got = words.trending_words(world.casts, world.stopwords, users, clock, Settings(min_casters=1)).collect()
    expected = naive_words(posts, {"youre"}, {"today"})
    assert {r.word for r in got} == set(expected)
    for r in got:
        assert (r.casters, r.tf) == expected[r.word][:2]
        assert r.tfidf == pytest.approx(expected[r.word][2])
    assert [r.ranking for r in got] == list(range(1, len(got) + 1))
    assert [(-r.casters, r.word) for r in got] == sorted((-r.casters, r.word) for r in got)


def test_word_of_last_week_only_is_not_trending_and_new_word_has_no_past(tables, clock):
    rows = [
        {"hash": 1, "fid": 1, "parent_url": BASE, "text": "fresh"},
        {"hash": 2, "fid": 1, "parent_url": BASE, "text": "stale", "created_at": AS_OF - 10 * DAY},
    ]
    world = tables(casts=rows, stopwords=[])
    users = world.casts.select("fid", F.lit(1).alias("fid_active_tier")).distinct()
    got = words.trending_words(world.casts, world.stopwords, users, clock, Settings(min_casters=1)).collect()
    assert [(r.word, r.casters, r.casters_wow, r.tf_wow, r.idf_wow) for r in got] == [("fresh", 1, 1, 1, 0.0)]


def test_word_channel_filter_looks_at_own_channel_only(world, clock):
    everyone = world.casts.select("fid").distinct()
    unfiltered = words.channel_posts(world.casts, everyone, clock)
    filtered = words.channel_posts(world.casts, everyone, clock, channel="BASE")
    assert {r.hash for r in unfiltered.collect()} == {1, 2, 3, 4, 8}
    assert {r.hash for r in filtered.collect()} == {1}


def test_words_of_inactive_authors_do_not_count(world, clock):
    authors = words.active_authors(users_mart(world, clock, SETTINGS))
    assert {r.fid for r in words.channel_posts(world.casts, authors, clock).collect()} == {1}


def test_lowest_fid_of_a_name(table):
    profiles = table("profiles", [{"fid": 7, "fname": "n"}, {"fid": None, "fname": "n"}, {"fid": 3, "fname": "n"}])
    assert fid_of_name(profiles, "n").first().fid == 3
    assert fid_of_name(profiles, "missing").first().fid is None


def test_interaction_targets(tables, clock):
    world = tables(
        profiles=[{"fid": 1, "fname": "ann"}],
        casts=[
            {"hash": 1, "fid": 9, "created_at": AS_OF - 90 * DAY, "deleted_at": AS_OF},
            {"hash": 2, "fid": 1, "parent_hash": 1},
            {"hash": 3, "fid": 1, "parent_hash": 1},
            {"hash": 4, "fid": 1, "parent_hash": 404},
            {"hash": 5, "fid": 1, "parent_hash": 2, "created_at": AS_OF - 20 * DAY},
            {"hash": 6, "fid": 2, "parent_hash": 2},
        ],
        links=[{"fid": 1, "target_fid": 4}, {"fid": 1, "target_fid": 5, "deleted_at": AS_OF}],
        reactions=[{"fid": 1, "target_fid": 1, "target_hash": 2, "reaction_type": 1}],
    )
    got = {tuple(r) for r in interaction_targets(world, clock, "ann").select("fid", "target_fid", "action").collect()}
    assert got == {(1, 9, "reply"), (1, None, "reply"), (1, 4, "follow"), (1, 1, "react")}


@pytest.mark.parametrize(
    "filters, fids",
    [
        (UserFilters(10), {1, 2, 5}),
        (UserFilters(9), set()),
        (UserFilters(10, channel="BASE"), {1, 2}),
        (UserFilters(10, channel="mus%"), {1, 5}),
        (UserFilters(10, tracked_user="bob"), {1}),
        (UserFilters(10, tracked_user="bob", action="react"), {1}),
        (UserFilters(10, tracked_user="bob", action="follow"), {1}),
        (UserFilters(10, tracked_user="BOB"), set()),
        (UserFilters(10, tracked_user="nobody"), set()),
        (UserFilters(10, held_token=padded(70).hex()), {1, 2}),
        (UserFilters(10, held_token="zz"), set()),
        (UserFilters.from_texts("10", "all channels", "no filter", "all", "none", "casts"), {1, 2, 5}),
    ],
)
def test_trending_users(book, filters, fids):
    assert {r.fid for r in book.trending_users(filters).collect()} == fids


@pytest.mark.parametrize(
    "filters, urls",
    [
        (ChannelFilters(400), {BASE, MUSIC, "https://old"}),
        (ChannelFilters(30), {MUSIC}),
        (ChannelFilters(400, username="BOB"), {BASE}),
        (ChannelFilters(400, username="nobody"), set()),
        # Both holders have posted in the channel: it is kept once.
        (ChannelFilters(400, held_token="0x" + padded(70).hex()), {BASE, MUSIC}),
        (ChannelFilters(400, held_token=padded(71).hex(), username="bob"), {BASE}),
        (ChannelFilters.from_texts(400, "all users", "none", "channel_age"), {BASE, MUSIC, "https://old"}),
    ],
)
def test_trending_channels(book, filters, urls):
    rows = book.trending_channels(filters).collect()
    assert {r.parent_url for r in rows} == urls and len(rows) == len(urls)


def test_sorting_by_a_chosen_column(book, world):
    by_age = book.trending_channels(ChannelFilters(400, sort_by="channel_age")).collect()
    assert [r.channel_age for r in by_age] == [400, 40, 8]
    by_engagement = trending_users(book.stored_users, world, book.clock, UserFilters(10, sort_by="engagement"))
    assert by_engagement.collect()[-1].engagement is None
    with pytest.raises(ValueError, match="cannot sort by"):
        trending_users(book.stored_users, world, book.clock, UserFilters(10, sort_by="fid; drop"))


def test_limit_keeps_the_first(book, world):
    first = trending_channels(book.stored_channels, book.members, world, ChannelFilters(400, sort_by="channel_age"), limit=1)
    assert [r.channel_age for r in first.collect()] == [400]


def test_preview(book):
    head, statistics, schema = preview(book.users(), rows=2)
    assert head.count() == 2
    assert {r.summary for r in statistics.collect()} == {"count", "mean", "stddev", "min", "max"}
    assert "fid_active_tier: integer" in schema


def test_results_by_name(book):
    assert book.result("users_by_tier").count() > 0
    assert book.result("trending_users", UserFilters(10)).count() == 3
    with pytest.raises(KeyError):
        book.result("unknown")
    done = set()
    for name, needs in DEPENDENCIES.items():
        assert set(needs) <= done
        done.add(name)


def test_lazy_book_gives_the_same(world, clock, by_fid):
    lazy = MartBook(world, clock, SETTINGS, keep=lambda df, name: df)
    assert {r.fid: r for r in lazy.users().collect()} == by_fid
    assert lazy.channels_by_tier().count() > 0


def test_members_in_two_steps(spark, table, clock):
    from datetime import timedelta

    from pyspark.sql import functions as F

    from flockmetrics import Clock
    from flockmetrics.plans.channels import channel_members, extend_members
    from flockmetrics.sources.stored import remove, store
    from tests.conftest import AS_OF

    rows = [{"hash": i, "fid": i % 4, "parent_url": f"c{i % 3}", "created_at": AS_OF - timedelta(days=i % 20)} for i in range(60)]
    casts = store(table("casts", rows).withColumn("created_day", F.to_date("created_at")), "casts", "created_day")
    before = Clock(AS_OF - timedelta(days=9))
    whole = channel_members(casts, clock)
    known = store(channel_members(casts, before), "members")
    extended = extend_members(known, casts, clock, before)
    assert sorted(extended.collect()) == sorted(whole.collect())
    plan = extended._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(created_day" in plan and ">= 2024-01-22" in plan
    remove(known)
    assert not __import__("os").path.exists(known.stored_at)
