from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flockmetrics import Clock
from flockmetrics.operators import joins
from flockmetrics.operators.domains import linked_posts, top_domains
from flockmetrics.operators.joins import dimension_join, fits_broadcast, heavy_key_join
from flockmetrics.operators.lists import distinct_list, ordered_list, top_k_list
from flockmetrics.operators.rollups import engaged_casts, followers, reactions_received, replies_received
from flockmetrics.operators.wallets import address_book, token_holders, wallet_totals
from flockmetrics.plans.users import user_channel_activity
from flockmetrics.settings import Settings
from tests.conftest import AS_OF

DAY = timedelta(days=1)


def as_dicts(df):
    return sorted((row.asDict() for row in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("least_rows", [1, 25, 1000])
def test_heavy_key_join_equals_join(spark, how, least_rows):
    keys = [1] * 5 + [2, None, None, 4]
    big = spark.createDataFrame([(k, v) for v in range(30) for k in keys], "k long, v long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (3, "c"), (2, "d")], "k long, w string")
    spread = heavy_key_join(big, small, "k", how, ["v"], parts=20, least_rows=least_rows)
    plain = big.join(small, ["k"], how)
    assert spread.columns == plain.columns
    assert as_dicts(spread) == as_dicts(plain)


def test_heavy_key_join_repeats_heavy_keys_only(spark):
    big = spark.createDataFrame([(1, v) for v in range(90)] + [(k, 0) for k in range(2, 12)], "k long, v long")
    small = spark.createDataFrame([(k, "x" * 9) for k in range(1, 12)], "k long, w string").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = heavy_key_join(big, small, "k", "inner", ["v"], parts=10, least_rows=1)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in per_task) == 100
    assert max(r["count"] for r in per_task) < 90


def test_dimension_join_same_with_and_without_broadcast(spark, monkeypatch):
    big = spark.createDataFrame([(k, v) for v in range(20) for k in ("a", "b", None)], "k string, v long")
    small = spark.createDataFrame([("a", 1), ("c", 2)], "k string, w long")
    copied = dimension_join(big, small, "k", "left", ["v"])
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    salted = dimension_join(big, small, "k", "left", ["v"])
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert "_salt" not in copied._jdf.queryExecution().toString()
    assert as_dicts(copied) == as_dicts(salted)


def test_fits_broadcast_measures_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 50).alias("s"), "id")
    assert fits_broadcast(df, rows=100, size=5800)
    assert not fits_broadcast(df, rows=99)
    assert not fits_broadcast(df, size=5799)
    assert fits_broadcast(df.limit(0))
    # Lists are measured, not taken for a number.
    wide = df.select(F.array_repeat("s", 100).alias("list"))
    assert not fits_broadcast(wide, size=100 * 100 * 50)


def test_ordered_list_keeps_nulls_and_is_null_when_empty(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 9, None), (1, 5, "a"), (2, 1, "z")], "k long, n long, v string")
    got = {
        r.k: r.vs
        for r in rows.groupBy("k").agg(ordered_list([-F.col("n")], F.col("v"), F.col("n") > 1).alias("vs")).collect()
    }
    assert got == {1: [None, "a", "b"], 2: None}


def test_top_k_is_a_prefix_of_the_whole_order(spark):
    rows = spark.createDataFrame([(i % 3, i * 7 % 10, i) for i in range(50)], "k long, n long, v long")
    order = [F.col("n").desc(), F.col("v").asc()]
    short, whole = (
        {r.k: r.vs for r in top_k_list(rows, ["k"], order, "v", k, "vs").collect()} for k in (4, 50)
    )
    assert all(whole[key][:4] == short[key] for key in whole)
    assert sum(map(len, whole.values())) == 50


def test_distinct_list(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(500)] + [(2, None), (2, 3)], "k long, v long")
    got = {r.k: r.vs for r in distinct_list(pairs, "k", "v", "vs").collect()}
    assert got == {1: list(range(500)), 2: [None, 3]}


def test_week_boundaries(table, clock):
    edge = AS_OF - 7 * DAY
    rows = table("casts", [
        {"hash": 1, "created_at": edge},
        {"hash": 2, "created_at": AS_OF - 14 * DAY},
        {"hash": 3, "created_at": AS_OF - 14 * DAY - timedelta(microseconds=1)},
        {"hash": 4, "created_at": AS_OF},
        {"hash": 5, "created_at": AS_OF + timedelta(microseconds=1)},
    ])
    flags = rows.select("hash", clock.this_week(rows).alias("now"), clock.last_week(rows).alias("before"))
    assert {r.hash: (r.now, r.before) for r in flags.collect()} == {
        1: (True, True), 2: (False, True), 3: (False, False), 4: (True, False), 5: (False, False),
    }
    open_ended = Clock(AS_OF, replay=False)
    assert {r.hash for r in rows.filter(open_ended.this_week(rows)).collect()} == {1, 4, 5}


def test_followers(table, clock):
    rows = table("links", [
        {"fid": 1, "target_fid": 9, "created_at": AS_OF - 30 * DAY},
        {"fid": 2, "target_fid": 9, "created_at": AS_OF - 7 * DAY},
        {"fid": 3, "target_fid": 9, "deleted_at": AS_OF},
        {"fid": 4, "target_fid": 9, "created_at": AS_OF + DAY},
        {"fid": 9, "target_fid": 9},
    ])
    assert as_dicts(followers(rows, clock)) == [{"fid": 9, "followers": 3, "wow_followers": 2}]


def test_reactions_exclude_own_deleted_old_and_unknown_targets(table, clock):
    like, recast = {"reaction_type": 1, "target_hash": 1}, {"reaction_type": 2, "target_hash": 1}
    rows = table("reactions", [
        {"fid": 1, "target_fid": 2, **like},
        {"fid": 3, "target_fid": 2, **recast},
        {"fid": 2, "target_fid": 2, **like},
        {"fid": 4, "target_fid": None, **like},
        {"fid": 5, "target_fid": 2, "deleted_at": AS_OF, **like},
        {"fid": 6, "target_fid": 2, "created_at": AS_OF - 15 * DAY, **like},
        {"fid": 7, "target_fid": 2, "reaction_type": 3, "target_hash": 2},
    ])
    assert as_dicts(reactions_received(rows, clock)) == [
        {"hash": 1, "likes": 1, "recasts": 1}, {"hash": 2, "likes": 0, "recasts": 0},
    ]


REPLIED = [
    {"hash": 1, "fid": 10},
    {"hash": 2, "fid": 11, "root_parent_hash": 1, "parent_hash": 1},
    {"hash": 3, "fid": 11, "root_parent_hash": 1, "parent_hash": 2},
    {"hash": 4, "fid": 12, "root_parent_hash": 1, "parent_hash": 3},
    {"hash": 5, "fid": 10, "root_parent_hash": 1, "parent_hash": 4},
    {"hash": 6, "fid": 13, "root_parent_hash": 1, "parent_hash": 1, "deleted_at": AS_OF},
    {"hash": 7, "fid": 13, "root_parent_hash": 1, "parent_hash": 1, "created_at": AS_OF - 15 * DAY},
    {"hash": 8, "fid": 13, "root_parent_hash": 1, "parent_hash": 1},
    {"hash": 9, "fid": None, "root_parent_hash": 1, "parent_hash": 1},
]
LIKES = [{"fid": 20 + i, "target_fid": 10, "target_hash": 1, "reaction_type": 1} for i in range(3)]


def test_replies_count_others_at_any_depth(table, clock):
    assert as_dicts(replies_received(table("casts", REPLIED), clock)) == [{"hash": 1, "replies": 4}]


def test_likes_are_repeated_per_reply_unless_corrected(table, clock):
    engaged = engaged_casts(table("casts", REPLIED), table("reactions", LIKES), clock)
    got = {
        repeat: user_channel_activity(engaged, Settings(repeat_likes=repeat)).filter("fid = 10").first()
        for repeat in (True, False)
    }
    assert (got[True].got_likes, got[False].got_likes) == (12, 3)
    assert got[True].got_replies == got[False].got_replies == 4
    assert got[True].casts == 2


def test_a_post_by_nobody_receives_nothing(table, clock):
    rows = [{"hash": 1, "fid": None}, {"hash": 2, "fid": 5, "root_parent_hash": 1, "parent_hash": 1}]
    engaged = engaged_casts(table("casts", rows), table("reactions"), clock)
    assert engaged.filter("hash = 1").first().replies == 0


def test_binary_hashes_and_zoned_timestamps(table, clock):
    def other_types(df, *hashes):
        for name in hashes:
            df = df.withColumn(name, F.unhex(F.lpad(F.hex(name), 40, "0")))
        return df.withColumns({n: F.col(n).cast("timestamp") for n in ("created_at", "deleted_at")})

    casts, reactions = table("casts", REPLIED), table("reactions", LIKES)
    expected = user_channel_activity(engaged_casts(casts, reactions, clock))
    got = user_channel_activity(engaged_casts(
        other_types(casts, "hash", "parent_hash", "root_parent_hash"), other_types(reactions, "target_hash"), clock
    ))
    assert as_dicts(got) == as_dicts(expected)


def test_clock_takes_no_time_zone():
    with pytest.raises(ValueError, match="time zone"):
        Clock(AS_OF.replace(tzinfo=timezone.utc))


def test_missing_reactions_are_null_not_zero(table, clock):
    engaged = engaged_casts(table("casts", [{"hash": 1, "fid": 1}]), table("reactions"), clock)
    row = user_channel_activity(engaged).first()
    assert row.got_likes is None and row.got_likes_last == 0 and row.got_replies == 0


def test_top_domains_ties_and_ignored(table, clock):
    texts = ["https://b.c/1", "https://www.b.c/2", "https://x.com/1", "nothing", "https://a.c", "https://d.c", "https://e.c", None]
    rows = table("casts", [{"hash": i, "fid": 1, "text": t} for i, t in enumerate(texts)] + [{"hash": 99, "fid": 2, "text": "https://x.com"}])
    got = as_dicts(top_domains(linked_posts(rows, clock), F.col("fid"), "fid", ("x.com",)))
    assert got == [{"fid": 1, "top_domains": ["b.c", "a.c", "d.c"]}]


def padded(n):
    return n.to_bytes(20, "big")


@pytest.fixture
def on_chain(table):
    claim = '{"address": "0x%s"}'
    return (
        table("fids", [{"fid": 1, "custody_address": padded(1)}, {"fid": 2, "custody_address": padded(2)}]),
        table("verifications", [
            {"fid": 1, "claim": claim % padded(3).hex()},
            {"fid": 1, "claim": claim % padded(3).hex()},
            {"fid": 1, "claim": "broken"},
            {"fid": 3, "claim": claim % padded(2).hex().upper()},
        ]),
        table("wallet_activity", [
            {"wallet": padded(1), "txs": 5, "nft_volume_usd": 1.0, "dex_volume_usd": None, "contracts_deployed": 1,
             "erc20_addresses": [padded(90)], "nft_addresses": None},
            {"wallet": padded(2), "txs": 2, "nft_volume_usd": 1.5, "dex_volume_usd": 2.0, "contracts_deployed": 0,
             "erc20_addresses": [padded(90)], "nft_addresses": [padded(91)]},
            {"wallet": padded(3), "txs": 7, "nft_volume_usd": 0.5, "dex_volume_usd": 0.5, "contracts_deployed": 2,
             "erc20_addresses": [], "nft_addresses": []},
        ]),
    )


def test_wallet_totals_count_repeated_addresses_and_keep_broken_ones(on_chain):
    fids, verifications, wallets = on_chain
    got = {r.fid: r for r in wallet_totals(address_book(fids, verifications), wallets).collect()}
    assert (got[1].total_transactions, got[1].trading_volume_usd, got[1].contracts_deployed) == (19, 2.0, 5)
    assert [a and bytes(a) for a in got[1].addresses] == [None, padded(1), padded(3), padded(3)]
    assert got[3].total_transactions == 2


@pytest.mark.parametrize("token, fids", [(90, {2, 3}), (91, {2, 3}), (92, set())])
def test_token_holders(on_chain, token, fids):
    accounts, verifications, wallets = on_chain
    found = token_holders(address_book(accounts, verifications), wallets, "0x" + padded(token).hex())
    assert {r.fid for r in found.collect()} == fids


def test_unreadable_token_is_held_by_nobody(on_chain):
    accounts, verifications, wallets = on_chain
    assert token_holders(address_book(accounts, verifications), wallets, "zz").count() == 0


def test_one_person_with_most_claims_is_one_row_of_the_wallet_join(spark, monkeypatch):
    broken = [(7, None)] * 18_000
    book = spark.createDataFrame(broken + [(7, bytearray(b"a")), (7, bytearray(b"a"))] + [(i, bytearray(b"%d" % i)) for i in range(2_000)], "fid long, address binary")
    wallets = spark.createDataFrame([(bytearray(b"a"), 5, 1.0, 2.0, 1), (bytearray(b"9"), 3, 1.0, None, 0)],
                                    "wallet binary, txs long, nft_volume_usd double, dex_volume_usd double, contracts_deployed long")
    seen = []
    join = heavy_key_join

    def watched(big, *args, **more):
        seen.append(big.groupBy("fid").count().agg(F.max("count")).first()[0])
        return join(big, *args, **more)

    monkeypatch.setattr("flockmetrics.operators.wallets.heavy_key_join", watched)
    rows = {r.fid: r for r in wallet_totals(book, wallets).collect()}
    assert seen == [2]
    assert (rows[7].total_transactions, rows[7].trading_volume_usd, rows[7].contracts_deployed) == (10, 6.0, 2)
    assert len(rows[7].addresses) == 18_003 and rows[7].addresses[0] is None
    assert (rows[9].total_transactions, rows[9].trading_volume_usd) == (3, None) and rows[8].total_transactions is None
