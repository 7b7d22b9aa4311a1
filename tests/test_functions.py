from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flockmetrics.functions import chain, links, scores, text
from flockmetrics.settings import CHANNEL_TIERS, COMMON_WORDS, USER_TIERS, USER_TIERS_LAST, TierRule, Weights


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given, domain",
    [
        ("abc", None),
        (None, None),
        ("see https:// x", ""),
        ("https://www.a.b/c", "a.b"),
        ("http://a.b then https://c.d?x=1 and https://e.f", "c.d?x=1"),
        ("https://www.www.a/", "a"),
    ],
)
def test_link_domain(spark, given, domain):
    assert one(spark, given, links.link_domain) == domain


@pytest.mark.parametrize(
    "url, slug",
    [
        ("https://warpcast.com/~/channel/base", "base"),
        ("https://a.b/c", None),
        ("chain://eip155:1/erc721:0x1", None),
        ("https://a/b/c/d/", "d"),
        ("https://a/b/c/", ""),
        (None, None),
    ],
)
def test_url_slug(spark, url, slug):
    assert one(spark, url, links.url_slug) == slug


def test_channel_name_falls_back(spark):
    rows = spark.createDataFrame([("id", "https://h/~/channel/s"), (None, "https://h/~/channel/s"), (None, "u")], "c string, u string")
    named = rows.select(links.channel_name(F.col("c"), F.col("u")).alias("n"))
    assert [r.n for r in named.collect()] == ["id", "s", "u"]


def test_anchor_is_null_without_label(spark):
    rows = spark.createDataFrame([("u", "l"), ("u", None)], "u string, l string")
    got = [r[0] for r in rows.select(links.anchor(F.col("u"), F.col("l"))).collect()]
    assert got == ['<a href="u">l</a>', None]


@pytest.mark.parametrize(
    "given, expected",
    [("0xABCD", b"\xab\xcd"), ("abcd", b"\xab\xcd"), ("zz", None), ("ABC", None), ("0x", b""), (None, None)],
)
def test_address_bytes(spark, given, expected):
    got = one(spark, given, chain.address_bytes)
    assert (None if got is None else bytes(got)) == expected


@pytest.mark.parametrize(
    "claim, expected",
    [
        ('{"address": "0x0a"}', b"\x0a"),
        ("not json", None),
        ('{"other": 1}', None),
        ('{"address": {"hex": "0a"}}', None),
        ('{"address": "xyz"}', None),
    ],
)
def test_claim_address(spark, claim, expected):
    got = one(spark, claim, chain.claim_address)
    assert (None if got is None else bytes(got)) == expected


def test_holds_token_unknown_holdings(spark):
    rows = spark.createDataFrame([([b"a"], [b"b"]), ([b"a"], None), ([b"c"], [b"c"])], "e array<binary>, n array<binary>")
    got = [r[0] for r in rows.select(chain.holds_token(F.col("e"), F.col("n"), F.lit(b"a"))).collect()]
    assert got == [True, None, False]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("put,cat:no! $x <b> you’re", ["putcatno", "x", "b", "youre"]),
        ("A  B", ["a", "", "b"]),
        ("\na\n \tB\nc \n", ["a", "b\nc", ""]),
        ("go https://a.b/c?d now", ["go", "", "now"]),
        ("", [""]),
    ],
)
def test_words_of(spark, given, expected):
    assert one(spark, given, text.words_of) == expected


def test_address_goes_even_after_punctuation(spark):
    address = "0x" + "aB" * 20
    assert one(spark, f"pay {address}, ok", text.clean_text) == "pay  ok"


def test_tags_go_when_punctuation_leaves_them(spark):
    assert one(spark, "<b>bold</b> x", lambda c: text.clean_text(c, punctuation="[,.]")) == "bold x"


@pytest.mark.parametrize(
    "word, kept",
    [
        ("12345", False),
        ("99999999999", True),
        ("2147483647", False),
        ("2147483648", True),
        ("12a", True),
        ("ab", False),
        ("abc", True),
        ("today", False),
        ("👍👍", False),
        ("", False),
    ],
)
def test_is_telling(spark, word, kept):
    assert one(spark, word, lambda c: text.is_telling(c, COMMON_WORDS)) is kept


@pytest.mark.parametrize(
    "value, part, found",
    [("ABCdef", "cD", True), ("abc", "a_c", True), ("abc", "a%c", True), (r"a\b", "\\", True), ("ab", "\\", False), (None, "a", None)],
)
def test_contains_text(spark, value, part, found):
    assert one(spark, value, lambda c: text.contains_text(c, part)) is found


def test_score_is_null_with_a_missing_part(spark):
    rows = spark.createDataFrame([(1, 2, 3), (None, 2, 3)], "l long, r long, p long")
    score = scores.weighted_score(F.col("l"), F.col("r"), F.col("p"), Weights(1, 3, 10))
    assert [r[0] for r in rows.select(score).collect()] == [37, None]


@pytest.mark.parametrize(
    "followers, casts, score, level, last",
    [
        (50000, 10, 50000, 4, 4),
        (50000, 9, 50000, 2, 2),
        (49999, 10, 25000, 3, 3),
        (1000, 5, 5000, 2, 2),
        (400, 1, 500, 1, 1),
        (400, 1, 499, 0, 1),
        (400, 1, 99, 0, 0),
        (None, 10, 50000, 0, 0),
        (50000, 10, None, 0, 0),
    ],
)
def test_user_ladders(spark, followers, casts, score, level, last):
    rows = spark.createDataFrame([(followers, casts, score)], "followers long, casts long, score long")
    measures = {name: F.col(name) for name in rows.columns}
    got = rows.select(
        scores.tier_level(USER_TIERS, measures).alias("now"),
        scores.tier_level(USER_TIERS_LAST, measures).alias("last"),
        scores.tier_label(USER_TIERS, measures).alias("label"),
    ).first()
    assert (got.now, got.last) == (level, last)
    assert got.label == next(rule.label for rule in USER_TIERS if rule.level == level)


def test_channel_ladder_needs_every_measure(spark):
    columns = "casts long, engagement long, casters long, stars long, leaders long"
    rows = spark.createDataFrame(
        [(250, 100000, 0, 0, 10), (250, 100000, 0, 50, 9), (250, 100000, 100, 49, 9), (5, 50, 0, None, None), (4, 50, 0, 0, 0)],
        columns,
    )
    measures = {name: F.col(name) for name in rows.columns}
    got = [r[0] for r in rows.select(scores.tier_level(CHANNEL_TIERS, measures)).collect()]
    assert got == [4, 3, 2, 1, 0]


def test_ladder_rises_with_each_measure(spark):
    steps = [0, 1, 5, 10, 400, 1000, 5000, 10000, 25000, 50000]
    rows = spark.createDataFrame([(f, c, s) for f in steps for c in steps for s in steps], "f long, c long, s long")
    measures = {"followers": F.col("f"), "casts": F.col("c"), "score": F.col("s")}
    levels = {(r.f, r.c, r.s): r.t for r in rows.withColumn("t", scores.tier_level(USER_TIERS, measures)).collect()}
    for before, after in zip(steps, steps[1:]):
        for a in steps:
            for b in steps:
                assert levels[before, a, b] <= levels[after, a, b]
                assert levels[a, before, b] <= levels[a, after, b]
                assert levels[a, b, before] <= levels[a, b, after]


def test_ladder_of_ground_only(spark):
    assert spark.range(1).select(scores.tier_level((TierRule(0, "x", {}),), {})).first()[0] == 0


def test_whole_days_and_calendar_days(spark, clock, table):
    rows = table("fids", [{"fid": 1, "created_at": datetime(2024, 1, 29, 1)}])
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    got = rows.select(F.timestamp_diff("DAY", F.col("created_at"), now), F.datediff(now, "created_at")).first()
    assert tuple(got) == (0, 1)


def test_fixed_words():
    assert len(COMMON_WORDS) == len(set(COMMON_WORDS))
    assert {"today", "thanks", "followers"} <= set(COMMON_WORDS)


def test_fixed_labels_weights_and_words():
    import hashlib

    from flockmetrics import settings as fixed

    assert [(r.level, r.label) for r in fixed.USER_TIERS] == [
        (4, "💎 vip"), (3, "🥇 influencer"), (2, "🥈 star"), (1, "🥉 active"), (0, "🤖 npc")
    ]
    assert [r.label for r in fixed.USER_TIERS_LAST] == [r.label for r in fixed.USER_TIERS]
    assert [(r.level, r.label) for r in fixed.CHANNEL_TIERS] == [
        (4, "👑 stadium"), (3, "🎭 subculture"), (2, "🔍 niche"), (1, "🍻 friends"), (0, "💤 quiet")
    ]
    weights = [(w.likes, w.recasts, w.replies) for w in (fixed.ENGAGEMENT_WEIGHTS, fixed.TIER_SCORE_WEIGHTS)]
    assert weights == [(1, 3, 10), (1, 5, 10)]
    assert (fixed.IGNORED_DOMAINS, fixed.SPACER) == (("warpcast.com", "x.com", "twitter.com"), "||")
    assert len(fixed.COMMON_WORDS) == 167
    assert hashlib.sha256(" ".join(fixed.COMMON_WORDS).encode()).hexdigest() == "f5b4cdb3e2ab3aa23bbab0a63858a25073ba51210f109487ce9ceb28f0c03f3a"


def test_trim_takes_all_white_space(spark):
    texts = ["alpha\u3000 \u2028beta\u2003", "\u205fgamma\x1c \t\u1680delta\r\n", "no\u00a0break \u2007x\u202f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.words_of(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["alpha", "beta"], ["gamma", "delta"], ["no\u00a0break", "\u2007x\u202f"]]
