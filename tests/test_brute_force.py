"""Random small worlds with hot keys, computed once by the engine and once by plain loops."""

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flockmetrics import Settings
from flockmetrics.operators.rollups import engaged_casts
from flockmetrics.plans import channels
from flockmetrics.plans.users import WEEKLY_COUNTS, user_channel_activity
from tests.conftest import AS_OF

DAY = timedelta(days=1)
MOMENTS = [AS_OF - n * DAY / 2 for n in range(-2, 34)]  # both week edges and the future included


def hot(rng, values):
    """A third of all picks fall on the first value."""
    return values[0] if rng.random() < 1 / 3 else rng.choice(values)


@pytest.fixture(scope="module", params=range(3))
def world(request):
    rng = random.Random(request.param)
    urls, fids = [None, "u1", "u2", "u3"], [1, 2, 3, 4, 5, None]
    casts = []
    for key in range(250):
        root = hot(rng, list(range(key))) if key and rng.random() < 0.6 else None
        casts.append({
            "hash": key, "fid": hot(rng, fids), "root_parent_hash": root,
            "parent_hash": rng.choice([root, None]) if root is not None else None,
            "parent_url": hot(rng, urls), "root_parent_url": rng.choice(urls), "text": "",
            "created_at": rng.choice(MOMENTS), "deleted_at": AS_OF if rng.random() < 0.1 else None,
        })
    reactions = [
        {"fid": rng.choice(fids), "target_fid": rng.choice(fids), "target_hash": hot(rng, list(range(0, 250, 3))),
         "reaction_type": rng.choice([1, 2, 2, 3]), "created_at": rng.choice(MOMENTS),
         "deleted_at": AS_OF if rng.random() < 0.1 else None}
        for _ in range(400)
    ]
    return casts, reactions


def live(row):
    return row["deleted_at"] is None and AS_OF - 14 * DAY <= row["created_at"] <= AS_OF


def weeks(row):
    at = row["created_at"]
    return [suffix for suffix, inside in (("", at >= AS_OF - 7 * DAY), ("_last", at <= AS_OF - 7 * DAY)) if inside]


def differ(a, b):
    return a is not None and b is not None and a != b


def with_engagement(casts, reactions):
    """(post, likes, recasts, ids of replies by others); likes and recasts are None without reactions."""
    received = defaultdict(Counter)
    for r in filter(live, reactions):
        if differ(r["fid"], r["target_fid"]):
            received[r["target_hash"]][r["reaction_type"]] += 1
    for c in filter(live, casts):
        answers = [a["hash"] for a in filter(live, casts) if a["root_parent_hash"] == c["hash"] and differ(a["fid"], c["fid"])]
        got = received.get(c["hash"])
        yield c, got and got[1], got and got[2], answers


def add(total, value):
    """SUM: NULL inputs add nothing, and only NULL inputs give NULL."""
    return total if value is None else (total or 0) + value


def first(*values):
    return next((v for v in values if v is not None), None)


def naive_user_channels(casts, reactions, repeat):
    groups = defaultdict(lambda: dict.fromkeys(WEEKLY_COUNTS))
    for c, likes, recasts, answers in with_engagement(casts, reactions):
        group = groups[c["fid"], first(c["parent_url"], c["root_parent_url"])]
        times = max(1, len(answers)) if repeat else 1
        for suffix in ("", "_last"):
            inside = suffix in weeks(c)
            for name, value in (
                ("casts", 1), ("got_replies", len(answers)),
                ("got_likes", likes and likes * times if likes is not None else None),
                ("got_recasts", recasts * times if recasts is not None else None),
            ):
                group[name + suffix] = add(group[name + suffix], value if inside else 0)
    return dict(groups)


def naive_channels(casts, reactions, tiers):
    stats = defaultdict(lambda: {"engagement": None, "casts": 0, "replies": 0, "likes": None, "casters": set(), "tier": Counter()})
    for c, likes, recasts, answers in with_engagement(casts, reactions):
        channel = first(c["root_parent_url"], c["parent_url"])
        if channel is None:
            continue
        s = stats[channel]
        this_week = "" in weeks(c)
        points = None if likes is None else likes + 3 * recasts + 10 * len(answers)
        s["engagement"] = add(s["engagement"], points if this_week else 0)
        if this_week:
            s["casts" if c["parent_hash"] is None else "replies"] += 1
            s["likes"] = add(s["likes"], likes)
            s["casters"].add(c["fid"])
    for s in stats.values():
        s["tier"] = Counter(tiers[f] for f in s["casters"] if f in tiers)
    return stats


@pytest.mark.parametrize("repeat", [True, False])
def test_user_channels(world, table, clock, repeat):
    casts, reactions = world
    engaged = engaged_casts(table("casts", casts), table("reactions", reactions), clock)
    rows = user_channel_activity(engaged, Settings(repeat_likes=repeat)).collect()
    got = {(r.fid, r.parent_url): {name: r[name] for name in WEEKLY_COUNTS} for r in rows}
    assert got == naive_user_channels(casts, reactions, repeat)


def test_channels(spark, world, table, clock):
    casts, reactions = world
    tiers = {1: 4, 2: 0, 3: 3, 4: 0}
    users = spark.createDataFrame(
        [(f, f"n{f}", t, f, 1.0, 0) for f, t in tiers.items()],
        "fid long, fname string, fid_active_tier int, total_transactions long, trading_volume_usd double, contracts_deployed long",
    )
    engaged = engaged_casts(table("casts", casts), table("reactions", reactions), clock)
    summary = channels.caster_summary(channels.caster_activity(channels.cast_engagement(engaged)), users)
    got = {r.parent_url: r for r in channels.channel_cast_stats(summary).collect()}
    expected = naive_channels(casts, reactions, tiers)
    assert set(got) == set(expected)
    for channel, e in expected.items():
        g = got[channel]
        assert (g.rolling_casts, g.rolling_replies, g.rolling_likes, g.engagement) == (e["casts"], e["replies"], e["likes"], e["engagement"])
        assert g.casters == len(e["casters"] - {None})
        assert (g.active_npc, g.active_influencer, g.active_vip) == (e["tier"][0], e["tier"][3], e["tier"][4])


def test_members(world, table, clock):
    casts, _ = world
    members = channels.channel_members(table("casts", casts), clock)
    kept = [c for c in casts if c["deleted_at"] is None and c["created_at"] <= AS_OF]
    expected = defaultdict(list)
    for c in kept:
        channel = first(c["root_parent_url"], c["parent_url"])
        if channel is not None:
            expected[channel, c["fid"]].append(c["created_at"])
    got = {(r.parent_url, r.fid): r.first_cast_at for r in members.collect()}
    assert got == {key: min(times) for key, times in expected.items()}
    ages = {r.parent_url: r.channel_age for r in channels.channel_ages(members, clock).collect()}
    for channel in ages:
        oldest = min(t for (url, _), t in got.items() if url == channel)
        assert ages[channel] == (AS_OF.date() - oldest.date()).days
    listed = {r.parent_url: r.all_caster_fids for r in channels.with_member_lists(channels.channel_ages(members, clock), members).collect()}
    for channel, fids in listed.items():
        assert sorted(fids, key=lambda f: (f is not None, f or 0)) == fids
        assert set(fids) == {fid for url, fid in got if url == channel}


def test_sketch_close_to_exact(spark, clock, table):
    rows = [{"hash": i, "fid": i % 2000, "parent_url": "u"} for i in range(6000)]
    sketched = table("casts", rows).agg(F.approx_count_distinct("fid", Settings().sketch_error)).first()[0]
    assert abs(sketched - 2000) <= 0.1 * 2000
