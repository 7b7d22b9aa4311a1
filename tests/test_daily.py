"""States brought forward from an earlier run equal results computed in one step."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flockmetrics import Clock
from flockmetrics.operators.domains import linked_posts
from flockmetrics.operators.rollups import engaged_casts, followers
from flockmetrics.plans.book import MartBook
from flockmetrics.plans.channels import channel_members
from flockmetrics.plans.daily import Changes, DailyState, daily_sketches, deletions_between, sketched_weeks
from flockmetrics.sources.state import StateStore
from flockmetrics.sources.stored import store
from tests.conftest import AS_OF, SCHEMAS

DAY = timedelta(days=1)
LOGGED = ("casts", "links", "reactions")
STATES = ("follow_totals", "member_days", "reaction_days", "reply_days", "posts")


def world(seed, posts=160):
    """Rows of 30 days; a tenth is deleted at some time, a few have no author or no time."""
    rnd = random.Random(seed)

    def times(n):
        created = AS_OF - timedelta(hours=rnd.randint(0, 30 * 24))
        if n % 37 == 0:
            created = None
        gone = (created or AS_OF - 20 * DAY) + timedelta(hours=rnd.randint(1, 400)) if rnd.random() < 0.2 else None
        return {"created_at": created, "deleted_at": gone}

    casts = []
    for n in range(posts):
        root = rnd.randrange(posts) if n % 3 else None
        casts.append({
            "hash": n, "fid": None if n % 41 == 0 else rnd.randint(1, 6), "parent_hash": root, "root_parent_hash": root,
            "parent_url": rnd.choice([None, "c0", "c1", "c2"]), "root_parent_url": rnd.choice([None, None, "c0"]),
            "text": rnd.choice(["see https://a.b/1", "https://www.c.d", "none", None]), **times(n),
        })
    reactions = [
        {"fid": rnd.randint(1, 6), "target_fid": rnd.choice([None, 1, 2, 3]), "target_hash": rnd.randrange(posts), "reaction_type": rnd.randint(1, 3), **times(n)}
        for n in range(2 * posts)
    ]
    links = [{"fid": rnd.randint(1, 20), "target_fid": rnd.choice([None, 1, 2, 3, 4]), **times(n)} for n in range(posts)]
    return {"casts": casts, "reactions": reactions, "links": links}


def laid_out(table, name, rows):
    return store(table(name, rows).withColumn("created_day", F.to_date("created_at")), name, "created_day")


def build(table, tables, rows):
    built = tables()
    return replace(built, **{name: laid_out(table, name, rows[name]) for name in LOGGED})


def split(rows, since, late):
    """What was known at ``since``, what a later run must be given, and the log in between."""
    known, fresh, log = {}, {}, {}
    for name in LOGGED:
        known[name], fresh[name], log[name] = [], [], []
        for n, row in enumerate(rows[name]):
            old = row["created_at"] is None or row["created_at"] <= since
            if not old:
                fresh[name].append(row)
            elif n % late == 5:
                log[name].append(row | {"change": "insert"})
            else:
                known[name].append(row)
                # As of ``since`` it stood, and it does not any more.
                if row["deleted_at"] and since < row["deleted_at"] <= AS_OF:
                    log[name].append(row | {"change": "delete"})
    return known, fresh, log


def log_of(spark, log):
    out = {}
    for name, rows in log.items():
        columns = [part.split()[0] for part in SCHEMAS[name].split(", ")]
        out[name] = spark.createDataFrame([(*(r.get(c) for c in columns), r["change"]) for r in rows], SCHEMAS[name] + ", change string")
    return Changes(**out)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def views(daily):
    return {"engaged": daily.engaged_casts(), "linked": daily.linked_posts(), "members": daily.channel_members(), "followers": daily.followers()}


def one_step(tables, clock):
    return {
        "engaged": engaged_casts(tables.casts, tables.reactions, clock), "linked": linked_posts(tables.casts, clock),
        "members": channel_members(tables.casts, clock), "followers": followers(tables.links, clock),
    }


@pytest.mark.parametrize("seed, back, hour", [(1, 9 * DAY, 0), (2, 1 * DAY, 7), (3, 20 * DAY, 13)])
def test_two_steps_equal_one(spark, table, tables, tmp_path, seed, back, hour):
    clock = Clock(AS_OF + timedelta(hours=hour))
    since = Clock(clock.as_of - back)
    rows = world(seed)
    known, _, log = split(rows, since.as_of, late=11)
    for name in LOGGED:
        assert {r["change"] for r in log[name]} == {"insert", "delete"}
    states = StateStore(spark, str(tmp_path))
    before = DailyState(build(table, tables, known), since, states)
    for name in STATES:
        getattr(before, name)
    whole = build(table, tables, rows)
    after = DailyState(whole, clock, states, log_of(spark, log))
    expected = one_step(whole, clock)
    for name, got in views(after).items():
        assert rows_of(got) == rows_of(expected[name]), name


def test_second_day_reads_new_days_only(spark, table, tables, tmp_path):
    """The later run is given tables that hold nothing but the new rows and, as a first post of a day was
    deleted, the posts of those days."""
    clock = Clock(AS_OF)
    since = Clock(AS_OF - 3 * DAY)
    rows = world(4)
    known, fresh, log = split(rows, since.as_of, late=10**9)
    states = StateStore(spark, str(tmp_path))
    before = DailyState(build(table, tables, known), since, states)
    for name in STATES:
        getattr(before, name)
    lost = {r["created_at"].date() for r in log["casts"] if r["change"] == "delete" and r["created_at"]}
    again = [r for r in known["casts"] if r["created_at"] and r["created_at"].date() in lost]
    given = fresh | {"casts": fresh["casts"] + again}
    # Follows of the last week are counted from their rows.
    given["links"] = [r for r in rows["links"] if r["created_at"] and r["created_at"] >= AS_OF - 7 * DAY]
    part = build(table, tables, given)
    after = DailyState(part, clock, states, log_of(spark, log))
    expected = one_step(build(table, tables, rows), clock)
    for name, got in views(after).items():
        assert rows_of(got) == rows_of(expected[name]), name
    plan = after._signed("casts", since)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "created_day" in plan and ">= 2024-01-28" in plan


def test_book_opened_on_a_second_day(spark, table, tables, tmp_path):
    rows = world(5)
    since, clock = Clock(AS_OF - DAY), Clock(AS_OF)
    known, _, log = split(rows, since.as_of, late=13)
    states = StateStore(spark, str(tmp_path))
    first = MartBook(build(table, tables, known), since, daily=DailyState(build(table, tables, known), since, states))
    first.users().count(), first.channels().count()
    whole = build(table, tables, rows)
    second = MartBook(whole, clock, daily=DailyState(whole, clock, states, log_of(spark, log)))
    plain = MartBook(whole, clock)
    assert rows_of(second.users()) == rows_of(plain.users())
    assert rows_of(second.channels()) == rows_of(plain.channels())
    with pytest.raises(ValueError):
        MartBook(whole, since, daily=second.daily)


def test_log_of_a_table_without_one(spark, table, tables, tmp_path):
    rows = world(6)
    whole = build(table, tables, rows)
    since, clock = Clock(AS_OF - 6 * DAY), Clock(AS_OF)
    states = StateStore(spark, str(tmp_path))
    before = DailyState(whole, since, states)
    for name in STATES:
        getattr(before, name)
    changes = Changes(**{name: deletions_between(getattr(whole, name), clock, since) for name in LOGGED})
    expected = one_step(whole, clock)
    for name, got in views(DailyState(whole, clock, states, changes)).items():
        assert rows_of(got) == rows_of(expected[name]), name


def test_versions(spark, tmp_path):
    states = StateStore(spark, str(tmp_path))
    assert states.latest("x", AS_OF) is None
    for n in range(4):
        assert [r.n for r in states.commit("x", spark.range(n, n + 1).toDF("n"), AS_OF + n * DAY).collect()] == [n]
    assert [v.as_of for v in states.versions("x")] == [AS_OF + 2 * DAY, AS_OF + 3 * DAY]
    assert states.latest("x", AS_OF + 2.5 * DAY).as_of == AS_OF + 2 * DAY and states.latest("x", AS_OF) is None
    # What a run that died has written is not read.
    (tmp_path / "x" / f"as_of-{AS_OF + 9 * DAY:%Y%m%dT%H%M%S%f}-dead").mkdir()
    assert states.latest("x", AS_OF + 99 * DAY).as_of == AS_OF + 3 * DAY


def test_a_run_that_is_repeated_finds_its_states(spark, table, tables, tmp_path):
    rows = world(7, 60)
    whole = build(table, tables, rows)
    states = StateStore(spark, str(tmp_path))
    once = DailyState(whole, Clock(AS_OF), states)
    first = rows_of(once.followers())
    again = DailyState(build(table, tables, {name: [] for name in LOGGED}), Clock(AS_OF), states)
    assert rows_of(again.follow_totals) == rows_of(once.follow_totals) and len(states.versions("follows")) == 1 and first


def test_sketches_of_days_unite(spark, table, tables, tmp_path):
    rnd = random.Random(8)
    rows = world(8, 10)
    rows["casts"] = [
        {"hash": n, "fid": rnd.randint(1, 900), "parent_hash": None if n % 2 else 1, "parent_url": "big", "created_at": AS_OF - timedelta(minutes=1 + n % 20_000)}
        for n in range(4_000)
    ]
    whole = build(table, tables, rows)
    since, clock = Clock(AS_OF - 2 * DAY), Clock(AS_OF)
    states = StateStore(spark, str(tmp_path))
    DailyState(whole, since, states).sketches()
    daily = DailyState(whole, clock, states)
    found = {r.parent_url: r for r in sketched_weeks(daily.sketches(), clock).collect()}["big"]
    for back, suffix in ((7, ""), (14, "_last")):
        inside = [r for r in rows["casts"] if AS_OF - back * DAY <= r["created_at"] < AS_OF - (back - 7) * DAY]
        exact = {
            "rolling_casts": sum(r["parent_hash"] is None for r in inside), "rolling_replies": sum(r["parent_hash"] is not None for r in inside),
            "casters": len({r["fid"] for r in inside}),
        }
        for name, n in exact.items():
            assert abs(found[name + suffix] - n) <= max(1, 3 * 0.023 * n), name + suffix
    whole_days = daily_sketches(daily.posts).count()
    assert daily.sketches().count() == whole_days
