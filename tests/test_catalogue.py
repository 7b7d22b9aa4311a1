"""Results found again by later books."""

from dataclasses import replace

import pytest

from flockmetrics import Settings, SocialTables
from flockmetrics.plans.book import READS, MartBook
from flockmetrics.sources.catalogue import Catalogue, table_version
from tests.conftest import SCHEMAS
from tests.test_daily import rows_of, world


class Counting(Catalogue):
    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.built = []

    def result(self, name, key, build):
        def counted():
            df = build()
            self.built.append(name)
            return df

        return super().result(name, key, counted)


@pytest.fixture
def folder(table, tmp_path):
    rows = world(5) | {
        "profiles": [{"fid": n, "fname": f"user{n}"} for n in range(1, 7)],
        "fids": [{"fid": n, "custody_address": bytearray([n] * 20)} for n in range(1, 7)],
        "wallet_activity": [{"wallet": bytearray([2] * 20), "txs": 7, "nft_volume_usd": 1.5}],
    }
    for name in SCHEMAS:
        table(name, rows.get(name, ())).write.parquet(f"{tmp_path}/in/{name}")
    return tmp_path


def opened(spark, folder, clock, settings=Settings(), **options):
    catalogue = Counting(spark, f"{folder}/results")
    return MartBook(SocialTables.from_folder(spark, f"{folder}/in"), clock, settings, catalogue=catalogue, **options), catalogue


def both(book):
    return rows_of(book.users()), rows_of(book.channels())


def test_a_second_session_computes_nothing(spark, folder, clock):
    first, made = opened(spark, folder, clock)
    want = both(MartBook(first.tables, clock))
    assert want[0] and want[1]
    assert both(first) == want
    assert sorted(made.built) == sorted(set(READS) - {"member_ranges"})  # only made where holders are asked for
    second, found = opened(spark.newSession(), folder, clock)
    assert both(second) == want
    assert found.built == []


# A changed table: what depends on it is computed anew, and nothing else.
CHANGES = {
    "links": {"users", "caster_summary", "channels"},
    "early_channels": {"users", "caster_summary", "channels"},
    "fids": {"address_book", "users", "caster_summary", "channels"},
    "reactions": {"engaged_casts", "users", "caster_summary", "channels"},
    "stopwords": set(),
}


@pytest.mark.parametrize("name", CHANGES)
def test_a_changed_table_recomputes_its_descendants(spark, table, folder, clock, name):
    both(opened(spark, folder, clock)[0])
    row = {
        "links": {"fid": 19, "target_fid": 1}, "early_channels": {"channel_id": "zero", "parent_url": "c0"},
        "fids": {"fid": 2, "custody_address": bytearray([9] * 20)}, "reactions": {"fid": 3, "target_hash": 1, "reaction_type": 1},
        "stopwords": {"stopwords": "word"},
    }[name]
    table(name, [row]).write.mode("append").parquet(f"{folder}/in/{name}")
    book, catalogue = opened(spark, folder, clock)
    assert both(book) == both(MartBook(book.tables, clock))
    assert set(catalogue.built) == CHANGES[name]


def test_settings_clock_and_zone_are_part_of_the_key(spark, folder, clock):
    one = opened(spark, folder, clock)[0]
    other = opened(spark, folder, clock, Settings(ignored_domains=("a.b",)))[0]
    assert {name for name in READS if one.key(name) != other.key(name)} == {"users", "caster_summary", "channels"}
    later = opened(spark, folder, replace(clock, active_days=13))[0]
    assert all(one.key(name) != later.key(name) for name in READS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    before = one.key("linked_posts")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one.key("linked_posts") != before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_an_attempt_that_died_is_not_found(spark, folder, clock):
    book, _ = opened(spark, folder, clock)
    rows = rows_of(book.linked)
    key = book.key("linked_posts")
    catalogue = Catalogue(spark, f"{folder}/results")
    path = catalogue.find("linked_posts", key)
    catalogue._files(path).delete(catalogue._path(f"{path}/_SUCCESS"), False)
    again, counted = opened(spark, folder, clock)
    assert rows_of(again.linked) == rows
    assert counted.built == ["linked_posts"]


def test_other_keys_can_be_forgotten(spark, folder, clock):
    old = opened(spark, folder, replace(clock, active_days=13))[0]
    new = opened(spark, folder, clock)[0]
    rows_of(old.linked), rows_of(new.linked)
    assert [path.split("/")[-2:] for path in new.forget_others()] == [["linked_posts", old.key("linked_posts")]]
    assert opened(spark, folder, clock)[1].find("linked_posts", new.key("linked_posts"))


def test_tables_without_files_need_a_version(spark, tables, folder, clock):
    in_memory = tables(**world(5))
    with pytest.raises(ValueError, match="version"):
        table_version(in_memory.casts)
    catalogue = Counting(spark, f"{folder}/results")
    named = {name: "1" for name in SCHEMAS}
    rows = rows_of(MartBook(in_memory, clock, catalogue=catalogue, versions=named).users())
    assert rows_of(MartBook(in_memory, clock, catalogue=catalogue, versions=named).users()) == rows
    assert sorted(catalogue.built) == sorted({"engaged_casts", "linked_posts", "address_book", "users"})
    moved = MartBook(in_memory, clock, catalogue=catalogue, versions=named | {"casts": "2"})
    assert moved.key("users") != MartBook(in_memory, clock, catalogue=catalogue, versions=named).key("users")
