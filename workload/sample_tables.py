"""Social tables derived from the star-schema tables, for the registered queries and the bench.

Every row of every source table that is used takes part and texts are whole. One SQL text per
table serves Spark and DuckDB; only type names and the array constructor differ.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockmetrics import Clock, Settings, SocialTables
from flockmetrics.operators.joins import fits_broadcast
from flockmetrics.settings import TierRule
from flockmetrics.sources.stored import store
from flockmetrics.sources.tables import DAY
from flockmetrics.plans.book import MartBook

AS_OF = datetime(2024, 1, 31)
SOURCES = ("customer", "documents", "events", "lineitem", "orders", "pages", "part", "supplier")

DEFINITIONS = {
    # One post per event. Three of four are replies; every document is the text of one post and
    # the other posts are short.
    "casts": """
        with sizes as (
          select greatest(1, cast(floor((select count(*) from {events}) / (select count(*) from {documents})) as bigint)) as gap
        ), keyed as (
          select event_id, user_id, event_type, ts,
            event_id % (select count(*) from {pages}) as page_key,
            event_id % (select count(*) from {part}) as part_key,
            case when event_id % (select gap from sizes) = 0
                 then cast(floor(event_id / (select gap from sizes)) as bigint)
                 else -1 - event_id end as doc_key, -- matches no document, and no two posts share it
            greatest(0, event_id - event_id % 4 - 4 * (event_id % 7)) as root
          from {events}
        ), placed as (
          select k.*, p.url, q.p_name, q.p_brand, lower(q.p_type) as topic, d.text as long_text,
            case event_id % 5 when 0 then null when 1 then p.url
                 else concat('https://warpcast.com/~/channel/', lower(q.p_type)) end as home
          from keyed k
          join {pages} p on p.page_id = k.page_key
          join {part} q on q.p_partkey = k.part_key
          left join {documents} d on d.doc_id = k.doc_key
        )
        select event_id as hash, user_id as fid,
          case event_id % 4 when 0 then null when 1 then root else event_id - 1 end as parent_hash,
          case when event_id % 4 <> 0 then root end as root_parent_hash,
          case when event_id % 4 = 0 then home
               when event_id % 7 = 0 then concat('https://warpcast.com/~/channel/', topic, '-b') end as parent_url,
          case when event_id % 4 <> 0 then home end as root_parent_url,
          concat(case when event_id % 3 = 0 then concat('see ', url, ' and https://x.com/a ') else '' end,
                 coalesce(long_text, concat(p_name, ' ', topic, ' by ', p_brand))) as text,
          ts as created_at,
          case when event_type = 'error' then ts end as deleted_at
        from placed
    """,
    "reactions": """
        with keyed as (
          select *, l_orderkey % least((select count(*) from {events}), 1000000007) as k from {lineitem}
        ), aimed as (
          select *, (k * k) % (select count(*) from {events}) as target from keyed
        )
        select l_suppkey + l_linenumber as fid, e.user_id as target_fid, e.event_id as target_hash,
          cast(1 + l_linenumber % 2 as int) as reaction_type,
          e.ts + l_linenumber * interval '1' hour as created_at,
          case when l_returnflag = 'R' then l_shipdate end as deleted_at
        from aimed join {events} e on e.event_id = target
    """,
    "links": """
        with keyed as (
          select *, o_orderkey % (select max(user_id) + 1 from {events}) as k from {orders}
        )
        select o_custkey % (select max(user_id) + 1 from {events}) as fid,
          (k * k) % (select max(user_id) + 1 from {events}) as target_fid,
          cast('2024-01-01 00:00:00' as {timestamp}) + (o_orderkey % 30) * interval '1' day as created_at,
          case when o_orderstatus = 'F' then o_orderdate end as deleted_at
        from keyed
    """,
    # Some accounts get an id nobody posts under, so some authors lack a registration or profile.
    "fids": """
        select case when c_custkey % 29 = 28 then c_custkey + (select count(*) from {customer}) else c_custkey end as fid,
          unhex(lpad(cast(c_custkey as {string}), 40, '0')) as custody_address,
          cast('2023-12-01 13:00:00' as {timestamp}) + (c_custkey % 55) * interval '1' day as created_at
        from {customer}
    """,
    "verifications": """
        select s_suppkey as fid,
          case when s_suppkey % 9 = 0 then 'not json'
               else concat('{{"address": "0x', lpad(cast(s_suppkey + 50 as {string}), 40, '0'), '"}}') end as claim
        from {supplier}
    """,
    "profiles": """
        select case when c_custkey % 37 = 36 then c_custkey + (select count(*) from {customer}) else c_custkey end as fid,
          case when c_custkey % 11 = 0 then null else lower(replace(c_name, '#', '')) end as fname
        from {customer}
        union all -- rows that repeat, and accounts with a second name
        select c_custkey, lower(replace(c_name, '#', '')) from {customer} where c_custkey % 53 = 1 and c_custkey % 11 <> 0
        union all
        select c_custkey, concat(lower(replace(c_name, '#', '')), '-too') from {customer} where c_custkey % 59 = 2
    """,
    "early_channels": """
        select distinct
          concat('https://warpcast.com/~/channel/', lower(p_type), case when p_type = 'PROMO' then '-old' else '' end) as parent_url,
          concat('early-', lower(p_type)) as channel_id
        from {part}
    """,
    "wallet_activity": """
        select unhex(lpad(cast(2 * c_custkey as {string}), 40, '0')) as wallet, c_custkey % 13 as txs,
          c_acctbal as nft_volume_usd,
          case when c_custkey % 17 = 0 then null else c_acctbal / 2 end as dex_volume_usd,
          c_custkey % 3 as contracts_deployed,
          case when c_custkey % 97 = 5 -- a token that few hold
               then {array}(unhex(lpad(cast(c_custkey % 5 as {string}), 40, '0')), unhex(lpad('77', 40, '0')))
               else {array}(unhex(lpad(cast(c_custkey % 5 as {string}), 40, '0'))) end as erc20_addresses,
          case when c_custkey % 7 = 0 then null
               else {array}(unhex(lpad(cast(10 + c_custkey % 3 as {string}), 40, '0'))) end as nft_addresses
        from {customer}
    """,
}

# A parameter of the word statistics: frequent words of the generated languages, one of them
# twice and two with punctuation, as stopword files have them.
STOPWORDS = ("the", "and", "of", "to", "in", "no", "you're", "won't", "no", "les", "des", "que", "der", "und", "los", "las")

# Thresholds lowered until every rung is reached on the small derived tables.
SAMPLE_SETTINGS = Settings(
    user_tiers=(
        TierRule(4, "💎 vip", {"followers": 270, "casts": 8, "score": 600}),
        TierRule(3, "🥇 influencer", {"followers": 255, "casts": 8, "score": 400}),
        TierRule(2, "🥈 star", {"followers": 240, "casts": 5, "score": 200}),
        TierRule(1, "🥉 active", {"followers": 120, "casts": 1, "score": 50}),
        TierRule(0, "🤖 npc", {}),
    ),
    user_tiers_last=(
        TierRule(4, "💎 vip", {"followers": 270, "casts": 8, "score": 600}),
        TierRule(3, "🥇 influencer", {"followers": 255, "casts": 8, "score": 400}),
        TierRule(2, "🥈 star", {"followers": 240, "casts": 5, "score": 200}),
        TierRule(1, "🥉 active", {"followers": 120, "casts": 1, "score": 10}),
        TierRule(0, "🤖 npc", {}),
    ),
    channel_tiers=(
        TierRule(4, "👑 stadium", {"casts": 40, "engagement": 1400, "leaders": 7}),
        TierRule(3, "🎭 subculture", {"casts": 40, "engagement": 500, "stars": 5, "leaders": 2}),
        TierRule(2, "🔍 niche", {"casts": 5, "engagement": 250, "casters": 4}),
        TierRule(1, "🍻 friends", {"casts": 2, "engagement": 50}),
        TierRule(0, "💤 quiet", {}),
    ),
)

LAID_OUT_BY_DAY = ("casts", "reactions", "links")

_tables: dict[tuple[str, str], DerivedTables] = {}
_books: dict[tuple[str, str], MartBook] = {}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How a post comes by the text of a document, and which posts may have one.
TEXT_JOIN = "left join {documents} d on d.doc_id = k.doc_key"
MAY_HAVE_TEXT = """coalesce(
    k.doc_key between (select min(doc_id) from {documents}) and (select max(doc_id) from {documents}), false)"""


def spark_texts(name: str) -> tuple[str, ...]:
    """Queries whose rows together are the table. Only posts that may have a document meet the texts;
    most have none and need not be dealt and sorted beside them."""
    text = DEFINITIONS[name]
    if TEXT_JOIN not in text:
        return (text,)
    without = TEXT_JOIN.replace("{documents}", "(select doc_id, text from {documents} where false)")
    return (
        text.replace(TEXT_JOIN, f"{TEXT_JOIN} where {MAY_HAVE_TEXT}"),
        text.replace(TEXT_JOIN, f"{without} where not {MAY_HAVE_TEXT}"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """What posts take from the pages, copied to every executor if it is measured to be small. The planner's
    estimate counts part of the pages' text, which is not read, and deals all posts for it."""
    slim = pages.select("page_id", "url")
    return F.broadcast(slim) if fits_broadcast(slim) else slim


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {table: source(spark, sf_dir, table) for table in SOURCES if "{%s}" % table in DEFINITIONS[name]}
    if "pages" in sources:
        sources["pages"] = page_links(sources["pages"])
    rows = []
    for text in spark_texts(name):
        for placeholder, spelled in (("{timestamp}", "timestamp_ntz"), ("{string}", "string"), ("{array}", "array")):
            text = text.replace(placeholder, spelled)
        rows.append(spark.sql(text, **sources))
    return reduce(DataFrame.unionByName, rows)


def duckdb_definitions() -> dict[str, str]:
    spelled = {"timestamp": "timestamp", "string": "varchar", "array": "list_value"}
    return {name: text.format(**{table: table for table in SOURCES}, **spelled) for name, text in DEFINITIONS.items()}


class DerivedTables(SocialTables):
    """Tables that are made when they are first asked for, so a query derives only what it reads."""

    def __init__(self, make: Callable[[str], DataFrame]) -> None:
        self.__dict__.update(_make=make, _locks=defaultdict(Lock))

    def __getattr__(self, name: str) -> DataFrame:
        # Called for what is not there yet.
        if name not in self.names():
            raise AttributeError(name)
        with self._locks[name]:
            if name not in self.__dict__:
                self.__dict__[name] = self._make(name)
        return self.__dict__[name]

    def derive(self, *names: str) -> DerivedTables:
        """Make the named tables, or all, side by side."""
        with ThreadPoolExecutor() as pool:
            list(pool.map(lambda name: getattr(self, name), names or self.names()))
        return self


def sample_tables(spark: SparkSession, sf_dir: str) -> DerivedTables:
    """The derived tables, each written once per application, when it is first read, and read as plain Parquet afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:

        def make(name: str) -> DataFrame:
            if name == "stopwords":
                return spark.createDataFrame([(word,) for word in STOPWORDS], "stopwords string")
            rows = derive(spark, sf_dir, name)
            if name not in LAID_OUT_BY_DAY:
                return store(rows, name)
            return store(rows.withColumn(DAY, F.to_date("created_at")), name, DAY)

        _tables[key] = DerivedTables(make)
    return _tables[key]


def sample_clock() -> Clock:
    return Clock(AS_OF)


def sample_book(spark: SparkSession, sf_dir: str) -> MartBook:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _books:
        _books[key] = MartBook(sample_tables(spark, sf_dir), sample_clock(), SAMPLE_SETTINGS)
    return _books[key]
