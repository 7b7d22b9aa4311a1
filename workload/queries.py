"""One registered query per operator, over the derived social tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockmetrics import Clock
from flockmetrics.functions import chain, links, scores, text
from flockmetrics.operators.domains import linked_posts, top_domains
from flockmetrics.operators.joins import dimension_join
from flockmetrics.operators.lists import distinct_list, ordered_list, top_k_list
from flockmetrics.operators.rollups import by_others, followers, is_root, is_top_level, reactions_received, replies_received
from flockmetrics.operators.wallets import address_book, token_holders, volume, wallet_totals
from flockmetrics.plans import channels, trending, users, words
from flockmetrics.plans.book import MartBook, preview
from flockmetrics.plans.daily import Changes, DailyState, deletions_between, sketched_weeks
from flockmetrics.plans.trending import ChannelFilters, UserFilters
from flockmetrics.settings import IGNORED_DOMAINS, SPACER, Settings
from flockmetrics.sources.catalogue import Catalogue
from flockmetrics.sources.csv_tables import read_csv_table, register_csv_folder
from flockmetrics.sources.quality import duplicate_keys
from flockmetrics.sources.state import StateStore
from flockmetrics.sources.stored import shared_folder
from flockmetrics.sources.tables import channel_key, live_rows, not_deleted, rows_within, thread_channel_key
from workload.sample_tables import SAMPLE_SETTINGS, STOPWORDS, sample_book, source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the filtered views; zero-padded hex stands for a token of the derived wallets.
TRACKED = "customer000000004"
TOKEN = "0x" + "2".zfill(40)
NFT = "12".zfill(40)
RARE = "77".zfill(40)
TOPIC = "EcOnOmY"


def flat(df: DataFrame) -> DataFrame:
    """Lists as joined text, bytes as hex and doubles rounded, for comparison across engines."""

    def plain(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("<null>"))

    def as_hex(value: Column) -> Column:
        return F.coalesce(F.lower(F.hex(value)), F.lit("<null>"))

    shown = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind.startswith("array<"):
            column = F.array_join(F.transform(column, as_hex if kind == "array<binary>" else plain), "|")
        elif kind == "binary":
            column = F.lower(F.hex(column))
        elif kind == "double":
            column = F.round(column, 6) + F.lit(0.0)
        shown.append(column.alias(name))
    return df.select(*shown)


def registered(build: Callable[[MartBook], DataFrame]) -> Callable[[MartBook], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(build(sample_book(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def whole_words(book: MartBook, stopwords: DataFrame | None = None) -> DataFrame:
    """Words of all live posts of the window, whoever wrote them."""
    posts = live_rows(book.tables.casts, book.clock)
    this_week = F.when(book.clock.this_week(posts), 1).otherwise(0).alias("this_week")
    slim = posts.select("hash", "fid", this_week, "text")
    return words.telling_words(slim, book.tables.stopwords if stopwords is None else stopwords)


# --- Sources ---


@registered
def scan_tables(b):
    counts = [
        getattr(b.tables, name).agg(F.count("*").alias("rows_read")).select(F.lit(name).alias("table_name"), "rows_read")
        for name in b.tables.names()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def src_csv_dim(spark, sf_dir):
    """Parts written as CSV, loaded back through the CSV loader."""
    path = f"{shared_folder(spark)}/parts_csv-{uuid.uuid4().hex}"
    source(spark, sf_dir, "part").write.option("header", True).csv(path)
    parts = read_csv_table(spark, path)
    size = F.col("p_size").cast("long")
    return flat(parts.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum(size).alias("sizes")))


QUERIES["src_csv_dim"] = src_csv_dim


def write_csv(spark: SparkSession, lines: DataFrame, folder: str, name: str) -> None:
    """Raw lines as one file of the given name."""
    work = f"{folder}/{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(work)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(hadoop.Path(work)) if s.getPath().getName().startswith("part-"))
    files.rename(part, hadoop.Path(f"{folder}/{name}"))


#: Rows of a part file: some 100 MB.
CSV_ROWS = 1_000_000


def write_csv_parts(spark: SparkSession, head: str, lines: DataFrame, path: str) -> None:
    """Raw lines as a folder of files that each begin with ``head``; one holds nothing else."""
    # The lower 33 bits number the rows of a task, which begins a file with every ``CSV_ROWS``.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    headed = lines.select(F.when(nth % CSV_ROWS == 0, F.concat(F.lit(f"{head}\n"), "value")).otherwise(F.col("value")).alias("value"))
    spark.range(0, 1, 1, 1).select(F.lit(head).alias("value")).union(headed).write.option("maxRecordsPerFile", CSV_ROWS).text(path)


def src_csv_folder(spark, sf_dir):
    """Parts in a folder of CSV files with a byte-order mark, quotes, line breaks and backslashes, next to other files."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    field = F.concat(F.lit('"say ""'), "p_name", F.lit('"", ok\nand \\"'))
    rows = source(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", field, "p_brand").alias("value"))
    write_csv_parts(spark, "\ufeffp_partkey,note,p_brand", rows, f"{folder}/Part Notes.v2.csv")
    write_csv(spark, spark.range(1).select(F.lit("no, table").alias("value")), folder, "readme.txt")
    loaded = register_csv_folder(spark, folder)
    return loaded["part_notes"].select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "note", "p_brand", F.lit(len(loaded)).alias("tables")
    )


QUERIES["src_csv_folder"] = src_csv_folder


def stopwords_csv(spark, sf_dir):
    """Word counts with stopwords from a CSV file that has a byte-order mark, a repeated word and apostrophes."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    lines = spark.range(1).select(F.explode(F.array(*map(F.lit, ("\ufeffstopwords", *STOPWORDS)))).alias("value"))
    write_csv(spark, lines, folder, "stopwords.csv")
    b = sample_book(spark, sf_dir)
    stopwords = read_csv_table(spark, f"{folder}/stopwords.csv")
    return flat(whole_words(b, stopwords).groupBy("word").agg(F.count("*").alias("n")))


QUERIES["stopwords_csv"] = stopwords_csv


@registered
def key_duplicates(b):
    return duplicate_keys(b.tables)


@registered
def preview_users(b):
    head, _, _ = preview(b.users())
    return head


@registered
def preview_summary(b):
    """Count and extremes of the previewed rows, and how many columns the schema names."""
    _, summary, schema = preview(b.users())
    shown = summary.filter(F.col("summary").isin("count", "min", "max")).select("summary", "followers", "casts")
    return shown.withColumn("columns", F.lit(schema.count("\n |-- ")))


@registered
def result_by_name(b):
    """A result from the registry, by its name."""
    return b.result("users_by_tier")


# --- Predicates and conditionals ---


@registered
def soft_delete_window(b):
    casts = b.tables.casts
    week = rows_within(casts, b.clock, b.clock.recent_days).filter(not_deleted(casts, b.clock))
    recent = week.groupBy("fid").agg(F.count("*").alias("casts_7d"))
    return live_rows(casts, b.clock).groupBy("fid").agg(F.count("*").alias("casts_14d")).join(recent, "fid", "left")


@registered
def prev_week_between(b):
    casts = b.tables.casts
    return casts.filter(b.clock.last_week(casts)).groupBy("fid").agg(F.count("*").alias("casts_last"))


@registered
def week_flag(b):
    live = live_rows(b.tables.casts, b.clock)
    flag = F.when(b.clock.this_week(live), 1).otherwise(0)
    return live.groupBy(flag.alias("this_week")).agg(F.count("*").alias("casts"))


@registered
def self_exclusion(b):
    return by_others(b.tables.reactions).groupBy("reaction_type").agg(F.count("*").alias("reactions"))


@registered
def channel_keys(b):
    """Both orders of the two channel columns, and posts with a channel."""
    casts = b.tables.casts.filter(channel_key().isNotNull())
    return casts.groupBy(channel_key().alias("channel"), thread_channel_key().alias("thread_channel")).agg(
        F.count("*").alias("casts")
    )


@registered
def null_tests(b):
    return b.tables.casts.groupBy(is_top_level().alias("is_top_level"), is_root().alias("is_root")).agg(F.count("*").alias("casts"))


@registered
def not_in_list(b):
    domain = links.link_domain(F.col("text"))
    linked = b.tables.casts.select(domain.alias("domain")).filter(~F.col("domain").isin(*IGNORED_DOMAINS))
    return linked.groupBy("domain").agg(F.count("*").alias("casts"))


@registered
def contains_ci(b):
    found = b.tables.casts.filter(text.contains_text(F.col("parent_url"), TOPIC))
    return found.groupBy("parent_url").agg(F.count("*").alias("casts"))


@registered
def optional_filter(b):
    """A switched-off filter leaves everything."""
    filters = UserFilters.from_texts(10_000, "all channels", "no filter", "all", "none", "followers")
    return b.trending_users(filters).groupBy("fid_active_tier").agg(F.count("*").alias("users"))


@registered
def threshold_filter(b):
    old_enough = (F.col("account_age") <= 30) & (F.col("fid_active_tier") >= 1)
    return b.stored_users.filter(old_enough).select("fid", "account_age", "fid_active_tier")


@registered
def numeric_and_short_tokens(b):
    tokens = b.tables.casts.select(F.explode(text.words_of(F.col("text"))).alias("word"))
    is_number = text.is_integer(F.col("word"))
    is_short = F.length("word") <= 2
    return tokens.groupBy(is_number.alias("is_number"), is_short.alias("is_short")).agg(F.count("*").alias("tokens"))


@registered
def tier_ladder(b):
    """The published user ladder over follower counts and a score made of them."""
    rules = Settings().user_tiers
    reach = followers(b.tables.links, b.clock).select("fid", (F.col("followers") * 40).alias("followers"))
    measures = {"followers": F.col("followers"), "casts": F.col("followers"), "score": F.col("followers") * 3}
    return reach.select(
        "fid",
        scores.tier_label(rules, measures).alias("tier_name"),
        scores.tier_level(rules, measures).alias("tier"),
        F.lit(SPACER).alias("split_0"),
    )


# --- Joins ---


@registered
def reply_self_join(b):
    """Replies by others to live posts."""
    posts = live_rows(b.tables.casts, b.clock).select("hash")
    return replies_received(b.tables.casts, b.clock).join(posts, "hash", "left_semi")


@registered
def reply_parents(b):
    """Author of the post each live reply answers directly; NULL when that post is unknown."""
    replies = live_rows(b.tables.casts, b.clock).filter(F.col("parent_hash").isNotNull())
    per_parent = replies.groupBy("parent_hash", "fid").agg(F.count("*").alias("n"))
    pairs = trending.reply_targets(per_parent, b.tables.casts)
    return pairs.groupBy("fid", "target_fid").agg(F.sum("n").alias("replies"))


@registered
def anti_stopwords(b):
    return whole_words(b).groupBy("word").agg(F.count("*").alias("n"))


@registered
def semi_active(b):
    authors = words.active_authors(b.stored_users)
    posts = live_rows(b.tables.casts, b.clock).select("hash", "fid")
    kept = dimension_join(posts, authors, "fid", "left_semi", spread_by=["hash"])
    return kept.groupBy("fid").agg(F.count("*").alias("casts"))


@registered
def scalar_lookup(b):
    return trending.fid_of_name(b.tables.profiles, TRACKED)


@registered
def explode_words(b):
    """Every space-separated piece of every post, posts without text included."""
    pieces = b.tables.casts.select("fid", F.explode_outer(text.pieces(F.col("text"))).alias("piece"))
    return pieces.groupBy("fid").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("characters"))


@registered
def binary_key_join(b):
    book = address_book(b.tables.fids, b.tables.verifications)
    wallets = b.tables.wallet_activity.select(F.col("wallet").alias("address"), "txs")
    return book.join(wallets, "address")


# --- Aggregations ---


@registered
def cond_count(b):
    return followers(b.tables.links, b.clock)


@registered
def cond_sum_null(b):
    """ELSE 0 against no ELSE: the second is NULL where nothing matched."""
    return b.engaged.groupBy("fid").agg(
        scores.sum_where(F.col("this_week"), F.col("likes")).alias("likes_or_zero"),
        scores.sum_only_where(F.col("this_week"), F.col("likes")).alias("likes_or_null"),
    )


@registered
def sum_of_expression(b):
    return b.tables.wallet_activity.groupBy("contracts_deployed").agg(F.sum(volume()).alias("volume_usd"))


@registered
def cond_distinct(b):
    """Distinct authors per channel and week."""
    authors = channels.caster_activity(channels.cast_engagement(b.engaged))
    return authors.groupBy("parent_url").agg(
        F.count("*").alias("casters_14d"),
        scores.count_where(F.col("active") > 0).alias("casters"),
        scores.count_where(F.col("active_last") > 0).alias("casters_last"),
    )


@registered
def approx_distinct(b):
    """Exact posts, replies and authors per channel, and whether sketches are within three standard errors."""
    posts = channels.cast_engagement(b.engaged)
    names = [name + suffix for name in ("rolling_casts", "rolling_replies", "casters") for suffix in ("", "_last")]
    exact = channels.channel_cast_stats(channels.caster_summary(channels.caster_activity(posts), b.stored_users))
    sketch = channels.sketched_counts(posts).select("parent_url", *[F.col(n).alias(n + "_sketch") for n in names])
    summary = channels.caster_summary(channels.caster_activity(posts), b.stored_users)
    by_setting = channels.channel_cast_stats(summary, Settings(approx_casters=True)).select("parent_url", F.col("casters").alias("casters_setting"))

    def close(name: str, estimate: str) -> Column:
        allowed = F.greatest(F.lit(1.0), F.col(name) * 3 * Settings().sketch_error)
        return F.abs(F.col(estimate) - F.col(name)) <= allowed

    all_close = close("casters", "casters_setting")
    for name in names:
        all_close = all_close & close(name, name + "_sketch")
    return exact.join(sketch, "parent_url").join(by_setting, "parent_url").select("parent_url", *names, all_close.alias("sketches_hold"))


@registered
def cond_max(b):
    return b.engaged.groupBy("fid").agg(
        scores.max_where(F.col("this_week"), F.col("likes")).alias("most_likes"),
        scores.max_where(F.col("last_week"), F.col("likes")).alias("most_likes_last"),
    )


@registered
def avg_filter(b):
    active = F.col("total_transactions") > 0
    return b.stored_users.groupBy("fid_active_tier").agg(
        scores.avg_where(active, F.col("total_transactions")).alias("avg_txs"),
        scores.avg_where(active, F.col("trading_volume_usd")).alias("avg_volume_usd"),
    )


@registered
def ordered_list_filter(b):
    """Named channels of each author by posts; NULL for an author without any."""
    per_channel = users.user_channel_activity(b.engaged, SAMPLE_SETTINGS)
    names = ordered_list([-F.col("casts")], F.col("parent_url"), F.col("parent_url").isNotNull())
    return per_channel.groupBy("fid").agg(names.alias("urls"))


@registered
def distinct_members(b):
    """From a bridge stored ten days before and the days since."""
    before = Clock(b.clock.as_of - timedelta(days=10))
    known = b.keep(channels.channel_members(b.tables.casts, before), "members_before")
    members = channels.extend_members(known, b.tables.casts, b.clock, before)
    return distinct_list(members, "parent_url", "fid", "all_caster_fids")


# --- Brought forward from an earlier day ---

STEP_DAYS = 10

# The table that each state reads.
STATE_TABLES = {"posts": "casts", "reply_days": "casts", "member_days": "casts", "reaction_days": "reactions", "follow_totals": "links"}


def in_steps(b: MartBook, *states: str) -> DailyState:
    """The named states as of ten days before, then as of now from the days since and the deletions in between."""
    spark = b.tables.casts.sparkSession
    store = StateStore(spark, f"{shared_folder(spark)}/states-{uuid.uuid4().hex}")
    before = Clock(b.clock.as_of - timedelta(days=STEP_DAYS))
    old = DailyState(b.tables, before, store)
    for name in states:
        getattr(old, name)
    read = dict.fromkeys(STATE_TABLES[name] for name in states)
    b.tables.derive(*read)
    logs = {name: deletions_between(getattr(b.tables, name), b.clock, before) for name in read}
    return DailyState(b.tables, b.clock, store, Changes(**logs))


@registered
def followers_in_steps(b):
    return in_steps(b, "follow_totals").followers()


@registered
def members_in_steps(b):
    return distinct_list(in_steps(b, "member_days").channel_members(), "parent_url", "fid", "all_caster_fids")


@registered
def engagement_in_steps(b):
    engaged = in_steps(b, "posts", "reaction_days", "reply_days").engaged_casts()
    return channels.cast_engagement(engaged).select("hash", "parent_url", "fid", "is_root", "likes", "recasts", "replies")


@registered
def users_mart_in_steps(b):
    daily = in_steps(b, "posts", "reaction_days", "reply_days", "follow_totals")
    return MartBook(b.tables, b.clock, SAMPLE_SETTINGS, b.keep, daily).users()


@registered
def channels_mart_in_steps(b):
    daily = in_steps(b, "posts", "reaction_days", "reply_days", "member_days")
    engaged, linked = daily.engaged_casts(), daily.linked_posts()
    return channels.channels_mart(
        b.tables, b.clock, b.stored_users, SAMPLE_SETTINGS, engaged, linked, daily.channel_members(), keep=b.keep
    )


@registered
def approx_distinct_by_day(b):
    """Exact posts, replies and authors per channel, and whether unions of the days' sketches are within three standard errors."""
    names = [name + suffix for name in ("rolling_casts", "rolling_replies", "casters") for suffix in ("", "_last")]
    summary = channels.caster_summary(channels.caster_activity(channels.cast_engagement(b.engaged)), b.stored_users)
    exact = channels.channel_cast_stats(summary).select("parent_url", *names)
    weeks = sketched_weeks(in_steps(b, "posts").sketches(), b.clock)
    joined = exact.join(weeks.select("parent_url", *[F.col(n).alias(n + "_sketch") for n in names]), "parent_url")
    hold = F.lit(True)
    for name in names:
        hold = hold & (F.abs(F.col(name + "_sketch") - F.col(name)) <= F.greatest(F.lit(1.0), F.col(name) * 3 * Settings().sketch_error))
    return joined.select("parent_url", *names, hold.alias("sketches_hold"))


@registered
def list_keep_nulls(b):
    book = address_book(b.tables.fids, b.tables.verifications)
    return book.groupBy("fid").agg(ordered_list([], F.col("address")).alias("addresses"))


@registered
def distinct_rows(b):
    return users.profile_rows(b.tables.profiles)


@registered
def topk_group(b):
    """Three most reacted posts of each author."""
    order = [F.desc_nulls_last("likes"), F.asc("hash")]
    return top_k_list(b.engaged, ["fid"], order, "hash", 3, "top_posts")


# --- Sorting, limits, set operations ---


@registered
def dynamic_sort(b):
    filters = UserFilters(max_age_days=10_000, sort_by="got_replies")
    return b.trending_users(filters).select("fid", "got_replies")


@registered
def limited_view(b):
    """The first rows only, of more."""
    return trending.trending_users(b.stored_users, b.tables, b.clock, UserFilters(max_age_days=10_000), limit=25).select("fid", "followers")


@registered
def union_tags(b):
    tables = {"cast": b.tables.casts, "follow": b.tables.links, "react": b.tables.reactions}
    return trending.tagged({
        action: live_rows(df, b.clock).groupBy("fid").agg(F.count("*").alias("n")) for action, df in tables.items()
    })


# --- Scalar functions ---


@registered
def link_domain(b):
    return b.tables.casts.select("hash", links.link_domain(F.col("text")).alias("domain"))


def page_link_domain(spark, sf_dir):
    """First https link of whole web pages."""
    pages = source(spark, sf_dir, "pages")
    return flat(pages.select("page_id", links.link_domain(F.col("html")).alias("domain")))


QUERIES["page_link_domain"] = page_link_domain


def slug(spark, sf_dir):
    pages = source(spark, sf_dir, "pages")
    return flat(pages.select("page_id", links.url_slug(F.col("url")).alias("slug")))


QUERIES["slug"] = slug


@registered
def channel_slug(b):
    seen = b.members.select("parent_url").distinct()
    named = seen.join(b.tables.early_channels, "parent_url", "left")
    return named.select("parent_url", links.channel_name(F.col("channel_id"), F.col("parent_url")).alias("name"))


def href(spark, sf_dir):
    pages = source(spark, sf_dir, "pages")
    return flat(pages.select("page_id", links.anchor(F.col("url"), links.url_slug(F.col("url"))).alias("link")))


QUERIES["href"] = href


@registered
def account_age(b):
    """Whole days, next to calendar days."""
    registered_at = b.tables.fids
    now = b.clock.instant(registered_at, "created_at")
    return registered_at.select(
        "fid",
        F.timestamp_diff("DAY", F.col("created_at"), now).alias("whole_days"),
        F.datediff(F.to_date(now), F.to_date("created_at")).cast("long").alias("calendar_days"),
    )


@registered
def hex_address(b):
    """Claims read as addresses; broken ones are NULL."""
    claim = F.col("claim")
    return b.tables.verifications.select(
        "fid", F.get_json_object(claim, "$.address").alias("as_text"), chain.claim_address(claim).alias("address")
    )


def clean_documents(spark, sf_dir):
    """Whole documents without links, punctuation, addresses and tags: text digest and words."""
    documents = source(spark, sf_dir, "documents")
    cleaned = text.clean_text(F.col("text"))
    return flat(
        documents.select(
            "doc_id",
            F.md5(cleaned).alias("digest"),
            F.length(cleaned).cast("long").alias("characters"),
            F.array_size(text.words_of(F.col("text"))).cast("long").alias("words"),
        )
    )


QUERIES["clean_documents"] = clean_documents


def document_words(spark, sf_dir):
    """Telling words of whole documents with the number of documents that use them."""
    documents = source(spark, sf_dir, "documents")
    tokens = documents.select("doc_id", F.explode(text.words_of(F.col("text"))).alias("word"))
    telling = tokens.filter(text.is_telling(F.col("word"), Settings().common_words))
    per_document = telling.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return flat(per_document.groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("uses")))


QUERIES["document_words"] = document_words


@registered
def array_ops(b):
    held = chain.holdings(F.col("erc20_addresses"), F.col("nft_addresses"))
    token = chain.address_bytes(F.lit(TOKEN))
    return b.tables.wallet_activity.select(
        "wallet",
        F.array_size(held).cast("long").alias("holdings"),
        F.slice(held, 1, 1).alias("first_holding"),
        chain.holds_token(F.col("erc20_addresses"), F.col("nft_addresses"), token).alias("holds"),
        F.exists(held, lambda a: F.hex(a).endswith("2")).alias("any_ends_in_2"),
        F.filter(held, lambda a: F.hex(a).endswith("1")).alias("ending_in_1"),
    )


# --- Users ---


@registered
def reaction_rollup(b):
    return reactions_received(b.tables.reactions, b.clock)


@registered
def user_channel_activity(b):
    return users.user_channel_activity(b.engaged, SAMPLE_SETTINGS)


@registered
def user_channel_activity_corrected(b):
    """Each reaction counted once."""
    return users.user_channel_activity(b.engaged, Settings(repeat_likes=False))


@registered
def user_activity(b):
    per_channel = users.user_channel_activity(b.engaged, SAMPLE_SETTINGS)
    return users.user_activity(per_channel, b.tables.early_channels)


@registered
def domains_by_user(b):
    return top_domains(linked_posts(b.tables.casts, b.clock), F.col("fid"), "fid", IGNORED_DOMAINS)


@registered
def address_books(b):
    book = address_book(b.tables.fids, b.tables.verifications)
    return book.groupBy("fid", "address").agg(F.count("*").alias("n"))


@registered
def wallet_stats(b):
    return wallet_totals(b.addresses, b.tables.wallet_activity)


@registered
def users_mart(b):
    """The whole mart from its input tables; only the parsed addresses are stored in between."""
    return users.users_mart(b.tables, b.clock, SAMPLE_SETTINGS, addresses=b.addresses)


@registered
def users_mart_published_tiers(b):
    """The mart with its published thresholds."""
    mart = users.users_mart(b.tables, b.clock, engaged=b.engaged, linked=b.linked, addresses=b.addresses)
    return mart.select("fid", "fid_active_tier_name", "fid_active_tier", "fid_active_tier_last", "followers", "engagement")


@registered
def users_by_tier(b):
    return b.users_by_tier()


# --- Channels ---


@registered
def cast_engagement(b):
    return channels.cast_engagement(b.engaged).select("hash", "parent_url", "fid", "is_root", "likes", "recasts", "replies")


@registered
def caster_summary(b):
    activity = channels.caster_activity(channels.cast_engagement(b.engaged))
    return channels.caster_summary(activity, b.stored_users).select(
        "parent_url", "fid", "fname", "fid_active_tier", "total_transactions",
        F.col("active").alias("active_this_week"), F.col("active_last").alias("active_last_week"),
        "engagement", "engagement_last", "casts_in_channel",
    )


def summary_of(b: MartBook) -> DataFrame:
    return channels.caster_summary(channels.caster_activity(channels.cast_engagement(b.engaged)), b.stored_users)


@registered
def channel_cast_stats(b):
    counts = [name + suffix for name in channels.TIER_COUNTS for suffix in ("", "_last")]
    stats = channels.channel_cast_stats(summary_of(b))
    return stats.select(
        "parent_url", *counts, "engagement", "engagement_last", "avg_txs", "avg_volume_usd", "avg_contracts_deployed"
    )


@registered
def channel_top_casters(b):
    summary = summary_of(b)
    return channels.top_casters(summary).join(channels.influential_casters(summary), "parent_url", "left")


@registered
def channel_history(b):
    """Age and every caster since the first post, rolling counts of both weeks."""
    stats = channels.channel_cast_stats(summary_of(b))
    rolling = [name + suffix for name in (*channels.ROLLING, "casters") for suffix in ("", "_last")]
    return (
        channels.channel_ages(b.members, b.clock)
        .join(distinct_list(b.members, "parent_url", "fid", "all_caster_fids"), "parent_url", "left")
        .join(stats.select("parent_url", *rolling), "parent_url", "left")
    )


@registered
def domains_by_channel(b):
    return channels.channel_domains(linked_posts(b.tables.casts, b.clock))


@registered
def channels_mart(b):
    """The whole mart from its input tables and the stored users mart."""
    return channels.channels_mart(b.tables, b.clock, b.stored_users, SAMPLE_SETTINGS, keep=b.keep)


@registered
def channels_mart_published_tiers(b):
    mart = channels.channels_mart(
        b.tables, b.clock, b.stored_users, engaged=b.engaged, linked=b.linked, members=b.members, keep=b.keep,
        member_lists=False,
    )
    return mart.select("parent_url", "channel_tier_name", "channel_tier", "channel_tier_last", "engagement")


@registered
def channels_by_tier(b):
    return b.channels_by_tier()


# --- Words ---


@registered
def term_frequency(b):
    return words.term_frequency(whole_words(b))


@registered
def document_frequency(b):
    return words.document_frequency(words.term_frequency(whole_words(b)))


@registered
def total_docs(b):
    return words.total_documents(words.term_frequency(whole_words(b)))


@registered
def inverse_document_frequency(b):
    terms = words.term_frequency(whole_words(b))
    frequencies = words.document_frequency(terms)
    return words.inverse_document_frequency(frequencies, words.total_documents(terms)).drop("tf")


@registered
def weekly_tfidf(b):
    terms = words.term_frequency(whole_words(b))
    frequencies = words.document_frequency(terms)
    return words.weekly_tfidf(words.inverse_document_frequency(frequencies, words.total_documents(terms)))


@registered
def trending_words(b):
    return b.trending_words()


@registered
def trending_words_in_channel(b):
    return b.trending_words(channel=TOPIC)


# --- Filtered views ---


@registered
def interaction_targets(b):
    return trending.interaction_targets(b.tables, b.clock, TRACKED)


@registered
def holders_of_token(b):
    return token_holders(b.addresses, b.tables.wallet_activity, TOKEN)


@registered
def trending_users(b):
    return b.trending_users(UserFilters(max_age_days=45, channel=TOPIC, sort_by="engagement"))


@registered
def trending_users_tracked(b):
    return b.trending_users(UserFilters(max_age_days=10_000, tracked_user=TRACKED, action="reply", sort_by="casts"))


@registered
def trending_users_tracked_holding(b):
    return b.trending_users(UserFilters(max_age_days=10_000, tracked_user=TRACKED, held_token=TOKEN))


@registered
def trending_channels(b):
    return b.trending_channels(ChannelFilters(max_age_days=29, sort_by="rolling_7_casts"))


@registered
def trending_channels_of_user(b):
    return b.trending_channels(ChannelFilters(max_age_days=10_000, username=TRACKED.upper()))


@registered
def trending_channels_holding(b):
    return b.trending_channels(ChannelFilters(max_age_days=10_000, held_token=RARE))


@registered
def trending_channels_holding_by_ranges(b):
    book = MartBook(b.tables, b.clock, SAMPLE_SETTINGS, b.keep, bitmaps=True)
    return book.trending_channels(ChannelFilters(max_age_days=10_000, held_token=RARE))


# --- Stored and reused ---


@registered
def users_mart_bucketed(b):
    return MartBook(b.tables, b.clock, SAMPLE_SETTINGS, b.keep, bucketed=True).users()


@registered
def users_mart_reused(b):
    """Found by a second book, which computes nothing."""
    spark = b.tables.casts.sparkSession
    catalogue = Catalogue(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    versions = {name: "as given" for name in b.tables.names()}

    def book() -> MartBook:
        return MartBook(b.tables, b.clock, SAMPLE_SETTINGS, catalogue=catalogue, versions=versions)

    book().users()
    return book().users()
