"""The registered queries again, as plain SQL for DuckDB, in the most literal form."""

from __future__ import annotations

from collections.abc import Mapping

from flockmetrics.settings import COMMON_WORDS, USER_TIERS, CHANNEL_TIERS, USER_TIERS_LAST
from workload.queries import RARE, TOKEN, TOPIC, TRACKED
from workload.sample_tables import SAMPLE_SETTINGS, STOPWORDS, duckdb_definitions

NOW = "timestamp '2024-01-31 00:00:00'"
WEEK_AGO = "timestamp '2024-01-24 00:00:00'"
TWO_WEEKS_AGO = "timestamp '2024-01-17 00:00:00'"
CHANNEL_PAGE = "https://warpcast.com/~/channel/"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def joined(expression: str) -> str:
    return f"array_to_string(list_transform({expression}, lambda e: coalesce(cast(e as varchar), '<null>')), '|')"


def joined_hex(expression: str) -> str:
    return f"array_to_string(list_transform({expression}, lambda e: coalesce(lower(hex(e)), '<null>')), '|')"


def rounded(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def ladder(rules, measures: Mapping[str, str], what: str) -> str:
    """CASE over the rungs; ``what`` is 'level' or 'label'."""
    arms = []
    for rule in rules:
        value = str(rule.level) if what == "level" else quoted(rule.label)
        test = " and ".join(f"{measures[name]} >= {least}" for name, least in rule.at_least.items())
        arms.append(f"when {test} then {value}" if test else f"else {value}")
    return f"(case {' '.join(arms)} end)"


def host(text: str) -> str:
    link = f"nullif(regexp_extract({text}, 'https://\\S*'), '')"
    return f"replace(string_split({link}, '/')[3], 'www.', '')"


def cleaned(text: str) -> str:
    for pattern in (r"https://\S*", r"[[:punct:]\pP]", "0x[a-fA-F0-9]{40}", "<[^>]+>"):
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return text


def trimmed(word: str) -> str:
    white = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]
    return f"lower(trim({word}, {' || '.join(f'chr({c})' for c in white)}))"


def is_int(word: str) -> str:
    return f"(regexp_full_match({word}, '[0-9]+') and coalesce(try_cast({word} as bigint) <= 2147483647, false))"


def telling(word: str) -> str:
    common = ", ".join(map(quoted, COMMON_WORDS))
    return f"length({word}) > 2 and {word} not in ({common}) and not {is_int(word)}"


VIEWS: dict[str, str] = dict(duckdb_definitions())

VIEWS["stopwords"] = "select unnest([" + ", ".join(map(quoted, STOPWORDS)) + "]) as stopwords"

VIEWS["live"] = f"""
    select hash, fid, parent_hash, root_parent_hash, parent_url, root_parent_url, text, created_at,
      coalesce(parent_url, root_parent_url) as channel, coalesce(root_parent_url, parent_url) as thread_channel,
      created_at >= {WEEK_AGO} as w_now, created_at <= {WEEK_AGO} as w_old
    from casts where (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW}
"""

VIEWS["reacted"] = f"""
    select target_hash, count(*) filter (reaction_type = 1) as likes, count(*) filter (reaction_type = 2) as recasts
    from reactions
    where (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW} and fid <> target_fid
    group by target_hash
"""

# One row per post and reply, as a plain join gives it.
VIEWS["post_reply"] = """
    select p.*, r.likes, r.recasts, a.hash as reply
    from live p left join reacted r on r.target_hash = p.hash
    left join live a on a.root_parent_hash = p.hash and a.fid <> p.fid
"""

VIEWS["post"] = """
    select hash, fid, parent_hash, root_parent_hash, parent_url, root_parent_url, channel, thread_channel, w_now, w_old,
      likes, recasts, count(distinct reply) as replies
    from post_reply group by all
"""


def weekly(suffix: str, week: str) -> str:
    return f"""
      count(distinct case when {week} then hash end) as casts{suffix},
      count(distinct case when {week} then reply end) as got_replies{suffix},
      sum(case when {week} then likes else 0 end)::bigint as got_likes{suffix},
      sum(case when {week} then recasts else 0 end)::bigint as got_recasts{suffix}"""


VIEWS["per_channel"] = f"""
    select fid, channel, {weekly('', 'w_now')}, {weekly('_last', 'w_old')}
    from post_reply group by fid, channel
"""

COUNTS = [f"{name}{suffix}" for suffix in ("", "_last") for name in ("casts", "got_replies", "got_likes", "got_recasts")]

VIEWS["activity"] = f"""
    select fid, {', '.join(f'sum({c})::bigint as {c}' for c in COUNTS)},
      list(name order by casts desc, name) filter (channel is not null) as all_channels
    from (
      select p.*, coalesce(e.channel_id, string_split(p.channel, '/')[6], p.channel) as name
      from per_channel p left join early_channels e on e.parent_url = p.channel
    ) group by fid
"""

VIEWS["followed"] = f"""
    select target_fid as fid, count(*) as followers, count(*) filter (created_at >= {WEEK_AGO}) as wow_followers
    from links where (deleted_at is null or deleted_at > {NOW}) and (created_at is null or created_at <= {NOW}) group by target_fid
"""

VIEWS["user_sites"] = f"""
    select fid, (list(domain order by n desc, domain))[1:3] as domains
    from (select fid, {host('text')} as domain, count(*) as n from live group by 1, 2)
    where domain not in ('warpcast.com', 'x.com', 'twitter.com') group by fid
"""

VIEWS["addresses"] = """
    select fid, custody_address as address from fids
    union all
    select fid, case when json_valid(claim) then unhex(substr(json_extract_string(claim, '$.address'), 3)) end
    from verifications
"""

VIEWS["wallets"] = """
    select fid, sum(txs)::bigint as txs, sum(nft_volume_usd + dex_volume_usd) as volume,
      sum(contracts_deployed)::bigint as contracts, list(address order by address nulls first) as addresses
    from addresses left join wallet_activity on wallet = address group by fid
"""


def user_measures(suffix: str, follower_count: str) -> dict[str, str]:
    score = f"(got_likes{suffix} + 5 * got_recasts{suffix} + 10 * got_replies{suffix})"
    return {"followers": follower_count, "casts": f"casts{suffix}", "score": score}


def users_view(tiers, tiers_last) -> str:
    now = user_measures("", "f.followers")
    last = user_measures("_last", "(f.followers - f.wow_followers)")
    engaged = "(got_likes{0} + 3 * got_recasts{0} + 10 * got_replies{0})"
    return f"""
    select {ladder(tiers, now, 'label')} as fid_active_tier_name, {ladder(tiers, now, 'level')} as fid_active_tier,
      {ladder(tiers_last, last, 'level')} as fid_active_tier_last, a.fid, p.fname,
      '<a href="https://warpcast.com/' || p.fname || '">' || p.fname || '</a>' as fname_link,
      date_sub('day', r.created_at, {NOW}) as account_age, len(all_channels) as channels,
      all_channels[1:3] as top_channels, s.domains[1:2] as top_domains,
      coalesce(f.followers, 0) as followers, coalesce(f.wow_followers, 0) as wow_followers,
      casts, casts - casts_last as wow_casts,
      {engaged.format('')} as engagement, {engaged.format('')} - {engaged.format('_last')} as wow_engage,
      coalesce(w.txs, 0) as total_transactions, coalesce(w.volume, 0) as trading_volume_usd,
      coalesce(w.contracts, 0) as contracts_deployed, '||' as split_0,
      got_likes, got_likes - got_likes_last as wow_likes, got_recasts, got_recasts - got_recasts_last as wow_recasts,
      got_replies, got_replies - got_replies_last as wow_replies, w.addresses, all_channels, s.domains as all_domains
    from activity a left join followed f using (fid) left join (select distinct fid, fname from profiles) p using (fid)
    left join (select * from fids where created_at is null or created_at <= {NOW}) r using (fid) left join wallets w using (fid) left join user_sites s using (fid)
    """


VIEWS["users"] = users_view(SAMPLE_SETTINGS.user_tiers, SAMPLE_SETTINGS.user_tiers_last)
VIEWS["published_users"] = users_view(USER_TIERS, USER_TIERS_LAST)

POINTS = "likes + 3 * recasts + 10 * replies"

VIEWS["casters"] = f"""
    select p.thread_channel, p.fid, u.fname, u.fid_active_tier, u.total_transactions, u.trading_volume_usd, u.contracts_deployed,
      count(*) filter (w_now) as active, count(*) filter (w_old) as active_last,
      sum(case when w_now then {POINTS} else 0 end)::bigint as engagement,
      sum(case when w_old then {POINTS} else 0 end)::bigint as engagement_last,
      count(*) filter (w_now and root_parent_hash is null) as roots
    from post p left join users u on u.fid = p.fid
    where p.thread_channel is not null group by 1, 2, 3, 4, 5, 6, 7
"""

TIER_NAMES = ("active_npc", "active_user", "active_star", "active_influencer", "active_vip")

VIEWS["stats"] = f"""
    select thread_channel,
      {', '.join(f"count(*) filter (active{s} > 0 and fid_active_tier = {i}) as {name}{s}"
                 for i, name in enumerate(TIER_NAMES) for s in ('', '_last'))},
      sum(engagement)::bigint as engagement, sum(engagement_last)::bigint as engagement_last,
      avg(total_transactions) filter (total_transactions > 0) as avg_txs,
      avg(trading_volume_usd) filter (total_transactions > 0) as avg_volume_usd,
      avg(contracts_deployed) filter (total_transactions > 0) as avg_contracts_deployed,
      (list(fname order by roots desc, fname nulls last, fid))[1:10] as top_casters,
      (list(fname order by fid_active_tier desc, roots desc, fname nulls last, fid) filter (fid_active_tier >= 3))[1:10]
        as influential_casters
    from casters group by thread_channel
"""

VIEWS["channel_sites"] = f"""
    select thread_channel, (list(domain order by n desc, domain))[1:3] as top_domains
    from (select thread_channel, {host('text')} as domain, count(*) as n from live
          where w_now and thread_channel is not null group by 1, 2)
    where domain not in ('warpcast.com', 'x.com', 'twitter.com') group by thread_channel
"""


def rolling(suffix: str, week: str) -> str:
    return f"""
      count(distinct hash) filter ({week} and parent_hash is null) as rolling_casts{suffix},
      count(distinct hash) filter ({week} and parent_hash is not null) as rolling_replies{suffix},
      (sum(likes) filter ({week}))::bigint as rolling_likes{suffix},
      (sum(recasts) filter ({week}))::bigint as rolling_recasts{suffix},
      count(distinct fid) filter ({week}) as casters{suffix}"""


VIEWS["history"] = f"""
    select coalesce(root_parent_url, parent_url) as parent_url,
      max(date_diff('day', date_trunc('day', created_at), date_trunc('day', {NOW}))) as channel_age,
      {rolling('', f'created_at >= {WEEK_AGO}')},
      {rolling('_last', f'created_at between {TWO_WEEKS_AGO} and {WEEK_AGO}')},
      list_sort(list(distinct fid)) as all_caster_fids
    from casts left join reacted on target_hash = hash
    where (deleted_at is null or deleted_at > {NOW}) and coalesce(parent_url, root_parent_url) is not null and (created_at is null or created_at <= {NOW})
    group by 1
"""


def channel_measures(suffix: str) -> dict[str, str]:
    return {
        "casts": f"rolling_casts{suffix}", "engagement": f"engagement{suffix}", "casters": f"casters{suffix}",
        "stars": f"active_star{suffix}", "leaders": f"(active_influencer{suffix} + active_vip{suffix})",
    }


def channels_view(tiers) -> str:
    now, last = channel_measures(""), channel_measures("_last")
    moves = {
        "active_npc": "wow_npc", "active_user": "wow_active_user", "active_star": "wow_star",
        "active_influencer": "wow_influencer", "active_vip": "wow_vip",
    }
    slug = "coalesce(e.channel_id, string_split(h.parent_url, '/')[6])"
    return f"""
    select h.parent_url, {ladder(tiers, now, 'label')} as channel_tier_name, {ladder(tiers, now, 'level')} as channel_tier,
      {ladder(tiers, last, 'level')} as channel_tier_last,
      '<a href="' || coalesce('{CHANNEL_PAGE}' || {slug}, h.parent_url) || '">' || coalesce({slug}, h.parent_url) || '</a>' as channel,
      channel_age, influential_casters[1:3] as influential_casters,
      rolling_casts as rolling_7_casts, rolling_casts - rolling_casts_last as wow_cast,
      engagement, engagement - engagement_last as wow_engage, '||' as split_1,
      {', '.join(f'{c}, {c} - {c}_last as {w}' for c, w in moves.items())}, '||' as split_0,
      rolling_replies as rolling_7_replies, rolling_replies - rolling_replies_last as wow_reply,
      rolling_likes as rolling_7_likes, rolling_likes - rolling_likes_last as wow_likes,
      rolling_recasts as rolling_7_recasts, rolling_recasts - rolling_recasts_last as wow_recasts, '||' as split_2,
      avg_txs, avg_volume_usd, avg_contracts_deployed, top_domains, top_casters[1:3] as top_casters, all_caster_fids
    from history h left join stats t on t.thread_channel = h.parent_url
    left join channel_sites d on d.thread_channel = h.parent_url left join early_channels e on e.parent_url = h.parent_url
    """


VIEWS["channels"] = channels_view(SAMPLE_SETTINGS.channel_tiers)
VIEWS["published_channels"] = channels_view(CHANNEL_TIERS)


def words_view(posts: str) -> str:
    return f"""
    select w_now::int as this_week, fid, word from (
      select w_now, fid, {trimmed('piece')} as word
      from (select w_now, fid, unnest(string_split({cleaned('text')}, ' ')) as piece from {posts})
    )
    where {telling('word')}
      and word not in (select regexp_replace(stopwords, '[[:punct:]\\pP]', '', 'g') from stopwords)
    """


VIEWS["all_words"] = words_view("live")
ACTIVE = "channel is not null and fid in (select fid from users where fid_active_tier >= 1)"
VIEWS["active_posts"] = f"select * from live where {ACTIVE}"
VIEWS["topic_posts"] = f"select * from active_posts where lower(parent_url) like '%{TOPIC.lower()}%'"
VIEWS["active_words"] = words_view("active_posts")
VIEWS["topic_words"] = words_view("topic_posts")


def idf_of(words: str) -> str:
    return f"""
    select d.this_week, word, df, total_docs, log10(total_docs::double / df) as idf
    from (select this_week, word, count(distinct fid) as df from {words} group by 1, 2) d
    join (select this_week, count(distinct fid) as total_docs from {words} group by 1) t using (this_week)
    """


def tfidf_of(words: str) -> str:
    """One row per word from one row per week, author and word."""
    parts = []
    for week, suffix in ((1, ""), (0, "_last")):
        parts.append(f"""
          max(idf) filter (this_week = {week}) as idf{suffix},
          coalesce(sum(tf) filter (this_week = {week}), 0)::bigint as tf{suffix},
          coalesce(sum(tf * idf) filter (this_week = {week}), 0) as tfidf{suffix},
          count(distinct fid) filter (this_week = {week}) as casters{suffix}""")
    return f"""
    select word, {', '.join(parts)}
    from (select this_week, fid, word, count(*) as tf from {words} group by all)
    join ({idf_of(words)}) using (this_week, word) group by word
    """


def trending_of(words: str) -> str:
    return f"""
    select row_number() over (order by casters desc, word) as ranking, word,
      casters, casters - casters_last as casters_wow, tf, tf - tf_last as tf_wow,
      {rounded('idf')} as idf, {rounded('idf - coalesce(idf_last, 0)')} as idf_wow,
      {rounded('tfidf')} as tfidf, {rounded('tfidf - tfidf_last')} as tfidf_wow
    from ({tfidf_of(words)}) where casters >= 10 order by casters desc, word limit 1000
    """


VIEWS["person"] = f"select min(fid) as fid from profiles where fname = '{TRACKED}'"

VIEWS["targets"] = f"""
    select distinct a.fid, p.fid as target_fid, 'reply' as action
    from live a left join casts p on p.hash = a.parent_hash where a.fid = (select fid from person)
    union all
    select distinct fid, target_fid, 'follow' from links
    where fid = (select fid from person) and (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW}
    union all
    select distinct fid, target_fid, 'react' from reactions
    where fid = (select fid from person) and (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW}
"""


def holders(token: str) -> str:
    digits = token.removeprefix("0x")
    return f"""select distinct fid from addresses join wallet_activity on wallet = address
      where list_contains(erc20_addresses || nft_addresses, unhex('{digits}'))"""


USER_LISTS = {name: joined(name) for name in ("top_channels", "top_domains", "all_channels", "all_domains")}
SHOWN_USERS = "* replace (" + ", ".join(
    f"{expression} as {name}"
    for name, expression in (
        USER_LISTS | {"addresses": joined_hex("addresses"), "trading_volume_usd": rounded("trading_volume_usd")}
    ).items()
) + ")"
CHANNEL_LISTS = ("influential_casters", "top_domains", "top_casters", "all_caster_fids")
MEANS = ("avg_txs", "avg_volume_usd", "avg_contracts_deployed")
SHOWN_CHANNELS = "* replace (" + ", ".join(
    [f"{joined(name)} as {name}" for name in CHANNEL_LISTS] + [f"{rounded(name)} as {name}" for name in MEANS]
) + ")"


def by_tier(mart: str, level: str, last: str, what: str) -> str:
    return f"""
    select {level}_name, {level}, {what}, {what} - coalesce(n, 0) as wow_{what}
    from (select {level}_name, {level}, count(*) as {what} from {mart} group by 1, 2)
    left join (select {last}, count(*) as n from {mart} group by 1) on {last} = {level}
    """


def repeats(table: str, key: str) -> str:
    return f"""select '{table}' as table_name, count(*) as repeated_keys, coalesce(sum(n), 0)::bigint as rows_with_repeated_key
      from (select count(*) as n from {table} group by {key} having count(*) > 1)"""


TABLES = (
    "casts", "reactions", "links", "fids", "verifications", "profiles", "early_channels", "wallet_activity", "stopwords",
)
KEYS = {"casts": "hash", "fids": "fid", "profiles": "fid", "early_channels": "parent_url", "wallet_activity": "wallet"}

BODIES: dict[str, str] = {
    "scan_tables": " union all ".join(f"select '{t}' as table_name, count(*) as rows_read from {t}" for t in TABLES),
    "src_csv_dim": "select p_brand, count(*) as parts, sum(p_size)::bigint as sizes from part group by 1",
    "src_csv_folder": """
        select p_partkey, 'say "' || p_name || '", ok' || chr(10) || 'and ' || chr(92) as note, p_brand, 1 as tables from part""",
    "stopwords_csv": "select word, count(*) as n from all_words group by 1",
    "approx_distinct": """
        select thread_channel as parent_url,
          count(distinct hash) filter (w_now and parent_hash is null) as rolling_casts,
          count(distinct hash) filter (w_old and parent_hash is null) as rolling_casts_last,
          count(distinct hash) filter (w_now and parent_hash is not null) as rolling_replies,
          count(distinct hash) filter (w_old and parent_hash is not null) as rolling_replies_last,
          count(distinct fid) filter (w_now) as casters, count(distinct fid) filter (w_old) as casters_last,
          true as sketches_hold
        from live where thread_channel is not null group by 1""",
    "key_duplicates": " union all ".join(repeats(t, k) for t, k in KEYS.items()),
    "preview_users": f"select {SHOWN_USERS} from (select * from users order by followers desc, fid, fname nulls last limit 20)",
    "preview_summary": """
        select 'count' as summary, count(followers)::varchar as followers, count(casts)::varchar as casts, 29 as columns from (select followers, casts from users order by followers desc, fid, fname nulls last limit 20)
        union all select 'min', min(followers)::varchar, min(casts)::varchar, 29 from (select followers, casts from users order by followers desc, fid, fname nulls last limit 20)
        union all select 'max', max(followers)::varchar, max(casts)::varchar, 29 from (select followers, casts from users order by followers desc, fid, fname nulls last limit 20)""",
    "soft_delete_window": """
        select fid, count(*) as casts_14d, nullif(count(*) filter (w_now), 0) as casts_7d from live group by fid""",
    "prev_week_between": f"""
        select fid, count(*) as casts_last from casts where created_at between {TWO_WEEKS_AGO} and {WEEK_AGO} group by fid""",
    "week_flag": "select w_now::int as this_week, count(*) as casts from live group by 1",
    "self_exclusion": "select reaction_type, count(*) as reactions from reactions where fid <> target_fid group by 1",
    "channel_keys": """
        select coalesce(parent_url, root_parent_url) as channel, coalesce(root_parent_url, parent_url) as thread_channel,
          count(*) as casts
        from casts where coalesce(parent_url, root_parent_url) is not null group by 1, 2""",
    "null_tests": """
        select parent_hash is null as is_top_level, root_parent_hash is null as is_root, count(*) as casts
        from casts group by 1, 2""",
    "not_in_list": f"""
        select domain, count(*) as casts from (select {host('text')} as domain from casts)
        where domain not in ('warpcast.com', 'x.com', 'twitter.com') group by 1""",
    "contains_ci": f"select parent_url, count(*) as casts from casts where parent_url ilike '%{TOPIC}%' group by 1",
    "optional_filter": """
        select fid_active_tier, count(*) as users
        from (select * from users where account_age <= 10000 order by followers desc, fid, fname nulls last limit 1000) group by 1""",
    "threshold_filter": """
        select fid, account_age, fid_active_tier from users where account_age <= 30 and fid_active_tier >= 1""",
    "numeric_and_short_tokens": f"""
        select {is_int('word')} as is_number, length(word) <= 2 as is_short, count(*) as tokens
        from (select {trimmed('piece')} as word from (select unnest(string_split({cleaned('text')}, ' ')) as piece from casts))
        group by 1, 2""",
    "tier_ladder": """
        select fid, {} as tier_name, {} as tier, '||' as split_0 from (select fid, followers * 40 as reach from followed)
        """.format(*(
        ladder(USER_TIERS, {"followers": "reach", "casts": "reach", "score": "reach * 3"}, what)
        for what in ("label", "level")
    )),
    "reply_self_join": """
        select p.hash, count(distinct a.hash) as replies from live a join live p on p.hash = a.root_parent_hash
        where a.fid <> p.fid group by 1""",
    "reply_parents": """
        select a.fid, p.fid as target_fid, count(*) as replies from live a left join casts p on p.hash = a.parent_hash
        where a.parent_hash is not null group by 1, 2""",
    "anti_stopwords": "select word, count(*) as n from all_words group by 1",
    "semi_active": """
        select fid, count(*) as casts from live where fid in (select fid from users where fid_active_tier >= 1) group by 1""",
    "scalar_lookup": "select fid from person",
    "explode_words": """
        select fid, count(*) as pieces, sum(length(piece))::bigint as characters
        from (select fid, unnest(string_split(text, ' ')) as piece from casts) group by 1""",
    "binary_key_join": """
        select lower(hex(address)) as address, fid, txs from addresses join wallet_activity on wallet = address""",
    "cond_count": "select * from followed",
    "cond_sum_null": """
        select fid, sum(case when w_now then likes else 0 end)::bigint as likes_or_zero,
          (sum(likes) filter (w_now))::bigint as likes_or_null
        from post group by fid""",
    "sum_of_expression": f"""
        select contracts_deployed, {rounded('sum(nft_volume_usd + dex_volume_usd)')} as volume_usd
        from wallet_activity group by 1""",
    "cond_distinct": """
        select thread_channel as parent_url, count(distinct fid) as casters_14d,
          count(distinct fid) filter (w_now) as casters, count(distinct fid) filter (w_old) as casters_last
        from live where thread_channel is not null group by 1""",
    "cond_max": """
        select fid, max(likes) filter (w_now) as most_likes, max(likes) filter (w_old) as most_likes_last
        from post group by fid""",
    "avg_filter": f"""
        select fid_active_tier, {rounded('avg(total_transactions) filter (total_transactions > 0)')} as avg_txs,
          {rounded('avg(trading_volume_usd) filter (total_transactions > 0)')} as avg_volume_usd
        from users group by 1""",
    "ordered_list_filter": f"""
        select fid, {joined('urls')} as urls
        from (select fid, list(channel order by casts desc, channel) filter (channel is not null) as urls
              from per_channel group by fid)""",
    "distinct_members": f"select parent_url, {joined('all_caster_fids')} as all_caster_fids from history",
    "list_keep_nulls": f"select fid, {joined_hex('addresses')} as addresses from wallets",
    "distinct_rows": "select distinct fid, fname from profiles",
    "topk_group": f"""
        select fid, {joined('top_posts')} as top_posts
        from (select fid, (list(hash order by likes desc nulls last, hash))[1:3] as top_posts from post group by fid)""",
    "limited_view": """
        select fid, followers from users where account_age <= 10000 order by followers desc, fid, fname nulls last limit 25""",
    "dynamic_sort": """
        select fid, got_replies from users where account_age <= 10000 order by got_replies desc, fid, fname nulls last limit 1000""",
    "union_tags": f"""
        select fid, count(*) as n, 'cast' as action from live group by fid
        union all
        select fid, count(*), 'follow' from links
        where (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW} group by fid
        union all
        select fid, count(*), 'react' from reactions
        where (deleted_at is null or deleted_at > {NOW}) and created_at between {TWO_WEEKS_AGO} and {NOW} group by fid""",
    "link_domain": f"select hash, {host('text')} as domain from casts",
    "page_link_domain": f"select page_id, {host('html')} as domain from pages",
    "slug": "select page_id, string_split(url, '/')[6] as slug from pages",
    "channel_slug": """
        select h.parent_url, coalesce(channel_id, string_split(h.parent_url, '/')[6], h.parent_url) as name
        from history h left join early_channels e on e.parent_url = h.parent_url""",
    "href": """
        select page_id, '<a href="' || url || '">' || string_split(url, '/')[6] || '</a>' as link from pages""",
    "account_age": f"""
        select fid, date_sub('day', created_at, {NOW}) as whole_days, date_diff('day', created_at, {NOW}) as calendar_days
        from fids""",
    "hex_address": """
        select fid, case when json_valid(claim) then json_extract_string(claim, '$.address') end as as_text,
          case when json_valid(claim) then lower(substr(json_extract_string(claim, '$.address'), 3)) end as address
        from verifications""",
    "clean_documents": f"""
        select doc_id, md5({cleaned('text')}) as digest, length({cleaned('text')}) as characters,
          len(string_split({cleaned('text')}, ' ')) as words
        from documents""",
    "document_words": f"""
        select word, count(distinct doc_id) as documents, count(*) as uses
        from (select doc_id, {trimmed('piece')} as word
              from (select doc_id, unnest(string_split({cleaned('text')}, ' ')) as piece from documents))
        where {telling('word')} group by word""",
    "array_ops": f"""
        select lower(hex(wallet)) as wallet, len(held) as holdings, {joined_hex('held[1:1]')} as first_holding,
          list_contains(held, unhex('{TOKEN.removeprefix('0x')}')) as holds,
          case when held is not null then len(list_filter(held, lambda a: hex(a) like '%2')) > 0 end as any_ends_in_2,
          {joined_hex("list_filter(held, lambda a: hex(a) like '%1')")} as ending_in_1
        from (select wallet, erc20_addresses || nft_addresses as held from wallet_activity)""",
    "reaction_rollup": "select target_hash as hash, likes, recasts from reacted",
    "user_channel_activity": f"select fid, channel as parent_url, {', '.join(COUNTS)} from per_channel",
    "user_channel_activity_corrected": """
        select fid, channel as parent_url, {} from post group by fid, channel""".format(", ".join(
        f"""count(*) filter ({week}) as casts{suffix},
          sum(case when {week} then replies else 0 end)::bigint as got_replies{suffix},
          sum(case when {week} then likes else 0 end)::bigint as got_likes{suffix},
          sum(case when {week} then recasts else 0 end)::bigint as got_recasts{suffix}"""
        for week, suffix in (("w_now", ""), ("w_old", "_last"))
    )),
    "user_activity": f"select fid, {', '.join(COUNTS)}, {joined('all_channels')} as all_channels from activity",
    "domains_by_user": f"select fid, {joined('domains')} as top_domains from user_sites",
    "address_books": "select fid, lower(hex(address)) as address, count(*) as n from addresses group by 1, 2",
    "wallet_stats": f"""
        select fid, txs as total_transactions, {rounded('volume')} as trading_volume_usd,
          contracts as contracts_deployed, {joined_hex('addresses')} as addresses
        from wallets""",
    "users_mart": f"select {SHOWN_USERS} from users",
    "users_mart_published_tiers": """
        select fid, fid_active_tier_name, fid_active_tier, fid_active_tier_last, followers, engagement from published_users""",
    "users_by_tier": by_tier("users", "fid_active_tier", "fid_active_tier_last", "users"),
    "result_by_name": by_tier("users", "fid_active_tier", "fid_active_tier_last", "users"),
    "cast_engagement": """
        select hash, thread_channel as parent_url, fid, root_parent_hash is null as is_root, likes, recasts, replies
        from post where thread_channel is not null""",
    "caster_summary": """
        select thread_channel as parent_url, fid, fname, fid_active_tier, total_transactions, active as active_this_week,
          active_last as active_last_week, engagement, engagement_last, roots as casts_in_channel
        from casters""",
    "channel_cast_stats": f"""
        select * exclude (thread_channel, top_casters, influential_casters)
          replace ({', '.join(f'{rounded(name)} as {name}' for name in MEANS)}), thread_channel as parent_url
        from stats""",
    "channel_top_casters": f"""
        select thread_channel as parent_url, {joined('top_casters')} as top_casters,
          {joined('influential_casters')} as influential_casters
        from stats""",
    "channel_history": """
        select h.* replace ({}, {}) from history h left join stats on thread_channel = parent_url""".format(
        joined("all_caster_fids") + " as all_caster_fids",
        # Counts of a channel without a live post are left open here; the mart turns them to 0.
        ", ".join(
            f"case when thread_channel is not null then {name}{suffix} end as {name}{suffix}"
            for name in ("rolling_casts", "rolling_replies", "casters") for suffix in ("", "_last")
        ),
    ),
    "domains_by_channel": f"select thread_channel as parent_url, {joined('top_domains')} as top_domains from channel_sites",
    "channels_mart": f"select {SHOWN_CHANNELS} from channels",
    "channels_mart_published_tiers": """
        select parent_url, channel_tier_name, channel_tier, channel_tier_last, engagement from published_channels""",
    "channels_by_tier": by_tier("channels", "channel_tier", "channel_tier_last", "channels"),
    "term_frequency": "select this_week, fid, word, count(*) as tf from all_words group by all",
    "document_frequency": """
        select this_week, word, count(distinct fid) as df, count(*) as tf from all_words group by 1, 2""",
    "total_docs": "select this_week, count(distinct fid) as total_docs from all_words group by 1",
    "inverse_document_frequency": f"select * replace ({rounded('idf')} as idf) from ({idf_of('all_words')})",
    "weekly_tfidf": "select * replace ({}) from ({})".format(
        ", ".join(f"{rounded(c)} as {c}" for c in ("idf", "idf_last", "tfidf", "tfidf_last")), tfidf_of("all_words")
    ),
    "trending_words": trending_of("active_words"),
    "trending_words_in_channel": trending_of("topic_words"),
    "interaction_targets": "select * from targets",
    "holders_of_token": holders(TOKEN),
    "trending_users": f"""
        select {SHOWN_USERS} from users
        where account_age <= 45 and len(list_filter(all_channels, lambda c: lower(c) like '%{TOPIC.lower()}%')) > 0
        order by engagement desc nulls last, fid, fname nulls last limit 1000""",
    "trending_users_tracked": f"""
        select {SHOWN_USERS} from users
        where account_age <= 10000 and fid in (select target_fid from targets where action = 'reply')
        order by casts desc, fid, fname nulls last limit 1000""",
    "trending_users_tracked_holding": f"""
        select {SHOWN_USERS} from users
        where account_age <= 10000 and fid in (select target_fid from targets) and fid in ({holders(TOKEN)})
        order by followers desc, fid, fname nulls last limit 1000""",
    "trending_channels": f"""
        select {SHOWN_CHANNELS} from channels where channel_age <= 29 order by rolling_7_casts desc, parent_url limit 1000""",
    "trending_channels_of_user": f"""
        select {SHOWN_CHANNELS} from channels
        where channel_age <= 10000 and list_contains(channels.all_caster_fids, (select fid from person))
        order by engagement desc nulls last, parent_url limit 1000""",
    "trending_channels_holding": f"""
        select {SHOWN_CHANNELS} from channels
        where channel_age <= 10000 and len(list_intersect(channels.all_caster_fids, (select list(fid) from ({holders(RARE)})))) > 0
        order by engagement desc nulls last, parent_url limit 1000""",
}


def needed(text: str) -> list[str]:
    """Views a text reads, directly or through other views, in the order they are defined."""
    found: set[str] = set()
    waiting = [text]
    while waiting:
        tokens = set(waiting.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in VIEWS.keys() & tokens - found:
            found.add(name)
            waiting.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


# Results that are brought forward from an earlier day, found again or reached another way are those of one step.
BODIES |= {
    stepped: BODIES[whole]
    for stepped, whole in {
        "followers_in_steps": "cond_count",
        "members_in_steps": "distinct_members",
        "engagement_in_steps": "cast_engagement",
        "users_mart_in_steps": "users_mart",
        "channels_mart_in_steps": "channels_mart",
        "approx_distinct_by_day": "approx_distinct",
        "trending_channels_holding_by_ranges": "trending_channels_holding",
        "users_mart_bucketed": "users_mart",
        "users_mart_reused": "users_mart",
    }.items()
}


def oracle_sql() -> dict[str, str]:
    texts = {}
    for name, body in BODIES.items():
        views = needed(body)
        prefix = "with " + ",\n".join(f"{view} as ({VIEWS[view].strip()})" for view in views) + "\n" if views else ""
        texts[name] = prefix + body.strip()
    return texts
