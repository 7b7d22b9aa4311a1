"""Registered queries of the operators, each over whole tables, and their SQL for DuckDB where it can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockmetrics.llm import bpe, decontaminate, exact, langid, neighbours, package, pii, quality, repeats, runs, secrets, simhash, spelling, token_counts
from flockmetrics.llm.texts import fold
from flockmetrics.operators.joins import fits_broadcast
from flockmetrics.sources.stored import shared_folder, store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _base_digest(spans: str, base: tuple[str, ...]) -> Column:
    return _sha256(pii.as_text(F.filter(spans, lambda s: s["kind"].isin(*base)))).alias("base_sha256")


def _counts(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    found = F.transform(spans, lambda s: s["kind"])
    return [F.size(F.filter(found, F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in kinds]


#: Of the crc32 folds, the one whose labels are never learnt.
QUALITY_FOLDS, QUALITY_HELD_OUT, QUALITY_THRESHOLD = 5, 0, 0.3
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    docs, labels = (_read(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality.learn(docs, labels.filter(fold("doc_id", QUALITY_FOLDS) != QUALITY_HELD_OUT))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_score(docs, quality_model(spark, sf_dir)).select(
        "doc_id",
        (fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_codes(docs, public_tokenizers.path("word_bpe_49k.json"), "codes", digests=True).select(
        "doc_id", "codes.n_tokens", F.col("codes.ids").alias("ids_sha256"), F.col("codes.decoded").alias("decoded_sha256")
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_counts("spans", pii.BASE), _base_digest("spans", pii.BASE), pii.as_text(F.col("spans")).alias("spans"))


def change_feed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Every document arrives; then those labelled poor are cleaned of signs and those labelled toxic are taken down.

    In the feed ``doc_id`` is the place of the row, its file's number and its index there, as the
    ids of the table may be null or repeat and every row is a document.
    """
    docs = _read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", "lang", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    # A short list: one row for each file.
    paths = sorted(r._file for r in docs.select("_file").distinct().collect())
    files = F.broadcast(spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "_file string, _number long"))
    place = F.shiftleft("_number", 40).bitwiseOR(F.col("_index")).alias("_place")
    docs = docs.join(files, "_file").select("doc_id", "source", "lang", "text", place)
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    poor = store(labels.filter("quality = 0").select("doc_id"), "poor")
    poor = F.broadcast(poor) if fits_broadcast(poor) else poor
    cleaned = docs.join(poor, "doc_id", "left_semi").withColumn("text", F.translate("text", "!#$%&*|", ""))
    toxic = store(labels.filter("toxic = 1").select("doc_id"), "toxic")
    toxic = F.broadcast(toxic) if fits_broadcast(toxic) else toxic
    gone = docs.select("doc_id", "_place").join(toxic, "doc_id", "left_semi").select(
        "_place", F.lit("delete").alias("op"), F.lit(2).alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]
    )
    revised = cleaned.drop("doc_id").select("*", F.lit("upsert").alias("op"), F.lit(1).alias("seq")).unionByName(gone)
    arrivals = docs.drop("doc_id").select("*", F.lit("upsert").alias("op"), F.lit(0).alias("seq"))
    return [feed.withColumnRenamed("_place", "doc_id") for feed in (arrivals, revised)]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {"words": token_counts.pattern_tokens(token_counts.WORDS), "pieces": token_counts.pattern_tokens(token_counts.PIECES)}
    rollups = token_counts.TokenRollups(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", versions)
    arrivals, revisions = change_feed(spark, sf_dir)
    rollups.commit(1, arrivals)
    rollups.commit(2, revisions)
    # A batch that is delivered twice counts once.
    rollups.commit(2, revisions)
    return rollups.totals()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_read(spark, sf_dir, "documents")).drop("n_chars")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", *_counts("spans", secrets.BASE), _base_digest("spans", secrets.BASE), pii.as_text(F.col("spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    model = langid.learn(docs.filter(~held_out))
    return langid.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, "result", digest=True).select(
        "doc_id", "result.n_bytes", "result.n_removed", "result.n_spans", F.col("result.kept").alias("kept_sha256")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_read(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.contamination(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", _sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated"
    )


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.with_runs(docs, name="r", digest=True, plant_by="doc_id").select(
        "doc_id", "r.n_runs", "r.start", "r.length", "r.period", "r.exponent_milli",
        F.col("r.runs_text").alias("runs_sha256"), F.col("r.collapsed").cast("string").alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The module reads this one's parameters.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_repeats": op8_repeats,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_neighbours": op11_neighbours,
    "op12_spelling": op12_spelling,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}

_WORDS = r"""list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '),
    lambda x: x <> '')"""

ORACLE: dict[str, str] = {
    "op4_token_counts": r"""
with l as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id),
d as (
  select source, lang, case when l.quality = 0 then translate(text, '!#$%&*|', '') else text end as text
  from documents left join l using (doc_id) where coalesce(l.toxic, 0) <> 1
),
t as (
  select source, lang, 'words' as version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from d
  union all
  select source, lang, 'pieces', len(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]+')) from d
)
select source, lang, version, count(*) as docs, sum(n)::bigint as tokens from t group by all
""",
    "op5_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
    regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g') as norm from documents
),
r as (select *, row_number() over (partition by norm order by n desc, doc_id) as nth from d)
select doc_id, first_value(doc_id) over (partition by norm order by nth) as keep_id,
  count(*) over (partition by norm) as group_size, nth = 1 as kept, sha256(norm) as text_sha256
from r
""",
    "op10_decontaminate": f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select item, least(len(w), 13) as n, unnest(range(0, len(w) - least(len(w), 13) + 1)) as pos0, w from i where len(w) > 0),
item_windows as (select distinct item, n, array_to_string(list_slice(w, pos0 + 1, pos0 + n), ' ') as window_text from iw),
sizes as (select distinct n from item_windows),
dw as (select rid, w, n, unnest(range(0, len(w) - n + 1)) as pos0 from d, sizes where len(w) >= n),
hits as (
  select rid, pos0, dw.n as n, item
  from dw join item_windows iw2 on iw2.n = dw.n and iw2.window_text = array_to_string(list_slice(w, pos0 + 1, pos0 + dw.n), ' ')
),
hit_words as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(pos0, pos0 + n)) as pos from hits) group by rid),
hit_items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (rid) left join hit_items using (rid)
""",
}


def _sent(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        package.send(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sent(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
