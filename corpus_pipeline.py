"""From raw documents to a clean, encoded corpus: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's documents. All but the last return the columns of documents.

1. ``quality``: documents that the classifier rejects (score below 0.3) go.
2. ``exact_dedup``: of texts that are equal but for white space, the longest stays.
3. ``near_dedup``: of each component of near-duplicate fingerprints, the smallest id stays.
4. ``decontaminate``: documents of whose words one in twenty is inside a benchmark window go.
5. ``encode``: ids and decoded text of every document that is left, with its other columns.

Rows with null ids or texts, repeated rows and extra columns pass as the operators define it; an
empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockmetrics.llm import bpe, decontaminate, exact, package, quality, simhash
from flockmetrics.llm.queries import QUALITY_THRESHOLD, quality_model
from flockmetrics.llm.texts import spare
from flockmetrics.sources.stored import store


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = spare("score")
    scored = quality.with_score(docs, quality_model(spark, sf_dir), score)
    return scored.filter(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimal, joined by spaces) and decoded text."""
    codes = spare("codes")
    coded = bpe.with_codes(docs, public_tokenizers.path("word_bpe_49k.json"), codes)
    return coded.select("doc_id", "lang", "source", f"{codes}.n_tokens", f"{codes}.ids", f"{codes}.decoded")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encoded),
]

#: The classifier and the encoder are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    package.send(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
