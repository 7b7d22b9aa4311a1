"""Columns that have the names of the operators' own helpers pass through with their values."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flockmetrics.llm import exact, pii, quality, repeats, secrets, simhash

TOKENIZER = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
CLASHING = ("_id", "_sha", "_n", "_own_sha", "_own_n", "_mark", "_size", "_spans", "_keep_id", "_keep_mark", "_pii", "_secrets", "_quality", "_simhash")


@pytest.fixture(scope="module")
def clashing(spark, awkward):
    return awkward.select("doc_id", "text", *(F.concat(F.lit(name), F.xxhash64("text")).alias(name) for name in CLASHING))


def as_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["pii", "quality", "repeats", "secrets", "simhash"])
def test_added_column(spark, clashing, name):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {
        "pii": lambda: pii.with_spans(clashing, "found"),
        "quality": lambda: quality.with_score(clashing, quality.learn(clashing, no_labels), "found"),
        "repeats": lambda: repeats.without_repeats(clashing, "found"),
        "secrets": lambda: secrets.with_spans(clashing, *TOKENIZER, name="found"),
        "simhash": lambda: simhash.with_fingerprint(clashing, name="found"),
    }[name]()
    assert as_rows(found.drop("found")) == as_rows(clashing)


@pytest.mark.parametrize("stage", [exact.without_copies, simhash.without_near_copies])
def test_filter(clashing, stage):
    kept = stage(clashing)
    assert kept.columns == clashing.columns
    assert as_rows(kept.select("doc_id", "text")) == as_rows(stage(clashing.select("doc_id", "text")))
    assert set(as_rows(kept)) <= set(as_rows(clashing))


def test_many_digests_take_linear_time():
    find = secrets.finder(*TOKENIZER)
    text = " ".join(f"{i:064x}" for i in range(20_000))
    began = time.process_time()
    assert len(find(text)) == 20_000
    assert time.process_time() - began < 2
