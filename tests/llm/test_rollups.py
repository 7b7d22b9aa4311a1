"""Totals against a recount after every batch; replays, deletions and half-written batches."""

import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flockmetrics.llm.token_counts import PIECES, WORDS, TokenRollups, pattern_tokens
from flockmetrics.sources.stored import shared_folder

SCHEMA = "doc_id long, op string, source string, lang string, text string, seq int"


@pytest.fixture
def rollups(spark):
    folder = f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}"
    return TokenRollups(spark, folder, {"words": pattern_tokens(WORDS), "pieces": pattern_tokens(PIECES)})


def totals(rollups):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollups.totals().collect()}


def plain(state):
    import re

    out = defaultdict(lambda: [0, 0])
    for source, lang, text in state.values():
        for version, n in (
            ("words", len(re.findall("[^\x20\x09-\x0d]+", text or ""))),
            ("pieces", len(re.findall("[A-Za-z\x80-\U0010ffff]+|[0-9]|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0d]+", text or ""))),
        ):
            out[source, lang, version][0] += 1
            out[source, lang, version][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_batches(spark, rollups):
    rnd, state = random.Random(3), {}
    for batch in range(1, 4):
        rows = []
        for seq in range(60):
            doc_id = rnd.choice([None, *range(25)])
            if rnd.random() < 0.3:
                rows.append((doc_id, "delete", None, None, None, seq))
                state.pop(doc_id, None)
            else:
                new = (rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([None, "", "x y 12!", "é, z " * rnd.randint(0, 9)]))
                rows.append((doc_id, "upsert", *new, seq))
                state[doc_id] = new
        changes = spark.createDataFrame(rows, SCHEMA)
        rollups.commit(batch, changes)
        assert totals(rollups) == plain(state)
        # Delivered again, it counts once.
        rollups.commit(batch, changes)
        assert totals(rollups) == plain(state)
    assert rollups.drift().count() == 0
    with pytest.raises(ValueError, match="batch 1"):
        rollups.commit(1, changes)
    rollups.commit(9, changes.limit(0))
    assert totals(rollups) == plain(state)


def test_a_batch_without_its_mark_is_not_seen(spark, rollups):
    rows = spark.createDataFrame([(1, "upsert", "s", "en", "one two", 0)], SCHEMA)
    rollups.commit(1, rows)
    before = totals(rollups)
    rows.select(F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("words").alias("version"),
                F.lit(5).cast("long").alias("docs"), F.lit(50).cast("long").alias("tokens")).write.parquet(f"{rollups.folder}/totals/batch=2")
    assert totals(rollups) == before and rollups.batches() == [1]
    rollups.commit(2, spark.createDataFrame([(1, "delete", None, None, None, 0), (5, "delete", None, None, None, 0)], SCHEMA))
    assert totals(rollups) == {}


def test_ties_in_a_batch(spark, rollups):
    rows = [(1, "upsert", "s", "en", "a b", 0), (1, "delete", None, None, None, 0), (2, "upsert", "s", "en", "a", 0), (2, "upsert", "s", "en", "a b", 0)]
    rollups.commit(1, spark.createDataFrame(rows, SCHEMA))
    assert totals(rollups)["s", "en", "words"] == (1, 2)
