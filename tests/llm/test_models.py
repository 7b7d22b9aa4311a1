"""Classifiers on held-out rows, and their defined results."""

import random

import numpy as np
import pytest

from flockmetrics.llm import langid, quality
from flockmetrics.llm.queries import LANGUAGE_HELD_OUT, QUERIES
from flockmetrics.llm.texts import fold, slices


def test_language_held_out(spark, smoke_dir):
    sf = smoke_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op7_language"](spark, sf).collect() if r.held_out]
    assert len(held) > 250
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in held)


def test_quality_held_out(spark, smoke_dir):
    sf = smoke_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, poor = ([r.score for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > p for g in good for p in poor]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    ids = spark.range(100).withColumnRenamed("id", "doc_id")
    import zlib

    assert [r[0] for r in ids.select(fold("doc_id", 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(100)]
    assert LANGUAGE_HELD_OUT == 1


def test_language_defined_results(spark, awkward, nothing):
    docs = spark.createDataFrame([("der die das und nicht", "de"), ("the and of that", "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.learn(docs)
    assert model.langs == ("de", "en")
    rows = langid.with_language(awkward, model, "guess").collect()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.guess.lang == "und") == (not letters) and 0 <= r.guess.score <= 1
    empty = langid.learn(docs.limit(0))
    assert {r.guess.lang for r in langid.with_language(awkward, empty, "guess").collect()} == {"und"}
    assert langid.with_language(nothing, model).count() == 0


def test_language_counts_are_sums(spark, prose):
    texts = [prose(i, 30) for i in range(8)]
    whole = np.zeros(langid.BUCKETS)
    for run in slices(texts):
        for buckets, owner in langid._grams(run):
            assert (np.diff(owner) >= 0).all()
            whole += np.bincount(buckets, minlength=langid.BUCKETS)
    one_by_one = sum(np.bincount(b, minlength=langid.BUCKETS) for t in texts for b, _ in langid._grams([t]))
    assert (whole == one_by_one).all()


def test_features_of_a_text_do_not_depend_on_its_batch(prose):
    texts = ["", "a", "!!", prose(1, 50), "Ha ha ha", "é É", prose(2, 5) + " ,; " + prose(3, 5)]
    owner, feature, value = quality.features(texts)
    for i, text in enumerate(texts):
        _, own_feature, own_value = quality.features([text])
        assert (feature[owner == i] == own_feature).all() and np.allclose(value[owner == i], own_value)
        assert not len(own_value) or np.isclose((own_value**2).sum(), 1)


@pytest.mark.parametrize("rows", [40, 24_000])
def test_quality_learns(spark, prose, rows):
    rnd = random.Random(9)
    docs = []
    for i in range(300):
        text = prose(i, 30)
        docs.append((i, text.replace(" ", "!! ") if i % 3 == 0 else text, int(i % 3 != 0), rnd.random()))
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int, score double")
    model = quality.learn(df, df.select("doc_id", "quality"), rows=rows, shard_rows=30)
    out = quality.with_score(df, model, "s").collect()
    assert np.mean([(r.s >= 0.3) == bool(r.quality) for r in out]) > 0.9


def test_quality_defined_results(spark, awkward, nothing):
    unlearnt = quality.learn(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.s for r in quality.with_score(awkward, unlearnt, "s").collect()} == {0.5}
    labels = spark.createDataFrame([(6, 1), (7, 0), (None, 1), (8, None), (7, 0), (6, 0)], "doc_id long, quality int")
    model = quality.learn(awkward, labels)
    assert quality.with_score(awkward, model, "s").count() == awkward.count()
    assert quality.with_score(nothing, model).count() == 0


def test_most_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    docs = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(4)], "text string, lang string")
    assert langid.learn(docs.filter("lang <> 'l3'")).langs == ("l0", "l1", "l2")
    with pytest.raises(ValueError, match="more than 3"):
        langid.learn(docs)


def test_ids_that_repeat_are_learnt_within_the_limit(spark, prose):
    single = [(i, prose(i, 30) + " !!" * (i % 2)) for i in range(1, 40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int")

    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    # Copies change nothing.
    once, copied = (quality.learn(frame(rows), labels) for rows in (single, single + single[:5] * 60))
    assert np.allclose(once.weights, copied.weights) and np.isclose(once.intercept, copied.intercept)
    many = frame(single + [(0, prose(1_000 + i, 10)) for i in range(400)])
    rows, shards = quality.learning_rows(many, labels, rows=60, shard_rows=15)
    found = rows.collect()
    assert len(found) == 60 and {r.doc_id for r in found} == set(range(40)) and shards == 4
    assert max(sum(r._shard == s for r in found) for s in range(shards)) < 30
