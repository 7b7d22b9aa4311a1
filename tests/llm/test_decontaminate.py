"""Benchmark windows against plain Python, and what is removed."""

import random
import re
from collections import Counter

import pytest

from flockmetrics.llm import decontaminate

SCHEMA = "doc_id long, text string"


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(docs, items, n=13):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((doc_id, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(out)


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "Ünde", "x1", "A", "b", "日本", "42", "Sun"])
    sign = lambda: rnd.choice([" ", ", ", "\n", "-", " (", "\x00"])
    line = lambda k: "".join(word() + sign() for _ in range(k))
    items = [(i, line(rnd.choice([2, 5, 13, 20]))) for i in range(12)] + [(None, line(3)), (50, None), (51, "!!"), (3, line(14))]
    docs = []
    for i in range(80):
        parts = [line(rnd.randint(0, 15))] + [rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 2))] + [line(rnd.randint(0, 60))]
        docs.append((i, rnd.choice([str.upper, str.lower, str])(" ".join(parts))))
    return docs, items


def test_same_as_plain(spark, world, awkward, monkeypatch):
    docs, items = world
    docs = docs + [docs[3], (None, docs[4][1]), (None, docs[4][1])] + [(r.doc_id, r.text) for r in awkward.collect()]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")

    def found():
        rows = decontaminate.contamination(df, bench, ["doc_id"]).collect()
        return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)

    expected = plain(docs, items)
    assert found() == expected and sum(v for k, v in expected.items() if k[4]) > 5
    # The same rows when the benchmark is too large to copy.
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda df: False)
    assert found() == expected


def test_filter_and_spans(spark, world, awkward, nothing):
    docs, items = world
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    bad = {k[0] for k in plain(docs, items) if k[4]}
    assert {r.doc_id for r in decontaminate.without_contaminated(df, bench).collect()} == {d for d, _ in docs} - bad
    cut = {r.doc_id: len(r.text.split()) for r in decontaminate.without_spans(df, bench).collect()}
    assert cut == {k[0]: k[1] - k[2] for k in plain(docs, items)}
    assert decontaminate.without_contaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert decontaminate.without_contaminated(awkward, bench).columns == awkward.columns
    assert decontaminate.contamination(nothing, bench, ["doc_id"]).count() == 0


def test_no_python_in_the_plan(spark, world):
    docs, items = world
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.contamination(df, bench, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
