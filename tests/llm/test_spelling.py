"""Spelling variants against all deletions of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from flockmetrics.llm import spelling
from flockmetrics.llm.queries import QUERIES
from flockmetrics.llm.scratch import Scratch


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_near(words):
    """Words that share a text with one letter deleted, or are one, compared letter by letter."""
    by_text = defaultdict(set)
    for word in words:
        for text in {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}:
            by_text[text].add(word)
    near = defaultdict(set)
    for group in by_text.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def plain_counts(rows, planted=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if planted and h % planted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(rows, planted=199):
    counts = plain_counts(rows, planted)
    near = plain_near(counts)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best and counts[best] >= 5 * n else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query(spark, smoke_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_variants(docs)
    assert rows_of(QUERIES["op12_spelling"](spark, smoke_dir)) == expected
    assert any(r[4] for r in expected)


@pytest.mark.parametrize("letters, size", [("ab", 10), ("abc", 20_000), ("aéz", 500)])
def test_no_pair_is_lost(spark, letters, size, monkeypatch):
    """Words from few letters, near each other in every way, under dictionaries of any size."""
    monkeypatch.setattr(spelling, "ENDS", 4 if size == 500 else 64)
    monkeypatch.setattr(spelling, "frequent_grams", lambda words, make=spelling.frequent_grams: make(words, size, 3))
    rnd = random.Random(size)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12))) for _ in range(300)}
    for word in list(words):
        i, c = rnd.randrange(len(word) + 1), rnd.choice(letters)
        words |= {w for w in (word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]) if len(w) >= 6}
    scratch = Scratch()
    table = scratch.store(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "words")
    got = {(r.word, r.other) for r in spelling.near_words(table, scratch).collect()}
    assert got == {(w, o) for w, others in plain_near(words).items() for o in others}


def test_some_pair_of_grams_always_guards_the_word(monkeypatch):
    monkeypatch.setattr(spelling, "ENDS", 5)
    rnd = random.Random(5)
    for _ in range(2_000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(6, 14)))
        frequent = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))) for _ in range(rnd.randint(0, 30))}
        frequent = {g for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}
        for shorter in (len(word), len(word) - 1):
            if shorter >= 6:
                longest = min(spelling.LONGEST, shorter // 2)
                found = spelling.guards(word, spelling.decompose(word, frequent, longest), shorter, longest)
                assert any(f and not g and b >= a - 1 for _, f, a in found for _, g, b in found)


def test_chains_ties_and_repeats(spark):
    text = " ".join(["stones"] * 5 + ["stoness"] * 25 + ["stonessx"] * 125 + ["stonesz"] * 25 + ["Éclair×"] * 5 + ["short"] * 9 + ["rarely"] * 4)
    rows = [(1, text), (None, None), (2, ""), (3, "x" * 40_000), (3, "x" * 40_000)] + [(None, "nobody NOBODY nobody nobody nobody")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: spelling.F.lit(1) for c in ("word", "n", "form", "key", "_salt")})
    got = rows_of(spelling.variants(docs, planted=0))
    assert got == plain_variants(rows, planted=0)
    found = {r[0]: r[1:] for r in got}
    assert found["stones"] == ("stoness", "stonessx", 5, 2, 25)
    assert found["stonessx"][:2] == (None, "stonessx") and found["stonesz"][0] == "stonessx" or found["stonesz"][0] is None


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Über WORDS-of_texts " * 40 + "y" * 300
    whole = spelling.words_of(7, text)
    monkeypatch.setattr(spelling, "_PIECE", 16)
    assert spelling.words_of(7, text) == whole and whole["y" * 300] + whole["y" * 299] == 1


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] * 5
    five = awkward.union(awkward).union(awkward).union(awkward).union(awkward)
    assert rows_of(spelling.variants(five)) == plain_variants(rows)
    assert spelling.variants(nothing).count() == 0
