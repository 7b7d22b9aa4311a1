"""Runs of words against plain definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flockmetrics.llm import runs
from flockmetrics.llm.queries import QUERIES


def plain_lyndon(word):
    """Longest Lyndon word at each position, by comparing all suffixes of all stretches."""
    return [
        max(e - i for e in range(i + 1, len(word) + 1) if all(word[i:e] < word[k:e] for k in range(i + 1, e)))
        for i in range(len(word))
    ]


def plain_runs(words, least=24, times=3):
    """Every maximal stretch with a period, kept where that period is its smallest."""
    n, found = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - start
            part = words[start : i + p]
            if size >= max(least, times * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((start, size, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, z, p in found for i in range(s + p, s + z)}
    best = (None,) * 4
    if found:
        s, z, p = found[0]
        for run in found[1:]:
            if run[1] * p > z * run[2]:
                s, z, p = run
        best = (s, z, p, 1000 * z // p)
    digests = ("".join(f"{s},{z},{p}\n" for s, z, p in found), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *best, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in digests))


def with_repeats(rnd, n, letters):
    words = [rnd.randint(0, letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        period = [rnd.randint(0, letters) for _ in range(rnd.randint(1, 9))]
        at = rnd.randint(0, len(words))
        words[at:at] = (period * 12)[: rnd.randint(2, 8) * len(period) + rnd.randint(0, 3)]
    return words


def test_grouping_gives_lyndon_words():
    rnd = random.Random(1)
    for _ in range(400):
        word = [rnd.randint(0, rnd.randint(0, 3)) for _ in range(rnd.randint(1, 16))]
        assert runs.lyndon_lengths(word) == plain_lyndon(word)


@pytest.mark.parametrize("least, times", [(24, 3), (24, 4), (5, 3), (2, 2)])
def test_runs(least, times):
    rnd = random.Random(2)
    for _ in range(300):
        words = with_repeats(rnd, rnd.randint(0, 120), rnd.randint(1, 4))
        assert runs.periodic_runs(np.array(words, np.int64), least, times) == plain_runs(words, least, times)


def test_erring_fingerprints_change_nothing(monkeypatch):
    rnd = random.Random(3)
    # Every stretch looks equal: each candidate is then extended by words.
    monkeypatch.setattr(runs._Prints, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    for _ in range(60):
        words = with_repeats(rnd, 60, 3)
        assert runs.runs_of(np.array(words, np.int64), 24, 3) == plain_runs(words)


def test_words_are_cut_at_pieces():
    text = ("ab  c\n" * 500 + "x" * 3000 + "\x0b" + "d\xa0e " * 50).encode()
    assert [w for part in runs.pieces(text, 64) for w in part] == text.split()
    symbols, words = runs.numbered(text)
    assert [words[i] for i in symbols] == text.split()


def test_query(spark, smoke_dir):
    got = sorted(map(tuple, QUERIES["op13_runs"](spark, smoke_dir).collect()))
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.filter("length(text) < 30000 or text is null")
    got = runs.with_runs(rows, name="out", digest=True, plant_by="doc_id").collect()
    assert set(awkward.columns) <= set(got[0].asDict())
    found = [(r.doc_id, r.out.n_runs, r.out.start, r.out.length, r.out.period, r.out.exponent_milli, r.out.runs_text, r.out.collapsed.decode()) for r in got]
    assert sorted(found, key=repr) == sorted((plain_row(r.doc_id, r.text) for r in rows.collect()), key=repr)
    long = runs.with_runs(awkward.filter("doc_id = 6"), name="out").first().out
    assert (long.n_runs, long.start, long.length, long.period, bytes(long.collapsed)) == (1, 0, 30_000, 1, b"word")
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1)] and long.runs_text == "0,30000,1\n"
    assert runs.with_runs(nothing, name="out").count() == 0
