"""Nearest vectors against comparison with all."""

import math
from collections import defaultdict

import numpy as np
import pytest

from flockmetrics.llm import neighbours
from flockmetrics.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, q int, v int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain_nearest(rows, k=20):
    """Per query row the k first of all other rows of its length."""
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if usable(v)]
    out = []
    for n, (own, q) in enumerate(rows):
        if own is None or own % 20:
            continue
        others = [(-(q * v).sum(), i is None, i or 0) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(q)]
        out.append((own, [(None if none else i, -s) for s, none, i in sorted(others)[:k]]))
    return out


def lists_of(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows, key=lambda r: r[0]) for q, rows in found.items()}


def recall(found, true):
    hits = total = 0
    for own, best in true:
        ids = {i for _, i, _ in found.get(own, ())}
        hits += sum(i in ids for i, _ in best)
        total += len(best)
    return hits / total


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query(spark, smoke_dir, folder):
    sf_dir = smoke_dir.replace("sf0.001", folder)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    vector = dict(rows)
    found = lists_of(QUERIES["op11_neighbours"](spark, sf_dir))
    true = plain_nearest(rows)
    assert set(found) == {own for own, _ in true}
    for own, hits in found.items():
        assert [r for r, _, _ in hits] == list(range(1, 21)) and own not in {i for _, i, _ in hits}
        assert hits == sorted(hits, key=lambda h: (-h[2], h[1]))
        q = np.array(vector[own], np.float64)
        assert all(abs(s - q @ np.array(vector[i], np.float64)) < 1e-12 for _, i, s in hits)
    assert recall(found, true) >= 0.9


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def test_copies_ties_and_rows_without_use(spark):
    """Fewer rows than buckets: every query is compared with all, so results are exact."""
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.5, 9.0]), (8, [0.5, -9.0]), (60, [1.0, 0.0, 0.0]),
            (80, None), (100, []), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [nan, 1.0]), (180, [inf, 1.0]), (-20, [1e-30, 1e30]), (9, [3.0, 0.0])]
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(table(spark, rows), neighbours.F.col("vec_id") % 20 == 0).collect()), key=repr)
    expected = [(own, n + 1, i, s) for own, best in plain_nearest(rows) for n, (i, s) in enumerate(best)]
    assert got == sorted(expected, key=repr)
    # A vector of another length has nothing to be compared with.
    assert not any(r[0] == 60 for r in got)


def test_a_third_of_all_rows_equal_and_buckets_cut(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)] + [(2000 + i, (np.ones(8) * (1 + i * 1e-5)).tolist()) for i in range(150)]
    df = table(spark, rows)
    found = lists_of(neighbours.nearest(df, neighbours.F.col("vec_id") % 20 == 0, group_bytes=2_000))
    true = plain_nearest(rows)
    assert recall(found, true) >= 0.9
    copies = [own for own, _ in true if 1000 <= own < 1200]
    for own in copies:
        expected = dict(true)[own]
        assert [(i, s) for _, i, s in found[own]] == expected or recall(found, [(own, expected)]) >= 0.9


def test_norms_of_every_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * 2.0 ** rng.integers(-12, 12)).tolist()) for i in range(1_500)]
    found = lists_of(neighbours.nearest(table(spark, rows), neighbours.F.col("vec_id") % 20 == 0))
    assert recall(found, plain_nearest(rows)) >= 0.9


def test_buckets_are_visited_by_likely_success():
    cells = np.array([[0.1, 0.9, 0.5]])
    order = np.argsort(neighbours._order(cells, 3)[0], kind="stable")
    steps = neighbours._perturbations(3)[0][order]
    assert steps[0].tolist() == [0, 0, 0] and {tuple(s) for s in steps[1:3]} == {(-1, 0, 0), (0, 1, 0)} and steps[3].tolist() == [-1, 1, 0]


def test_empty_table(spark):
    assert neighbours.nearest(table(spark, []), neighbours.F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [(20, None), (3, [1.0])]), neighbours.F.col("vec_id") % 20 == 0).count() == 0
