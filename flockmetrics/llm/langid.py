"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all learning documents are added up in Spark; the model, one row of log-probabilities per
hash bucket, is small by construction and copied to every task, where numpy sums the rows of a
document's n-grams.

Defined results: null, empty and letterless texts are ``und`` with score 0; without any learning
document every text is ``und``; of languages that tie the first in order is taken; rows that repeat
are predicted alike, and learned as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.texts import slices, with_result

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
MOST_LANGS = 1_000


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (bucket, text) of every n-gram of the lower-cased texts, by text.

    White space counts as one space.
    """
    low = [" " + " ".join(t.lower().split()) + " " for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            return
        value = value[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in SIZES:
            whole = owner[: len(value)] == owner[n - 1 :]
            h = ((value + np.uint64(n << 40)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - int(np.log2(BUCKETS)))
            yield h[whole].astype(np.int32), owner[: len(value)][whole]


@dataclass(frozen=True)
class Model:
    """langs in order, and log P(bucket | lang) + nothing else per row; ``prior`` is log P(lang)."""

    langs: tuple[str, ...]
    table: np.ndarray
    prior: np.ndarray


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task, by language and bucket; bucket -1 counts documents."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, own in batch.groupby("lang")["text"]:
            total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for run in slices(own):
                for buckets, _ in _grams(run):
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                total[BUCKETS] += len(run)
            if len(sums) > 16:
                yield from _rows(sums)
                sums = {}
    yield from _rows(sums)


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, total in sums.items():
        some = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": np.where(some == BUCKETS, -1, some), "n": total[some]})


def learn(docs: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """From all rows of (text, lang) where lang is not null. At most ``MOST_LANGS`` languages."""
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    if rows.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    # At most (languages x buckets) rows come back, whatever the size of the corpus.
    counts = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = tuple(sorted(found["lang"].unique()))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    table, docs_of = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        docs_of[i] = own.loc[own["bucket"] == -1, "n"].sum()
        real = own[own["bucket"] >= 0]
        table[real["bucket"].to_numpy(), i] = real["n"].to_numpy()
    table += smoothing
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(docs_of / docs_of.sum()))


def _predict(model: Model, texts: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({"lang": ["und"] * len(texts), "score": np.zeros(len(texts))})
    if not model.langs or not texts:
        return out
    total = np.tile(model.prior, (len(texts), 1))
    for buckets, owner in _grams(texts):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(owner)]
        if len(starts):
            total[owner[starts]] += np.add.reduceat(model.table[buckets], starts, axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = np.array([any(map(str.isalpha, t)) for t in texts])
    out.loc[known, "lang"] = np.array(model.langs, object)[best][known]
    out.loc[known, "score"] = score[known]
    return out


def with_language(docs: DataFrame, model: Model, name: str = "language", column: str = "text") -> DataFrame:
    """Add struct ``name`` (lang, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        return lambda texts: _predict(shared.value, texts)

    return with_result(docs, column, name, "lang string, score double", prepare)
