"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Words are runs of letters and digits (lower-cased A-Z) or runs of signs; a document's features are
the hashed words and pairs of neighbours, each weighted by the square root of its share, so long
texts weigh no more than short ones. A word that follows itself, at once or after
one other, is one feature whatever the word.
Shards of the learning rows run follow-the-regularised-leader updates side by side; their weights
are averaged, and every document is scored as a sparse dot product.

Defined results: null is the empty text, which has no features and scores by the intercept; labels
that contradict each other for one id count by majority, a tie as good; without any learning row
every score is one half; rows that repeat score alike and are learnt once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockmetrics.llm.texts import flat, mixed, slices, spare, with_result
from flockmetrics.sources.stored import store

BITS = 18
DIM = 1 << BITS
LEARN_ROWS = 24_000
SHARD_ROWS = 2_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.0
_SPACE, _WORD, _SIGN = 0, 1, 2


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, _SIGN, np.uint8)
    kind[:33] = _SPACE
    kind[127] = _SPACE
    kind[128:] = _WORD
    low = np.arange(256, dtype=np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            kind[c] = _WORD
            low[c] = ord(chr(c).lower())
    return kind, low


_KIND, _LOW = _classes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, ordered by text."""
    data, starts = flat(texts)
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, np.zeros(0)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    kind = _KIND[data]
    first = np.r_[True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(first)
    length = np.diff(np.r_[at, len(data)])
    powers = np.multiply.accumulate(np.full(int(length.max()), 0x100000001B3, np.uint64))
    place = np.arange(len(data)) - np.repeat(at, length)
    h = mixed(np.add.reduceat((_LOW[data].astype(np.uint64) + np.uint64(1)) * powers[place], at))
    real = kind[at] != _SPACE
    h, owner = h[real], owner[at][real]
    if not len(h):
        return empty, empty, np.zeros(0)
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(0x5851F42D4C957F2D)
    inside = owner[1:] == owner[:-1]
    echo = owner[2:][(h[2:] == h[:-2]) & (owner[2:] == owner[:-2])]
    all_h = np.r_[h, pair[inside], np.full(len(echo), 0x14057B7EF767814F, np.uint64)]
    all_owner = np.r_[owner, owner[1:][inside], echo]
    key = (all_owner.astype(np.int64) << BITS) | (all_h >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    owner, feature = key >> BITS, key & (DIM - 1)
    total = np.bincount(owner, weights=n, minlength=len(texts))
    return owner, feature, np.sqrt(n / total[owner])


@dataclass(frozen=True)
class Model:
    """A weight for each hash bucket, and the intercept."""

    weights: np.ndarray
    intercept: float


def _train(texts: list[str], labels: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Weights after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for run in slices(texts):
        owner, feature, value = features(run)
        cut = np.searchsorted(owner, np.arange(len(run) + 1))
        # Bucket DIM is the intercept's.
        rows += [(np.r_[feature[s:e], DIM], np.r_[value[s:e], 1.0]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            gradient = (p - labels[i]) * value
            after = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
            n[at] = after
    final = weights(slice(None))
    return final[:DIM], float(final[DIM])


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(doc_id, text, label, _shard), at most ``rows`` of them, and the number of shards.

    Copies with equal id and text are one row. The first texts of all labelled ids come before any
    others, which are taken by hash, so an id with very many texts leaves no id out.
    """
    known = store(
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows),
        "labelled",
    )
    text = F.coalesce("text", F.lit("")).alias("text")
    # Bounded by ``rows``, as is what joins it below.
    named = docs.select("doc_id", F.xxhash64(text).alias("mark")).join(F.broadcast(known), "doc_id")
    pairs = store(named.groupBy("doc_id", "label", "mark").agg(F.count("*").alias("n")), "labelled-texts")
    firsts = F.broadcast(pairs.groupBy("doc_id").agg(F.min("mark").alias("first")))
    chosen = store(
        pairs.join(firsts, "doc_id").withColumn("more", F.col("mark") != F.col("first"))
        .orderBy("more", F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(rows),
        "learning",
    )
    count, most = chosen.agg(F.count("*"), F.max("n")).first()
    shards = max(1, -(-count // shard_rows))
    deal = F.pmod(F.when(F.col("more"), F.xxhash64("doc_id", "mark")).otherwise(F.xxhash64("doc_id", F.lit(1))), F.lit(shards)).alias("_shard")
    wanted = F.broadcast(chosen.select("doc_id", "mark", "label", deal))
    sample = docs.select("doc_id", text, F.xxhash64(text).alias("mark")).join(wanted, ["doc_id", "mark"])
    if (most or 0) > 1:
        sample = sample.dropDuplicates(["doc_id", "mark"])
    return sample.drop("mark"), shards


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS
) -> Model:
    """Fit on (doc_id, text) with (doc_id, quality), on at most ``rows`` different labelled documents.

    Which ones is decided by the hash of their id, so the choice is the same in every run; their
    whole texts are used.
    """
    parts, shards = learning_rows(docs, labels, rows, shard_rows)

    def train(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "text"])
        weights, intercept = _train(shard["text"].tolist(), shard["label"].to_numpy(), epochs)
        some = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": np.r_[some, DIM], "weight": np.r_[weights[some], intercept]})

    found = (
        parts.groupBy("_shard").applyInPandas(train, "bucket int, weight double")
        .groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    )
    weights = np.zeros(DIM + 1)
    weights[found["bucket"].to_numpy(int)] = found["weight"].to_numpy(float)
    return Model(weights[:DIM].astype(np.float32), float(weights[DIM]))


def _score(model: Model, texts: list[str]) -> pd.DataFrame:
    owner, feature, value = features(texts)
    total = np.bincount(owner, weights=model.weights[feature] * value, minlength=len(texts)) + model.intercept
    return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))})


def with_score(docs: DataFrame, model: Model, name: str = "score", column: str = "text") -> DataFrame:
    """Add ``name``: how likely a label of 1 is, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        return lambda texts: _score(shared.value, texts)

    own = spare("quality")
    return with_result(docs, column, own, "score double", prepare).withColumn(name, F.col(f"{own}.score")).drop(own)
