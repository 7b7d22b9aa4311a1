"""Repeated passages: a suffix array over chosen suffixes of all documents.

A byte is repeated if a string of ``size`` bytes that covers it starts anywhere else as well. Every
window of that length chooses one suffix start inside it by content alone (the lowest hash of
``lead`` bytes, the first of equals), so two equal windows choose the same start, and about one
position in 170 is chosen. A window is then a suffix, some bytes further left, and as many fewer
to the right.

1. Chosen starts are written with a hash of their first ``lead`` bytes and of all bytes a window
   through them can hold (their context). Contexts met twice are repeated as a whole.
2. One suffix of each context whose lead occurs in another context too is cut from a text that has
   it, and sampled splitters range-partition these suffixes by their leading bytes.
3. Each bucket sorts its suffixes, and their left sides read backwards, by multikey quicksort; the
   common lengths of neighbours say for every length to the left whether another suffix shares it
   and the rest to the right.
4. Equal leads never meet across a boundary. Where a lead has more contexts than a bucket should
   hold, its windows are counted by hash in Spark instead.

Texts are known by their hash and size; equal texts share all results.

Defined results: null is the empty text; texts shorter than ``size`` keep all; matches never cross
documents; a row that repeats in full repeats the other's windows; ids play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.texts import mixed, spare
from flockmetrics.operators.joins import fits_broadcast
from flockmetrics.sources.stored import store

SIZE = 400
LEAD = 64
CROWD = 50_000
PIECE = 1 << 19
_LOW_BITS = np.uint64(24)
_TEXT = ("_mark", "_size")
_CONTEXT = ("lead", "context")


def _rolling(data: np.ndarray, lead: int) -> np.ndarray:
    """A 64-bit hash of the ``lead`` bytes (a power of two) from each position."""
    h = mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < lead:
        h = h[: len(h) - step] * np.uint64(0xD1342543DE82EF95 + 2 * step) + h[step:]
        step *= 2
    return mixed(h)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest of ``width`` values from each position."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[: len(values) - step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _chosen(data: np.ndarray, windows: np.ndarray | slice, size: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    h = _rolling(data, lead)
    key = (h >> _LOW_BITS << _LOW_BITS) | np.arange(len(h), dtype=np.uint64)
    lowest = _lowest(key, size - lead + 1)[windows]
    at = np.unique(lowest & np.uint64((1 << int(_LOW_BITS)) - 1)).astype(np.int64)
    return at, h[at]


def starts(data: np.ndarray, size: int = SIZE, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the lead) of the chosen suffix starts of one document, in order."""
    found = [
        (first, *_chosen(data[first : first + PIECE + size - 1], slice(None), size, lead))
        for first in range(0, max(0, len(data) - size + 1), PIECE)
    ]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Pieces overlap, so the last of one may be the first of the next.
    at, which = np.unique(np.concatenate([at + first for first, at, _ in found]), return_index=True)
    return at, np.concatenate([h for _, _, h in found])[which]


def starts_of_all(texts: list[bytes], size: int = SIZE, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash of the lead) of short texts, all at once."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(len(data) - size + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # Windows that end in another text are none.
    at, h = _chosen(data, first + size <= ends[owner[first]], size, lead)
    return owner[at], at - (ends - sizes)[owner[at]], h


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _raw(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of one text after the other, as they lie in the batch."""
    for text in texts:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _context(raw: bytes, p: int, size: int, lead: int) -> int:
    """A hash of all bytes that a window through the start can hold; the seed tells how many lie to the left."""
    left = min(p, size - lead)
    return xxhash.xxh3_64_intdigest(raw[p - left : p + size], seed=left)


def _contexts(raw: bytes, at: np.ndarray, size: int, lead: int) -> np.ndarray:
    return np.fromiter((_context(raw, p, size, lead) for p in at.tolist()), np.uint64, len(at)).view(np.int64)


def _starts_of(size: int, lead: int):
    def table(texts: list[bytes], rows: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(texts) == 1:
            at, h = starts(np.frombuffer(texts[0], np.uint8), size, lead)
            owner = np.zeros(len(at), np.int64)
        else:
            owner, at, h = starts_of_all(texts, size, lead)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        context = [_contexts(raw, at[s:e], size, lead) for raw, s, e in zip(texts, cut[:-1], cut[1:], strict=True)]
        which = np.array(rows)[owner]
        marks, sizes = (batch.column(i).to_numpy()[which] for i in (1, 2))
        columns = (marks, sizes, at.astype(np.int32), h.view(np.int64), np.concatenate(context))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_mark", "_size", "pos", "lead", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes] = []
            rows: list[int] = []
            total = 0
            for i, raw in enumerate(_raw(batch.column(0))):
                if len(raw) < size:
                    continue
                if texts and total + len(raw) > PIECE:
                    yield table(texts, rows, batch)
                    texts, rows, total = [], [], 0
                texts.append(raw)
                rows.append(i)
                total += len(raw)
            if texts:
                yield table(texts, rows, batch)

    return run


def multikey_order(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (padded with zeros), and the common length of each with the one before.

    Multikey quicksort with eight bytes as one character: all groups that are still equal are
    partitioned by their next character together, and only what stays equal is looked at again.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # group[i]: first place of the group that holds place i
    active = np.arange(n)
    for column in range(words.shape[1]):
        if len(active) < 2:
            break
        value = words[order[active], column]
        by = np.lexsort((value, group[active]))
        order[active] = order[active][by]
        value, own = value[by], group[active]
        same_group = np.r_[False, own[1:] == own[:-1]]
        same = same_group & np.r_[False, value[1:] == value[:-1]]
        # Where a group splits, the first byte that differs ends the common part.
        split = np.flatnonzero(same_group & ~same)
        differ = (value[split] ^ value[split - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
        common[active[split]] = 8 * column + (differ != 0).argmax(axis=1)
        head = np.flatnonzero(~same)
        group[active] = np.repeat(active[head], np.diff(np.r_[head, len(active)]))
        stay = same | np.r_[same[1:], False]
        active = active[stay]
    if len(active):
        # Equal to the end: shorter strings first.
        by = np.lexsort((lengths[order[active]], group[active]))
        order[active] = order[active][by]
        own = group[active]
        common[active[np.r_[False, own[1:] == own[:-1]]]] = width
    both = np.minimum(lengths[order[1:]], lengths[order[:-1]])
    common[1:] = np.minimum(common[1:], both)
    return order, common


def shared_reach(right: list[bytes], left: list[bytes], size: int = SIZE, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, how far left and right windows through its start reach that another one shares.

    ``left`` is read backwards from the start. Zero to the right means that there is no such window.
    """
    n, most_left = len(right), size - lead
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return far_left, far_right

    def matrix(values: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(n, width)

    right_size, left_size = (np.array([len(v) for v in x], np.int64) for x in (right, left))
    r_order, r_common = multikey_order(matrix(right, size), right_size)
    l_order, l_common = multikey_order(matrix(left, most_left), left_size)
    r_place, l_place = np.empty(n, np.int64), np.empty(n, np.int64)
    r_place[r_order] = l_place[l_order] = np.arange(n)
    best_right = np.maximum(r_common, np.r_[r_common[1:], 0])[r_place]
    best_left = np.maximum(l_common, np.r_[l_common[1:], 0])[l_place]
    live = np.flatnonzero(best_right + best_left >= size)
    for a in range(most_left + 1):
        if a:
            live = live[best_left[live] >= a]
        some = live[best_right[live] >= size - a]
        if len(some) < 2:
            continue
        # Places with a common length below the threshold start a new run of equal strings.
        r_run, l_run = np.cumsum(r_common < size - a)[r_place[some]], np.cumsum(l_common < a)[l_place[some]]
        key = r_run * (n + 1) + l_run
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        found = some[by[np.r_[False, same] | np.r_[same, False]]]
        far_left[found] = a
        far_right[found] = np.maximum(far_right[found], size - a)
    return far_left, far_right


def _bucket(size: int, lead: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        # Texts that occur twice have cut their suffixes twice.
        table = pd.concat(rows, ignore_index=True).drop_duplicates(list(_CONTEXT), ignore_index=True)
        far_left, far_right = shared_reach(table["right"].tolist(), table["left"].tolist(), size, lead)
        some = far_right > 0
        yield table.loc[some, list(_CONTEXT)].assign(l=far_left[some], r=far_right[some])

    return run


def _windows(size: int, lead: int):
    """Hash of every window of each suffix, with its length to the left."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own_lead, context, right, left in zip(batch["lead"], batch["context"], batch["right"], batch["left"], strict=True):
                whole = left[::-1] + right
                reach = range(max(0, size - len(right)), min(len(left), size - lead) + 1)
                yield pd.DataFrame({
                    "lead": own_lead, "context": context, "l": list(reach),
                    "window": [xxhash.xxh3_128_digest(whole[len(left) - a : len(left) - a + size]) for a in reach],
                })

    return run


def _cut(size: int, lead: int):
    """The bytes around the wanted starts of a text: to the right, and to the left read backwards."""
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"lead": pa.int64(), "context": pa.int64(), "right": pa.binary(), "left": pa.binary()}
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, wanted in zip(_raw(batch.column(0)), batch.column(1), strict=True):
                contexts = {int(one) for one in wanted.as_py().split(",")}
                at, h = starts(np.frombuffer(raw, np.uint8), size, lead)
                for p, own_lead, context in zip(at.tolist(), h.view(np.int64).tolist(), _contexts(raw, at, size, lead).tolist(), strict=True):
                    if context in contexts:
                        contexts.discard(context)
                        rows.append((own_lead, context, raw[p : p + size], raw[max(0, p - size + lead) : p][::-1]))
                if len(rows) > 10_000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the hash and size of their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("*", F.xxhash64(text).alias("_mark"), F.octet_length(text).alias("_size"))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def repeated_spans(docs: DataFrame, size: int = SIZE, lead: int = LEAD, crowd: int = CROWD) -> DataFrame:
    """(_mark, _size, _spans): for texts with repeated bytes, "start:end" joined by commas, unmerged."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "_mark long, _size int, pos int, lead long, context long"
    chosen = store(docs.select("text", *_TEXT).mapInArrow(_starts_of(size, lead), schema), "suffix-starts")

    contexts = store(chosen.groupBy(*_CONTEXT).agg(F.count("*").alias("copies"), F.min("_mark").alias("_mark")), "contexts")
    shared = store(contexts.groupBy("lead").agg(F.count("*").alias("n")).filter("n > 1"), "shared-leads")

    def suffixes(leads: DataFrame) -> DataFrame:
        """(lead, context, right, left) of all contexts with one of the leads."""
        needed = contexts.join(_maybe_broadcast(leads), "lead", "left_semi")
        wanted = store(needed.groupBy("_mark").agg(F.array_join(F.collect_list("context"), ",").alias("wanted")), "wanted")
        # Of a text that occurs many times one row is cut.
        texts = docs.select("text", *_TEXT).join(_maybe_broadcast(wanted), "_mark").dropDuplicates(list(_TEXT)).select("text", "wanted")
        return texts.mapInArrow(_cut(size, lead), "lead long, context long, right binary, left binary")

    dealt = suffixes(shared.filter(F.col("n") <= crowd).select("lead")).repartitionByRange(parts, F.substring("right", 1, lead))
    met = dealt.mapInPandas(_bucket(size, lead), "lead long, context long, l int, r int")
    crowds = shared.filter(F.col("n") > crowd).select("lead")
    if not crowds.isEmpty():
        windows = suffixes(crowds).mapInPandas(_windows(size, lead), "lead long, context long, l int, window binary").distinct()
        # At equal lengths to the left, two contexts are two places.
        twice = windows.groupBy("l", "window").count().filter("count > 1").select("l", "window")
        met = met.union(windows.join(twice, ["l", "window"], "left_semi").groupBy(*_CONTEXT).agg(
            F.max("l").alias("l"), (F.lit(size) - F.min("l")).cast("int").alias("r")))
    whole = contexts.filter("copies > 1").select(*_CONTEXT, F.lit(size - lead).alias("l"), F.lit(size).alias("r"))
    reach = store(met.union(whole).groupBy(*_CONTEXT).agg(F.max("l").alias("l"), F.max("r").alias("r")), "reaches")
    start, end = F.greatest(F.col("pos") - F.col("l"), F.lit(0)), F.col("pos") + F.col("r")
    # Both sides are plain scans, so adaptive execution cuts up a context of very many copies.
    spans = chosen.join(reach, list(_CONTEXT)).select(*_TEXT, F.concat_ws(":", start, end).alias("span"))
    return spans.distinct().groupBy(*_TEXT).agg(F.array_join(F.collect_list("span"), ",").alias("_spans"))


def _kept(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many go, and in how many runs."""
    if not isinstance(spans, str) or not spans:
        return raw, 0, 0
    step = np.zeros(len(raw) + 1, np.int64)
    for one in spans.split(","):
        start, end = one.split(":")
        step[int(start)] += 1
        step[min(int(end), len(raw))] -= 1
    gone = np.cumsum(step)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def without_repeats(docs: DataFrame, name: str = "result", digest: bool = False, size: int = SIZE, lead: int = LEAD, crowd: int = CROWD) -> DataFrame:
    """Add struct ``name``: n_bytes, n_removed, n_spans and the bytes that are kept (or their SHA-256)."""
    others = {column: spare(column) for column in docs.columns if column not in ("text", name)}
    keyed = _keyed(docs.select("text", *(F.col(column).alias(own) for column, own in others.items())))
    spans = store(repeated_spans(keyed, size, lead, crowd), "repeated-spans")

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            rows = []
            for text, own in zip(texts, all_spans, strict=True):
                raw = _bytes(text)
                kept, removed, runs = _kept(raw, own)
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(_maybe_broadcast(spans), list(_TEXT), "left")
    result: Column = apply.asNondeterministic()("text", "_spans")
    return joined.select(*(F.col(others.get(column, column)).alias(column) for column in docs.columns if column != name), result.alias(name))
