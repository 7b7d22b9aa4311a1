"""SimHash near-duplicates: fingerprints, multi-index search within some bits, components.

Documents are reduced to distinct fingerprints first, so copies cost one row. Two fingerprints
within three bits differ by at most one bit in one of their halves; for more bits there are more
segments, one for each two bits and one over. Every fingerprint files itself under all segments
and probes the ball of radius one around each; as of two segments that differ in one bit exactly
one has that bit set, only set bits are cleared, never the others set. Rows of one segment meet in
one sorted partition, where distances are verified and only the edges of a spanning forest leave,
never all pairs. A very full segment is re-dealt by pieces of the other bits, one more than bits
may differ (of four bytes, three differing bits leave one equal), which loses no link.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
repeated rows each get a row; a component whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.components import components
from flockmetrics.llm.texts import spare, with_result
from flockmetrics.operators.joins import fits_broadcast, heavy_key_join
from flockmetrics.sources.stored import store

SHINGLE = 3
SEED = 42
BITS = 3
FULL = 4_096
_SPACES = bytes(range(9, 14)) + b" "
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _SPACES, bytes(range(97, 123)) + b" " * len(_SPACES))


def _fingerprint(text: str, size: int) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    n = max(1, len(words) - size + 1)
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    view = memoryview(line)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        b = min(n, a + 65_536)
        pairs = zip(starts[a:b].tolist(), ends[a + last : b + last].tolist(), strict=True)
        h = np.fromiter((digest(view[s:e], SEED) for s, e in pairs), np.uint64, b - a)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of ``column`` as a signed long with the same 64 bits."""
    def prepare():
        def work(texts: list[str]) -> pd.DataFrame:
            found = np.array([_fingerprint(t, size) for t in texts], np.uint64)
            return pd.DataFrame({"f": found.view(np.int64)})

        return work

    own = spare("simhash")
    return with_result(docs, column, own, "f long", prepare).withColumn(name, F.col(f"{own}.f")).drop(own)


def _forest(prints: np.ndarray, filed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Edges that join what distances join, fewer than there are fingerprints.

    A probe is compared only with fingerprints filed here: two probes meet elsewhere.
    """
    label = np.arange(len(prints))
    for i in np.flatnonzero(filed):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= bits)
        other, first = np.unique(label[near], return_index=True)
        fresh = other != label[i]
        if fresh.any():
            yield np.stack([np.full(fresh.sum(), prints[i]), prints[near[first[fresh]]]], axis=1)
            label[np.isin(label, other)] = label[i]


def _edges_of_sorted(bits: int):
    """From rows sorted by key, (key, print, filed), the forest of each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def groups(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, prints, filed = columns
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
            some = np.add.reduceat(filed, starts) > 0
            edges = [
                e for s, t in zip(starts[some & (ends - starts > 1)], ends[some & (ends - starts > 1)], strict=True)
                for e in _forest(prints[s:t], filed[s:t] > 0, bits)
            ]
            if edges:
                found = np.concatenate(edges).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["src", "dst"])

        for batch in batches:
            columns = [
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64),
            ]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = np.searchsorted(columns[0], columns[0][-1])
            kept = [x[last:] for x in columns]
            if last:
                yield from groups([x[:last] for x in columns])
        if kept is not None and len(kept[0]):
            yield from groups(kept)

    return run


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``parts`` pieces of ``width`` bits; a piece without bits is equal everywhere."""
    ends = [i * width // parts for i in range(parts + 1)]
    return [(start, end - start) for start, end in zip(ends[:-1], ends[1:], strict=True)]


def _segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the segments, of which one differs by at most one bit if the whole does by ``bits``."""
    return _cuts(64, max(2, bits // 2 + 1))


def _piece(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1)) if width else F.lit(0).cast("long")


def _ball(number: int, segment: Column, width: int) -> Column:
    """Rows (key, filed) of one segment: its own key, and its key with one set bit cleared at a time."""
    key = segment.bitwiseOR(F.lit(number << 32))

    def cleared(bit: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        return F.struct(key.bitwiseXOR(mask).alias("key"), F.lit(0).alias("filed"))

    set_bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda bit: F.getbit(segment, bit) == 1)
    return F.concat(F.array(F.struct(key.alias("key"), F.lit(1).alias("filed"))), F.transform(set_bits, cleared))


def _filed_and_probed(prints: DataFrame, bits: int) -> DataFrame:
    """(key, f, filed): each fingerprint under all segments, and under each with one set bit cleared."""
    rows = F.concat(*[_ball(number, _piece(F.col("f"), start, width), width) for number, (start, width) in enumerate(_segments(bits))])
    return prints.select("f", F.explode(rows).alias("row")).select("row.key", "f", "row.filed")


def _others(number: int, bits: int) -> list[Column]:
    """Pieces of all bits but those of a segment: two fingerprints within ``bits`` have one of them equal."""
    start, width = _segments(bits)[number]
    below = _piece(F.col("f"), 0, start)
    above = F.shiftleft(F.shiftrightunsigned("f", start + width), start) if start + width < 64 else F.lit(0).cast("long")
    rest = below.bitwiseOR(above)
    return [_piece(rest, *cut) for cut in _cuts(64 - width, bits + 1)]


def links(prints: DataFrame, bits: int = BITS, full: int = FULL) -> DataFrame:
    """(src, dst) over distinct fingerprints ``f``: edges that connect all pairs within ``bits``."""
    rows = _filed_and_probed(prints, bits)
    crowded = store(rows.groupBy("key").count().filter(F.col("count") > full).select(F.col("key").alias("crowd")), "crowded-halves")
    crowded = F.broadcast(crowded) if fits_broadcast(crowded) else crowded
    number = F.shiftrightunsigned("key", 32)
    by_piece = [F.array(*[F.xxhash64("key", F.lit(i), piece) for i, piece in enumerate(_others(n, bits))]) for n in range(len(_segments(bits)))]
    dealt_again = by_piece[-1]
    for n in range(len(by_piece) - 1):
        dealt_again = F.when(number == n, by_piece[n]).otherwise(dealt_again)
    deals = F.when(F.col("crowd").isNull(), F.array(F.xxhash64("key"))).otherwise(dealt_again)
    dealt = rows.join(crowded, F.col("key") == F.col("crowd"), "left").select(F.explode(deals).alias("deal"), "f", "filed")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "deal")
        .sortWithinPartitions("deal")
        .mapInArrow(_edges_of_sorted(bits), "src long, dst long")
        .distinct()
    )


def _labelled(docs: DataFrame, size: int, bits: int, full: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, f) of every row, and (f, first) of every fingerprint: the first row of its class.

    Rows are in order of (id, nulls last; hash of the text).
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    prints = store(with_fingerprint(rows, "text", "f", size).select("doc_id", "mark", "f"), "fingerprints")
    # Copies meet here once; what follows is as large as the number of different fingerprints.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    distinct = store(prints.groupBy("f").agg(F.min(row).alias("first")), "distinct-fingerprints")
    member = components(links(distinct.select("f"), bits, full))
    own = distinct.join(member, distinct["f"] == member["node"], "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    firsts = own.groupBy("component").agg(F.min("first").alias("first"))
    return prints, store(own.select("f", "component").join(firsts, "component").select("f", "first"), "classes")


def classes(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, full: int = FULL) -> DataFrame:
    """(doc_id, f, component_id): one row per document; the id is the smallest reachable."""
    prints, firsts = _labelled(docs, size, bits, full)
    labels = firsts.select("f", F.col("first.doc_id").alias("component_id"))
    if fits_broadcast(labels):
        joined = prints.join(F.broadcast(labels), "f")
    else:
        # One fingerprint may hold a third of all rows.
        joined = heavy_key_join(prints.withColumn("_spread", F.xxhash64("doc_id")), labels, "f", "inner", ["_spread"])
    return joined.select("doc_id", "f", "component_id")


def without_near_copies(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, full: int = FULL) -> DataFrame:
    """One document of each component, the first by id (nulls last) and text hash; all columns as they were.

    Of rows that repeat this id and text one stays.
    """
    prints, firsts = _labelled(docs, size, bits, full)
    keep_id, keep_mark, mark = map(spare, ("keep_id", "keep_mark", "mark"))
    keep = store(firsts.select(F.col("first.doc_id").alias(keep_id), F.col("first.mark").alias(keep_mark)).distinct(), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(mark) == F.col(keep_mark))
    kept = F.broadcast(keep) if fits_broadcast(keep) else keep
    chosen = docs.withColumn(mark, F.xxhash64("text")).join(kept, same, "left_semi")
    repeated = prints.groupBy("doc_id", "mark").count().filter("count > 1")
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", mark])
    return chosen.drop(mark)
