"""What the operators share: columns they may add, bounded slices of a batch, flat byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def spare(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def slices(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``limit`` characters; null becomes empty, a long text is alone."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def with_result(
    df: DataFrame,
    column: str,
    name: str,
    schema: str,
    prepare: Callable[[], Callable[[list[str]], pd.DataFrame]],
    by_slice: bool = False,
) -> DataFrame:
    """Add struct column ``name``: ``prepare()`` runs once per task, its result on slices of texts.

    Only ``column`` travels to Python; the other columns wait in the JVM. With ``by_slice`` results leave
    slice by slice, for those that are as long as the texts: of a task only the number of all rows must agree.
    """

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = prepare()
        for batch in batches:
            if by_slice:
                yield from map(work, slices(batch))
                continue
            parts = [work(run) for run in slices(batch)]
            yield pd.concat(parts, ignore_index=True) if parts else work([])

    return df.withColumn(name, apply.asNondeterministic()(F.col(column)))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each starts (one entry more: the end)."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(x) for x in encoded], out=starts[1:])
    return np.frombuffer(b"".join(encoded), np.uint8), starts


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed (the finaliser of SplitMix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
