"""Exact duplicates by a sort of the whole normalised texts.

Sampled splitters deal the rows by leading bytes, hash and id, so texts that are equal are
neighbours and even a group that holds a third of all rows is cut into many parts. Each part is
sorted on disk by Spark and read once: neighbours are compared in full, and a run of equal texts
becomes rows that know their leader. Only runs at the edge of a part can go on in the next one;
they are as many as there are parts, and are added up by the digest of their text.

Defined results: null counts as empty, and texts without any other character than white space are
equal to it; rows that repeat in full are members like any others and one of them stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockmetrics.llm.texts import spare
from flockmetrics.sources.stored import store

SPACES = " \t\n\x0b\f\r"
LEAD_BYTES = 32
_RUNS = (
    "doc_id long, size long, is_leader boolean, sha string, part int, run int, edge boolean, "
    "keep_id long, n_chars long, own_chars long"
)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows in order to rows of runs; a run's rows follow once it has ended."""
    names = [field.split()[0] for field in _RUNS.split(", ")]
    text, ids, number, part = None, [], 0, -1
    out: list[tuple] = []

    def end(edge: bool) -> None:
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for nth, (doc_id, own) in enumerate(ids):
            out.append((doc_id, len(ids), nth == 0, sha, part, number, edge, *ids[0], own))

    def table() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=names)
        out.clear()
        return frame.astype({"doc_id": "Int64", "keep_id": "Int64"})

    for batch in batches:
        for norm, length, doc_id, own in zip(*(batch[c].tolist() for c in ("norm", "n_chars", "doc_id", "part")), strict=True):
            doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
            if norm == text:
                ids.append((doc_id, length))
                continue
            if text is not None:
                end(number == 0)
                number += 1
            text, ids, part = norm, [(doc_id, length)], own
        yield table()
    if text is not None:
        end(True)
        yield table()


def groups(docs: DataFrame, lead_bytes: int = LEAD_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars): one row for each row of (doc_id, text).

    The row with the most code points in its own text stays, of these the one with the smallest
    id (null after all others).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), F.translate(text, SPACES, "").alias("norm")
    )
    rows = rows.select("*", F.substring(F.col("norm").cast("binary"), 1, lead_bytes).alias("lead"), F.xxhash64("norm").alias("hash"))
    in_order = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    # What is sampled for the splitters is short; equal texts still have equal (lead, hash).
    dealt = (
        rows.repartitionByRange(parts, "lead", "hash", *in_order)
        .sortWithinPartitions("lead", "hash", "norm", *in_order)
        .select("doc_id", "n_chars", "norm", F.spark_partition_id().alias("part"))
    )
    runs = store(dealt.mapInPandas(_runs, _RUNS), "runs")
    edges = runs.filter("edge")
    best = Window.partitionBy("sha").orderBy(F.col("n_chars").desc(), F.col("keep_id").asc_nulls_last(), "part")
    # Two runs for each part at most.
    across = edges.filter("is_leader").select(
        F.col("part").alias("_part"), F.col("run").alias("_run"),
        F.first("keep_id").over(best).alias("_keep"),
        F.sum("size").over(Window.partitionBy("sha")).alias("_size"),
        (F.row_number().over(best) == 1).alias("_best"),
    )
    whole = runs.join(F.broadcast(across), (F.col("part") == F.col("_part")) & (F.col("run") == F.col("_run")), "left")
    return whole.select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", "size").alias("group_size"),
        (F.col("is_leader") & F.coalesce("_best", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("own_chars").alias("n_chars"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; all columns as they were.

    Where the row that stays repeats (same id, equal text of the same length), one of them stays.
    """
    id_, sha, n, own_sha, own_n = map(spare, ("id", "sha", "n", "own_sha", "own_n"))
    found = store(groups(docs).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), F.col("n_chars").alias(n), "kept"), "copies")
    kept = found.filter("kept").drop("kept")
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("*", F.sha2(F.translate(text, SPACES, "").cast("binary"), 256).alias(own_sha), F.length(text).cast("long").alias(own_n))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)) & (F.col(own_n) == F.col(n))
    chosen = marked.join(kept, same, "left_semi")
    if found.groupBy(id_, sha, n).agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).filter("kept and rows > 1").limit(1).count():
        chosen = chosen.dropDuplicates(["doc_id", own_sha, own_n])
    return chosen.drop(own_sha, own_n)
