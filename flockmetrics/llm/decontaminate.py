"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark are a hash table that is copied to every task, and the word windows of all
documents stream past it. A window is thirteen columns of one row, so a hit of the hash is verified word
by word where it is found. If the windows are not small, only their 64-bit hashes are copied, up to
``MOST_HASHES`` of them; what hits a hash is shuffled with the first row of each document and verified
there. Beyond that number windows are joined by shuffle.

Defined results: null text has no words; an empty benchmark hits nothing; repeated rows and null
ids each get their own result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.texts import spare
from flockmetrics.operators.joins import fits_broadcast
from flockmetrics.sources.stored import store

WINDOW = 13
ONE_IN = 20
# A hash takes some 40 bytes where it is looked up, so at most 160 MB are copied.
MOST_HASHES = 4_000_000
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) != " ")


def words(text: str) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z only; null has none."""
    spaced = F.translate(
        F.coalesce(F.col(text), F.lit("")),
        string.ascii_uppercase + _BREAKS,
        string.ascii_lowercase + " " * len(_BREAKS),
    )
    return F.array_remove(F.split(spaced, " ", -1), "")


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(window, size, items): each n-gram as one text, with the items that hold it.

    An item of fewer words, but not none, is one window. A null item id counts as the empty one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    return (
        items.filter(F.size("w") > 0)
        .select("item", size.alias("size"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
        .select("item", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window"))
        .groupBy("window", "size")
        .agg(F.collect_set("item").alias("items"))
    )


def _covered(hits: str) -> Column:
    """Words inside at least one of the windows (at, size)."""
    def add(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(hit["at"], state["end"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], end).alias("end"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(hits), start, add, lambda state: state["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str], n: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """One row per document: ``keys``, n_words, n_hit, n_items, items (sorted), hits, contaminated.

    ``hits`` are the windows (at, size) of the text's words that occur in the benchmark.
    A document is contaminated if at least one word in ``one_in`` is inside such a window.
    """
    windows = store(item_windows(benchmark, n), "benchmark-windows")
    # At most n different sizes.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    # Rows stay apart by a number of their own: ids may repeat or be null.
    row = spare("row")
    each = [F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(n)]
    rows = docs.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias(row), words("text").alias("w")
    ).select(
        *[f"key_{i}" for i in range(len(keys))], row, F.size("w").alias("n_words"),
        # outer: a document without words keeps one row
        F.posexplode_outer(F.arrays_zip(*each)).alias("at", "x"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "x"], "x.*")
    total = windows.count()
    small = fits_broadcast(windows.select("window", F.array_join("items", ",").alias("items")))
    if sizes and not small and total <= MOST_HASHES:
        return _per_document(_verified_after(rows, windows, sizes, keys, row), keys, row, one_in)
    for size in sizes:
        parts = F.split("window", " ")
        table = windows.filter(F.col("size") == size).select(
            F.xxhash64(*[parts[i] for i in range(size)]).alias(f"hash_{size}"),
            F.col("window").alias(f"window_{size}"),
            F.col("items").alias(f"items_{size}"),
        )
        own = [F.col(f"w{i}") for i in range(size)]
        same = (F.xxhash64(*own) == F.col(f"hash_{size}")) & (F.concat_ws(" ", *own) == F.col(f"window_{size}"))
        rows = rows.join(F.broadcast(table) if small else table, same, "left")
    found = [F.col(f"items_{size}").isNotNull() for size in sizes]
    hit = F.lit(False)
    for one in found:
        hit = hit | one
    longest = F.lit(None).cast("int")
    for size, one in zip(sizes, found, strict=True):
        longest = F.when(one, F.lit(size)).otherwise(longest)
    items = F.array_distinct(F.concat(*[F.coalesce(f"items_{s}", F.array().cast("array<string>")) for s in sizes])) if sizes else F.array().cast("array<string>")
    # The first word of a document stands for it; of the others only hits go on.
    rows = rows.filter(F.col("at").isNull() | (F.col("at") == 0) | hit).select(
        *[f"key_{i}" for i in range(len(keys))], row, "n_words",
        F.when(longest.isNotNull(), F.struct(F.col("at"), longest.alias("size"))).alias("hit"), items.alias("items"),
    )
    return _per_document(rows, keys, row, one_in)


def _verified_after(rows: DataFrame, windows: DataFrame, sizes: list[int], keys: list[str], row: str) -> DataFrame:
    """The first row of every document, and rows of hits: only windows with the hash of an item's are shuffled."""
    candidates = []
    for size in sizes:
        parts = F.split("window", " ")
        hashes = windows.filter(F.col("size") == size).select(F.xxhash64(*[parts[i] for i in range(size)]).alias(f"hash_{size}")).distinct()
        own = [F.col(f"w{i}") for i in range(size)]
        rows = rows.join(F.broadcast(hashes), F.xxhash64(*own) == F.col(f"hash_{size}"), "left")
        one = F.struct(F.lit(size).alias("size"), F.concat_ws(" ", *own).alias("window"))
        candidates.append(F.when(F.col(f"hash_{size}").isNotNull(), one))
    rows = rows.select(
        *[f"key_{i}" for i in range(len(keys))], row, "n_words", "at",
        F.filter(F.array(*candidates), lambda c: c.isNotNull()).alias("candidates"),
    )
    rows = rows.filter(F.col("at").isNull() | (F.col("at") == 0) | (F.size("candidates") > 0))
    # No word holds a "#": rows without a candidate match nothing, and do not all go to one task.
    rows = rows.select("*", F.explode_outer("candidates").alias("candidate")).select(
        *[f"key_{i}" for i in range(len(keys))], row, "n_words", "at", F.col("candidate.size").alias("own_size"),
        F.coalesce("candidate.window", F.concat(F.lit("#"), F.col(row))).alias("own_window"),
    )
    same = (F.col("own_window") == F.col("window")) & (F.col("own_size") == F.col("size"))
    return rows.join(windows, same, "left").select(
        *[f"key_{i}" for i in range(len(keys))], row, "n_words",
        F.when(F.col("items").isNotNull(), F.struct("at", F.col("own_size").alias("size"))).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _per_document(rows: DataFrame, keys: list[str], row: str, one_in: int) -> DataFrame:
    per_doc = rows.groupBy(row).agg(
        *[F.first(f"key_{i}").alias(f"key_{i}") for i in range(len(keys))],
        F.first("n_words").alias("n_words"),
        F.collect_list("hit").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    n_hit = _covered("hits").cast("long")
    per_doc = per_doc.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
        F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "hits",
    )
    return per_doc.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The documents that are not contaminated, all columns as they were.

    A verdict belongs to the pair of id and text, so rows that repeat both share it.
    """
    mark, same = spare("mark"), spare("same")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    bad = (
        contamination(docs.select("doc_id", "text").withColumn(mark, F.xxhash64("text")), benchmark, ["doc_id", mark], n, one_in)
        .filter("contaminated")
        .select(F.col("doc_id").alias(same), F.col(mark).alias(same + "_text"))
        .distinct()
    )
    bad = store(bad, "contaminated")
    bad = F.broadcast(bad) if fits_broadcast(bad) else bad
    match = F.col("doc_id").eqNullSafe(F.col(same)) & (F.col(mark) == F.col(same + "_text"))
    return marked.join(bad, match, "left_anti").drop(mark)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, text): the normalised words outside all hit windows, joined by spaces."""
    mark = spare("mark")
    hits = contamination(docs.select("doc_id", "text").withColumn(mark, F.col("text")), benchmark, ["doc_id", mark], n)
    kept = F.filter(words(mark), lambda w, i: ~F.exists("hits", lambda h: (i >= h["at"]) & (i < h["at"] + h["size"])))
    return hits.select("doc_id", F.array_join(kept, " ").alias("text"))
