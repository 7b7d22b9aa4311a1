"""Nearest vectors by inner product: multiprobe p-stable hashing and exact reranking.

1. Equal vectors become one class with its first k + 1 rows by id; more of them are never among the
   k nearest, so copies cost one row and ties between them are settled here.
2. Vectors are scaled into bands of norms, a factor of two each, and get one more coordinate that
   makes their length one. The query gets length one and a zero there, so within a band the largest
   inner product is the smallest Euclidean distance, which p-stable hashes are made for.
3. ``tables`` tables hash a vector to the cells of ``functions`` random projections, each ``width``
   wide. A query visits, in every table, its own bucket and those one cell off in some functions, in
   order of estimated success: by the sum of squared distances to the cell walls that are crossed.
4. How many buckets are visited is measured on the data: for at most ``SAMPLE`` queries, chosen by
   hash, the exact nearest are found by comparing them with all vectors, and buckets are visited up
   to the place in the order at which the share ``recall`` of those is met.
5. Buckets are dealt into groups of bounded size; a bucket larger than a group is cut into pieces.
   A query goes once to every group that holds buckets it visits, and takes its best of the
   candidates of all tables there by exact inner products in double precision. Best lists are merged.
6. A query that has met fewer than k candidates is compared with every vector.

Defined results: null, empty, zero and not finite vectors take no part; vectors of unlike length are
not compared; rows that repeat an id are rows of their own and see each other; a null id is never a
query and comes last among ties; extra columns are not read; an empty table has no results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockmetrics.llm.scratch import Scratch
from flockmetrics.llm.texts import mixed
from flockmetrics.operators.joins import fits_broadcast, heavy_key_join

TABLES, FUNCTIONS, WIDTH = 4, 8, 2.5
RECALL = 0.95
SAMPLE = 200
SEED = 11
GROUP_BYTES, LEAST_GROUPS = 32 << 20, 12
_BLOCK = 128
_ROW = "g long, kind int, id long, v array<double>, bucket long, buckets array<long>, members array<struct<vec_id:long,key:long>>"


@lru_cache(maxsize=16)
def _projections(dim: int, tables: int, functions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim + 1, tables * functions)) / width, rng.uniform(size=tables * functions)


@lru_cache(maxsize=4)
def _perturbations(functions: int) -> tuple[np.ndarray, np.ndarray]:
    """All steps of -1, 0 and 1 per function, and which lower and upper walls each crosses."""
    steps = np.array(list(itertools.product((0, -1, 1), repeat=functions)), np.int64)
    return steps, np.hstack([steps == -1, steps == 1]).astype(np.float64)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _cells(x: np.ndarray, last: np.ndarray, tables: int, functions: int, width: float) -> np.ndarray:
    """Projections in units of cells: (rows, tables, functions)."""
    a, b = _projections(x.shape[1], tables, functions, width)
    return (np.hstack([x, last[:, None]]) @ a + b).reshape(len(x), tables, functions)


def _buckets(cells: np.ndarray, table: int, band: np.ndarray, dim: int) -> np.ndarray:
    """64-bit names of buckets; that two share one makes a bucket larger, no more."""
    name = mixed(np.uint64(dim) * np.uint64(1_000_003) + np.uint64(table + 1) + (band.astype(np.int64).view(np.uint64) << np.uint64(32)))
    for column in cells.T:
        name = mixed(name ^ (column.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return name.view(np.int64)


def _banded(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors at the scale of their band, the coordinate that makes them long, and the band."""
    # Norms of very long and very short vectors neither overflow nor vanish.
    peak = np.abs(x).max(axis=1)
    log_norm = np.log2(peak) + 0.5 * np.log2(((x / peak[:, None]) ** 2).sum(axis=1))
    band = np.maximum(np.floor(most - log_norm), 0)
    scaled = (x / peak[:, None]) * np.exp2(np.log2(peak) - most + band)[:, None]
    return scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1))), band.astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _filed(classes: DataFrame, most: float, tables: int, functions: int, width: float) -> DataFrame:
    """(bucket, nth, band, id, v, members): every class in one bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _lists(batch.column("v")):
                scaled, last, band = _banded(x, most)
                cells = np.floor(_cells(scaled, last, tables, functions, width)).astype(np.int64)
                part = batch.take(pa.array(rows))
                for table in range(tables):
                    found = [pa.array(_buckets(cells[:, table], table, band, x.shape[1])), pa.array(np.full(len(rows), table, np.int32)), pa.array(band)]
                    yield pa.RecordBatch.from_arrays([*found, *part.columns], names=["bucket", "nth", "band", "id", "v", "members"])

    return classes.select("id", "v", "members").mapInArrow(
        run, "bucket long, nth int, band long, id long, v array<double>, members array<struct<vec_id:long,key:long>>"
    )


def _order(cells: np.ndarray, functions: int) -> np.ndarray:
    """Score of every perturbation for each row of one table: smaller is more likely to succeed."""
    part = cells - np.floor(cells)
    return np.hstack([part**2, (1 - part) ** 2]) @ _perturbations(functions)[1].T


def _probes(queries: DataFrame, bands: list[int], visits: int, tables: int, functions: int, width: float) -> DataFrame:
    """(id, bucket): the ``visits`` buckets of each table and band most likely to hold what is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, _ = _perturbations(functions)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, x in _lists(batch.column("v")):
                for some in np.array_split(np.arange(len(rows)), len(rows) // _BLOCK + 1):
                    cells = _cells(_unit(x[some]), np.zeros(len(some)), tables, functions, width)
                    for table in range(tables):
                        score = _order(cells[:, table], functions)
                        first = np.argpartition(score, visits - 1, axis=1)[:, :visits] if visits < len(steps) else np.tile(np.arange(len(steps)), (len(some), 1))
                        near = (np.floor(cells[:, table]).astype(np.int64)[:, None, :] + steps[first]).reshape(-1, functions)
                        for band in bands:
                            name = _buckets(near, table, np.full(len(near), band), x.shape[1])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(ids[rows[some]], first.shape[1])), pa.array(name)], names=["id", "bucket"]
                            )

    return queries.select("id", "v").mapInArrow(run, "id long, bucket long")


class _Group:
    """The classes of one group, of one length, and the best of them for blocks of queries."""

    def __init__(self, ids: list, buckets: list, vectors: list, members: list) -> None:
        ids, buckets, x = np.concatenate(ids), np.concatenate(buckets), np.concatenate(vectors)
        self.ids, first, place = np.unique(ids, return_index=True, return_inverse=True)
        self.x = x[first]
        # One row per class and bucket, by class.
        by_class = np.argsort(place, kind="stable")
        self.starts = np.searchsorted(place[by_class], np.arange(len(self.ids)))
        self.known, self.local = np.unique(buckets[by_class], return_inverse=True)
        every = pa.concat_arrays(members).take(pa.array(first))
        self.sizes = every.value_lengths().to_numpy(zero_copy_only=False)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        flat = every.flatten()
        vec_id = flat.field("vec_id")
        self.no_id = vec_id.is_null().to_numpy(zero_copy_only=False)
        self.vec_id = vec_id.fill_null(0).to_numpy(zero_copy_only=False)
        self.key = flat.field("key").to_numpy(zero_copy_only=False)
        self.longest = np.sqrt((self.x**2).sum(axis=1).max())

    def best(self, queries: np.ndarray, visited: list[np.ndarray | None], k: int) -> tuple[np.ndarray, ...]:
        """(query, class, member) numbers and score of the first k rows of every query."""
        met = np.zeros((len(queries), len(self.known)), bool)
        for row, buckets in zip(met, visited, strict=True):
            if buckets is None:
                row[:] = True
            else:
                at = np.searchsorted(self.known, buckets)
                at = at[at < len(self.known)]
                row[at[np.isin(self.known[at], buckets)]] = True
        # A candidate of several tables is one.
        candidate = np.logical_or.reduceat(met[:, self.local], self.starts, axis=1)
        score = np.where(candidate, queries @ self.x.T, -np.inf)
        if score.shape[1] > k:
            least = np.partition(score, -k, axis=1)[:, -k]
            # Products of blocks may differ in the last bits from those of single rows: ties are kept and settled below.
            slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * self.longest
            candidate &= score >= (least - slack)[:, None]
        q, c = np.nonzero(candidate)
        exact = np.concatenate([(queries[q[i : i + 65_536]] * self.x[c[i : i + 65_536]]).sum(axis=1) for i in range(0, len(q), 65_536)] or [np.zeros(0)])
        times = self.sizes[c]
        member = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.offsets[c], times)
        q, c, exact = np.repeat(q, times), np.repeat(c, times), np.repeat(exact, times)
        order = np.lexsort((self.key[member], self.vec_id[member], self.no_id[member], -exact, q))
        q, c, member, exact = q[order], c[order], member[order], exact[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < k
        return q[keep], c[keep], member[keep], exact[keep]


def _search(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """(q, id, key, vec_id, score): for every query and group its k best candidates there.

    ``rows`` has the schema ``_ROW``: classes (kind 0) and queries (kind 1) by group; a query
    without a list of buckets takes all. Queries pass in blocks, classes of one group are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: dict[int, tuple[list, list, list, list]] = {}
        ready: dict[int, _Group] = {}
        for batch in batches:
            g = batch.column("g").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(g)], strict=True):
                if start == end:
                    continue
                if g[start] != at:
                    at, held, ready = g[start], {}, {}
                part = batch.slice(start, end - start)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for number, x in _lists(part.column("v")):
                    dim = x.shape[1]
                    if kind[start] == 0:
                        lists = held.setdefault(dim, ([], [], [], []))
                        lists[0].append(ids[number])
                        lists[1].append(part.column("bucket").to_numpy(zero_copy_only=False)[number])
                        lists[2].append(x)
                        lists[3].append(part.column("members").take(pa.array(number)))
                        continue
                    if dim in held:
                        ready[dim] = _Group(*held.pop(dim))
                    group = ready.get(dim)
                    if group is None:
                        continue
                    buckets = part.column("buckets")
                    for some in np.array_split(np.arange(len(number)), len(number) // _BLOCK + 1):
                        visited = [None if not b.is_valid else b.values.to_numpy(zero_copy_only=False) for b in (buckets[int(i)] for i in number[some])]
                        q, c, member, score = group.best(x[some], visited, k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[number[some]][q]), pa.array(group.ids[c]), pa.array(group.key[member]),
                             pa.array(group.vec_id[member], mask=group.no_id[member]), pa.array(score)],
                            names=["q", "id", "key", "vec_id", "score"],
                        )

    dealt = rows.repartition(parts, "g").sortWithinPartitions("g", "kind")
    return dealt.mapInArrow(run, "q long, id long, key long, vec_id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    """(q, best): k different rows of each query, nearest first, from the lists of all groups."""
    # What several tables have met has the same score everywhere.
    different = found.groupBy("q", "key").agg(F.first("id").alias("id"), F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("key")))
    first = different.withColumn("place", place).filter(F.col("place") <= k)
    return first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "id", "key", "vec_id", "score"))).alias("best"))


def _visits(pairs: list, most: float, recall: float, tables: int, functions: int, width: float) -> int:
    """Place in the order of buckets up to which the share ``recall`` of true neighbours is met in some table."""
    steps, _ = _perturbations(functions)
    power = 3 ** np.arange(functions)[::-1]
    places = []
    for query, found in pairs:
        x = np.array(found)
        scaled, last, _ = _banded(x, most)
        cells = np.floor(_cells(scaled, last, tables, functions, width)).astype(np.int64)
        own = _cells(_unit(np.array([query])), np.zeros(1), tables, functions, width)[0]
        place = np.full(len(x), len(steps))
        for table in range(tables):
            rank = np.argsort(np.argsort(_order(own[table][None], functions)[0], kind="stable"))
            step = cells[:, table] - np.floor(own[table]).astype(np.int64)
            near = (np.abs(step) <= 1).all(axis=1)
            number = np.where(step == -1, 1, np.where(step == 1, 2, 0)) @ power
            place[near] = np.minimum(place[near], rank[number[near]])
        places.append(place)
    if not places:
        return 1
    places = np.sort(np.concatenate(places))
    return int(min(places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1, len(steps)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    column: str = "embedding",
    tables: int = TABLES,
    functions: int = FUNCTIONS,
    width: float = WIDTH,
    recall: float = RECALL,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` holds for."""
    scratch = Scratch()
    v = F.col(column).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Written, so that a row's key is the same to every reader.
    rows = scratch.store(
        vectors.filter(usable).select(
            F.monotonically_increasing_id().alias("key"), F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
        ),
        "vectors",
    )
    by_id = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), F.asc("key"))
    leading = rows.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
    member = F.struct("nth", "vec_id", "key")
    members = leading.groupBy("v").agg(F.sort_array(F.collect_list(member)).alias("m"))
    classes = scratch.store(
        members.select(F.col("m")[0]["key"].alias("id"), "v", F.transform("m", lambda m: F.struct(m["vec_id"].alias("vec_id"), m["key"].alias("key"))).alias("members")),
        "vector-classes",
    )
    of_class = classes.select("v", F.col("id").alias("q"))
    asking = rows.filter("asks").select("v", "key", F.col("vec_id").alias("query_id"))
    asked = scratch.store(heavy_key_join(asking, of_class, "v", "inner", ["key"]).select("key", "query_id", "q"), "asking-rows")
    queries = scratch.store(asked.select(F.col("q").alias("id")).distinct().join(classes.select("id", "v"), "id"), "queries")

    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    # An upper bound where squares overflow or vanish.
    bound = F.log2(F.array_max(F.transform("v", F.abs))) + 0.5 * F.log2(F.size("v"))
    log_norm = F.when(squares.between(1e-250, 1e250), 0.5 * F.log2(squares)).otherwise(bound)
    most, total, cells = classes.agg(F.max(log_norm), F.sum(F.size("members")), F.sum(F.size("v"))).first()
    if most is None:
        return scratch.result(asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")), "neighbours")
    # The longest vector lies at the edge of its band, not beyond it.
    most = most + 1e-9

    # Every query has a list from every group it visits, so groups follow the data and not the cluster.
    groups = max(LEAST_GROUPS, -(-tables * cells * 8 // group_bytes))
    full = max(1, group_bytes * total // (8 * cells))
    filed = scratch.store(_filed(classes, most, tables, functions, width), "buckets")
    # At most one band for each power of two that a double may have.
    bands = [row.band for row in filed.filter("nth = 0").select("band").distinct().collect()]
    crowded = scratch.store(
        filed.groupBy("bucket").count().filter(F.col("count") > full).select("bucket", F.ceil(F.col("count") / full).cast("int").alias("pieces")), "crowded-buckets"
    )
    known = F.broadcast(crowded) if fits_broadcast(crowded) else crowded
    one = F.coalesce("pieces", F.lit(1))

    def group(piece: Column) -> Column:
        return F.pmod(F.xxhash64("bucket", piece), F.lit(groups)).alias("g")

    data = filed.join(known, "bucket", "left").select(
        group(F.pmod(F.xxhash64("id"), one).cast("int")), F.lit(0).alias("kind"), "id", "v", "bucket", F.lit(None).cast("array<long>").alias("buckets"), "members", "nth"
    )

    def asking_rows(probes: DataFrame) -> DataFrame:
        vector = queries.select("id", "v")
        return probes.join(vector, "id").select(
            "g", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("long").alias("bucket"), "buckets",
            F.lit(None).cast("array<struct<vec_id:long,key:long>>").alias("members"),
        )

    def against_all(some: DataFrame) -> DataFrame:
        """Lists of some queries over all classes, which the first table holds once."""
        everywhere = some.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(None).cast("array<long>").alias("buckets"))
        return _first(_search(data.filter("nth = 0").drop("nth").unionByName(asking_rows(everywhere)), k + 1, groups), k + 1)

    # A bounded sample: its queries, their neighbours and the vectors of both go to the driver.
    sample = scratch.store(queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "sample")
    true = against_all(sample.select("id")).select("q", F.explode("best.id").alias("id")).filter("q <> id").distinct()
    found = true.join(classes.select("id", "v"), "id").groupBy("q").agg(F.collect_list("v").alias("found"))
    pairs = [(r.v, r.found) for r in sample.join(found, F.col("q") == F.col("id")).select(sample["v"], "found").collect()]
    visits = _visits(pairs, most, recall, tables, functions, width)

    probes = _probes(queries, bands, visits, tables, functions, width).join(known, "bucket", "left")
    pieces = probes.select("id", "bucket", F.explode(F.sequence(F.lit(0), one - 1)).alias("piece"))
    dealt = pieces.select("id", "bucket", group(F.col("piece"))).groupBy("id", "g").agg(F.collect_set("bucket").alias("buckets"))
    lists = scratch.store(_first(_search(data.drop("nth").unionByName(asking_rows(dealt)), k + 1, groups), k + 1), "nearest")
    short = scratch.store(
        queries.select("id").join(lists, F.col("id") == F.col("q"), "left").filter(F.coalesce(F.size("best"), F.lit(0)) < min(k + 1, total)).select("id"), "short"
    )
    if not short.isEmpty():
        lists = lists.join(short, F.col("q") == F.col("id"), "left_anti").unionByName(against_all(short))

    # The list of a class holds one row more than asked for: a row that asks leaves itself out.
    answered = heavy_key_join(asked, lists, "q", "inner", ["key"])
    others = F.slice(F.filter("best", lambda b: b["key"] != F.col("key")), 1, k)
    return scratch.result(
        answered.select("query_id", F.posexplode(others).alias("pos", "hit")).select(
            "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
        ),
        "neighbours",
    )
