"""Token counts as delta-maintained rollups.

A store keeps, for each batch of changes, the signed totals it added by source, language and
tokenizer version, and the count of each document it touched. A batch inserts, revises or deletes
documents; what it takes away is what the store last knew of them, so totals never need a second
look at old texts. Committing a batch again replaces it and nothing else, and a batch that was not
committed in full is not seen: its folder counts only with the mark that is written last.

Layout in the shared folder::

    documents/batch=N   doc_id, version, source, lang, n_docs (1 or 0), tokens: the state after N
    totals/batch=N      source, lang, version, docs, tokens: what N added, deletions negative
    commits/batch=N     one empty table, written last

Defined results: a null text has no tokens but is a document; null sources and languages are groups
of their own; of several changes of one document in a batch the last by ``seq`` counts (of equal
ones a deletion, then the most tokens); deleting what is unknown changes nothing; rows with a null
id count as the document without id; an empty batch commits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "version")
_STATE = "doc_id long, version string, source string, lang string, n_docs int, tokens long"
_TOTALS = "source string, lang string, version string, docs long, tokens long"

#: Tokenizer versions that are expressions: runs of non-space, and word, digit and sign pieces.
WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]+"


def pattern_tokens(pattern: str, text: str = "text") -> Column:
    """Number of matches in the text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollups:
    """Totals under ``folder``, kept up by batches of changes with increasing numbers."""

    def __init__(self, spark: SparkSession, folder: str, versions: Mapping[str, Column]):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), dict(versions)

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def batches(self) -> list[int]:
        """Numbers of the committed batches, a short list of folders."""
        files, path = self._files("commits")
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        marked = [name for name in names if files.exists(self._files(f"commits/{name}/_SUCCESS")[1])]
        return sorted(int(name.removeprefix("batch=")) for name in marked)

    def _files(self, name: str):
        """The file system, and a path on it."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _read(self, table: str, schema: str, below: int | None = None) -> DataFrame:
        numbers = [b for b in self.batches() if below is None or b < below]
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        paths = [self._path(table, b) for b in numbers]
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def state(self, below: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """What is known of each document and version: before batch ``below``, of ``touched`` only, if given."""
        rows = self._read("documents", _STATE, below)
        if touched is not None:
            # Old states that the batch does not touch are left before anything is shuffled by group.
            same = rows["doc_id"].eqNullSafe(touched["doc_id"]) & (rows["version"] == touched["version"])
            rows = rows.join(touched, same, "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_docs", "tokens"), "batch").alias("last")
        return rows.groupBy("doc_id", "version").agg(last).select("doc_id", "version", "last.*")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply (doc_id, op, source, lang, text, seq), where op is ``upsert`` or ``delete``.

        Batches come in order; one that was committed may come again as long as it is the last.
        """
        done = self.batches()
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        if batch in done:
            # Without its mark the batch is not seen until it is whole again.
            files, path = self._files(f"commits/batch={batch}")
            files.delete(path, True)
        live = F.col("op") != "delete"
        counted = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), "seq", "source", "lang",
            live.cast("int").alias("n_docs"),
            F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.when(live, n).otherwise(F.lit(0)).alias("tokens")) for v, n in self.versions.items()])),
        )
        # A document with very many changes in one batch is combined before it is shuffled.
        last = F.max(F.struct("seq", (-F.col("n_docs")).alias("gone"), "tokens", "source", "lang", "n_docs")).alias("last")
        new = counted.groupBy("doc_id", "version").agg(last).select(
            "doc_id", "version", "last.source", "last.lang", "last.n_docs", F.col("last.tokens").cast("long").alias("tokens")
        )
        new.write.mode("overwrite").parquet(self._path("documents", batch))
        new = self.spark.read.schema(_STATE).parquet(self._path("documents", batch))
        taken = self.state(batch, new.select("doc_id", "version")).select(
            *GROUP, (-F.col("n_docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
        )
        given = new.select(*GROUP, F.col("n_docs").alias("docs"), "tokens")
        change = taken.unionByName(given).groupBy(*GROUP).agg(
            F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")
        )
        change.filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(self._path("totals", batch))
        self.spark.createDataFrame([], "batch long").write.mode("overwrite").parquet(self._path("commits", batch))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: the sum of all committed batches, empty groups left out."""
        sums = self._read("totals", _TOTALS).groupBy(*GROUP).agg(
            F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")
        )
        return sums.filter(F.col("docs") > 0)

    def drift(self) -> DataFrame:
        """Groups whose totals differ from a recount of the state: none, if all is well."""
        again = self.state().filter("n_docs > 0").groupBy(*GROUP).agg(F.count("*").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        return self.totals().exceptAll(again).unionByName(again.exceptAll(self.totals()))
