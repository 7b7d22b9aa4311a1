"""Stored results that later sessions find again by what they were computed from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raise when the meaning of a stored result changes, so that older ones are not found any more.
EDITION = 1


def table_version(df: DataFrame) -> str:
    """A digest of the files a table is read from: path, size and time of each, and its columns.

    One job that reads no column but the files' own; only three numbers come back. Raises ``ValueError``
    for a table that is not read from files, whose version the caller has to name.
    """
    meta = F.col("_metadata")
    try:
        files = df.select(
            meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("time")
        ).distinct()
    except AnalysisException as error:
        raise ValueError("the table is not read from files; name its version") from error
    one = F.xxhash64("path", "size", "time")
    n, total, mixed = files.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one)).first()
    return hashlib.sha256(json.dumps([df.schema.json(), n, str(total), mixed]).encode()).hexdigest()


class Catalogue:
    """Results in a folder that every executor can reach, by name and key.

    Each attempt to write one has a folder of its own and counts from the moment its ``_SUCCESS`` mark
    exists, which Spark writes last. Sessions that compute the same at once do no harm: the first complete
    folder in the order of names is read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _below(self, folder: str) -> list[str]:
        files = self._files(folder)
        if not files.exists(self._path(folder)):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(self._path(folder)))

    def find(self, name: str, key: str) -> str | None:
        """Where a complete result lies."""
        folder = f"{self.folder}/{name}/{key}"
        for attempt in self._below(folder):
            if self._files(folder).exists(self._path(f"{folder}/{attempt}/_SUCCESS")):
                return f"{folder}/{attempt}"
        return None

    def result(self, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored result; ``build`` is called only if there is none."""
        path = self.find(name, key)
        if path is None:
            path = f"{self.folder}/{name}/{key}/{uuid.uuid4().hex}"
            build().write.parquet(path)
        return self.spark.read.parquet(path)

    def keep_only(self, keys: Mapping[str, str]) -> list[str]:
        """Remove other keys of the named results, and return their folders. Nobody may be reading those."""
        gone = [f"{self.folder}/{name}/{own}" for name, key in keys.items() for own in self._below(f"{self.folder}/{name}") if own != key]
        for path in gone:
            self._files(path).delete(self._path(path), True)
        return gone
