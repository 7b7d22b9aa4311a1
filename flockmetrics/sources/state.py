"""Derived tables that later runs build on: one folder for each version, valid once it is complete."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

_FORMAT = "%Y%m%dT%H%M%S%f"


@dataclass(frozen=True)
class Version:
    as_of: datetime
    path: str


class StateStore:
    """Versions of tables by name and instant under a folder that every executor can reach.

    A version counts from the moment its ``_SUCCESS`` mark exists, which Spark writes last; what a
    run that died has left behind is never read. The version before the newest stays for its readers.
    """

    def __init__(self, spark: SparkSession, folder: str, kept: int = 2) -> None:
        self.spark, self.folder, self.kept = spark, folder.rstrip("/"), kept

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[Version]:
        """Complete versions, oldest instant first."""
        folder = f"{self.folder}/{name}"
        files = self._files(folder)
        if not files.exists(self._path(folder)):
            return []
        found = []
        for status in files.listStatus(self._path(folder)):
            path = f"{folder}/{status.getPath().getName()}"
            if files.exists(self._path(f"{path}/_SUCCESS")):
                stamp = status.getPath().getName().removeprefix("as_of-").split("-")[0]
                found.append(Version(datetime.strptime(stamp, _FORMAT), path))
        return sorted(found, key=lambda v: (v.as_of, v.path))

    def latest(self, name: str, as_of: datetime) -> Version | None:
        """The newest version that is not of a later instant."""
        return next((v for v in reversed(self.versions(name)) if v.as_of <= as_of), None)

    def read(self, version: Version) -> DataFrame:
        return self.spark.read.parquet(version.path)

    def commit(self, name: str, df: DataFrame, as_of: datetime) -> DataFrame:
        """Write a version and return it as read back; versions that nothing builds on any more go."""
        version = Version(as_of, f"{self.folder}/{name}/as_of-{as_of:{_FORMAT}}-{uuid.uuid4().hex}")
        df.write.parquet(version.path)
        older = [v for v in self.versions(name) if v.as_of <= as_of and v.path != version.path]
        for old in older[: max(0, len(older) + 1 - self.kept)]:
            self._files(old.path).delete(self._path(old.path), True)
        return self.read(version)
