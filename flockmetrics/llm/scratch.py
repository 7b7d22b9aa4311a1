"""Tables that an operator writes on its way to a result, and their end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flockmetrics.sources.stored import remove, store


class Scratch:
    """Intermediate tables in the shared folder. ``result`` writes the last one and removes the others."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        table = store(df, name)
        self._tables.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(table)
            self._tables = [t for t in self._tables if t is not table]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        table = store(df, name)
        self.drop(*self._tables)
        return table
