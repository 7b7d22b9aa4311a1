"""Intermediate results as written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Texts take a third less room than with Spark's default.
COMPRESSION = "zstd"

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = context.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.TemporaryDirectory(prefix="flockmetrics-")
    return _local_folders[application].name


def store(df: DataFrame, name: str, laid_out_by: str | None = None) -> DataFrame:
    """Write ``df`` and return it as read back: lineage ends here and survives lost executors.

    With ``laid_out_by`` there is a folder per value of that column, with a file of each task that has rows
    of it: rows are written where they are, as dealing wide ones once more costs more than the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if laid_out_by:
        df.write.partitionBy(laid_out_by).parquet(path, compression=COMPRESSION)
    else:
        df.write.parquet(path, compression=COMPRESSION)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def store_bucketed(df: DataFrame, name: str, by: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table dealt by hash of ``by``: joins on that column read it without a shuffle.

    ``buckets`` defaults to the number of shuffle partitions, which the other side of a join then has too.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    # One task for each bucket, so there is one file for each.
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    stored.stored_at, stored.stored_as = path, table
    return stored


def remove(stored: DataFrame) -> None:
    """Delete what ``store`` wrote for this DataFrame; it and what builds on it cannot be read any more."""
    if hasattr(stored, "stored_as"):
        stored.sparkSession.sql(f"drop table if exists {stored.stored_as}")
    context = stored.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
