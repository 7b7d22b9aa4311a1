"""Small reference tables delivered as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STOPWORDS_SCHEMA = T.StructType([T.StructField("stopwords", T.StringType())])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header line; every column is text unless a schema says otherwise.

    Quotes in a field are doubled, fields may hold line breaks, a backslash is itself, and a
    byte-order mark is no part of the first name. As a line break may be inside a field, a file
    is one task; files stay below 200 MB, a larger table is a folder of them, each with the header. A row that does not fit the header raises.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*[name.lstrip("\ufeff") for name in rows.columns])


def table_name(file_name: str) -> str:
    """``My List.v2.csv`` becomes ``my_list``."""
    return file_name.split(".")[0].lower().replace(" ", "_")


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files directly in a folder, and of folders named like one, whose files are the parts of one table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath() for status in files.listStatus(path)]
    return sorted(p.toString() for p in names if p.getName().endswith(".csv") and not p.getName().startswith(("_", ".")))


def register_csv_folder(spark: SparkSession, folder: str, permanent: bool = False) -> dict[str, DataFrame]:
    """Every CSV file of a folder, or sub-folder ``*.csv`` of part files, as a view, or table of the catalog, named after it; other files
    are left alone. Files whose names come to the same table raise."""
    paths: dict[str, str] = {}
    for path in csv_files(spark, folder):
        name = table_name(path.rsplit("/", 1)[-1])
        if name in paths:
            raise ValueError(f"{paths[name]} and {path} would both become table {name}")
        paths[name] = path
    tables = {}
    for name, path in paths.items():
        rows = read_csv_table(spark, path)
        if permanent:
            rows.write.mode("overwrite").saveAsTable(name)
        else:
            rows.createOrReplaceTempView(name)
        tables[name] = spark.table(name)
    return tables
