"""Where Python workers find the library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def send(spark: SparkSession) -> None:
    """Put the folder of the library on the path of Python workers that start from now on.

    It serves sessions whose executors see this folder and were started without it on their path;
    others get the library in Spark's usual ways, such as ``--py-files``.
    """
    folder = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in known:
        env["PYTHONPATH"] = os.pathsep.join([folder, *known])
