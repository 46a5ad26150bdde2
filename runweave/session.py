"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it.

    Where the package is installed on the executors, or sent with --py-files, this adds a
    path that is not needed and does no harm.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
    return spark
