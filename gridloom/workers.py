"""Makes this package importable in Python workers of the same machine or of a cluster with a shared installation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' PYTHONPATH. Where the package comes by --py-files, this adds nothing of use and does no harm."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{known}:{ROOT}" if known else ROOT
