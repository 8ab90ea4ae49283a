"""Settings of scans, kept in the session's configuration under ``gridloom.``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.errors import BindError

#: name: (default, least, largest). Tasks already run in parallel, so a number of batches to read ahead is checked only.
NUMBERS = {
    "max_threads": (0, 0, 1 << 20),
    "remote_merge_gap": (4096, 0, 1 << 30),
    "remote_max_request": (65536, 512, 1 << 30),
    "async_prefetch_batches": (1, 1, 4),
    "async_max_inflight": (8, 1, 256),
}
FLAGS = {"remote_merge": True, "async_io": True, "revalidate_metadata": False}

#: Settings that Hadoop's vectored reads of Parquet follow: gaps up to which ranges are merged, the largest merged range,
#: ranges in flight, and whether ranges are merged at all. They are set for the session's reads.
HADOOP = {
    "remote_merge_gap": "fs.s3a.vectored.read.min.seek.size",
    "remote_max_request": "fs.s3a.vectored.read.max.merged.size",
    "async_max_inflight": "fs.s3a.vectored.active.ranged.reads",
    "remote_merge": "parquet.hadoop.vectored.io.enabled",
}


def put(spark: SparkSession, name: str, value: int | bool) -> None:
    """Sets a setting after checking it."""
    if name in NUMBERS:
        _, least, largest = NUMBERS[name]
        if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= largest:
            raise BindError("setting", f"{name} must lie in {least} to {largest}")
    elif name not in FLAGS:
        raise BindError("setting", f"{name} is unknown")
    elif not isinstance(value, bool):
        raise BindError("setting", f"{name} must be true or false")
    spark.conf.set(f"gridloom.{name}", str(value).lower())
    if name in HADOOP:
        spark.conf.set(HADOOP[name], str(value).lower())


def get(spark: SparkSession, name: str) -> int | bool:
    """The setting, or its default."""
    said = spark.conf.get(f"gridloom.{name}", None)
    if name in FLAGS:
        return FLAGS[name] if said is None else said == "true"
    return NUMBERS[name][0] if said is None else int(said)
