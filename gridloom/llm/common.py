"""Shared helpers: places that every executor sees, materialised tables, Arrow batch mapping.

Files and intermediate tables go below ``spark.checkpoint.dir``, the folder that the cluster shares. Where the session
has none, a local master (tests, a laptop) gets a temporary folder, once for the session; a cluster raises.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.workers import importable

#: Rows in one Arrow batch handed to Python. Texts vary from bytes to megabytes, so batches are kept short.
BATCH_ROWS = 256


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of Python stages by rows and by bytes, for memory; sees to it that workers find this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors and the driver see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root; writers create it."""
    return f"{shared_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back. Cuts the lineage, survives lost executors, and lets later
    joins start from exchanges that adaptive execution can split when one key is hot.

    ``narrow`` is for tables of a few numbers a row: they are written by two tasks for each core of the cluster at most,
    each taking its partitions one after another, so that a chain of such tables is not one of thousands of tiny files.
    """
    spark = session_of(df)
    path = new_folder(spark, name)
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame | str) -> None:
    """Deletes a table of materialize() that no later result reads."""
    path = df if isinstance(df, str) else getattr(df, "_gridloom_path", None)
    if path is None:
        return
    spark = SparkSession.active()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> str:
    """Creates a folder through Hadoop's file systems and returns its name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


#: By the module of an operator, how a worker drops what it remembers from task to task.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Registers an operator whose workers remember something from task to task, until they get a task of another one."""
    _FORGET[module] = forget


def forget_others(module: str) -> None:
    """Drops what this worker remembers of other operators: workers outlive a stage, and an executor's memory is for one."""
    for other, forget in _FORGET.items():
        if other != module:
            forget()


def give_back() -> None:
    """Returns freed memory to the system. Else allocators keep it, and a worker holds the most that any task before took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over short batches. Before it, a worker drops what it remembers of other operators; after it, memory goes
    back to the system."""
    short_batches(session_of(df))
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(module)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Every text; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
