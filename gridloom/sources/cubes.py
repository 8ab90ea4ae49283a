"""Sources of cells: chunk tables in Parquet, and dense tables seen as cubes.

A chunk table has one row for each chunk: its offsets and extents along the axes, and one array of values for each
variable. Parquet then reads only the arrays of variables that a query uses, skips row groups outside a range of
offsets, and counts cells from the extents alone. Cells come from the chunk's own cell count, so a row for every cell is
made inside one generated stage, without a shuffle.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import SourceError
from gridloom.plans import settings
from gridloom.plans.meta import CubeMeta, Variable, column_name
from gridloom.plans.select import Range
from gridloom.sources.paths import check_object, exists, redacted, version


#: Ranges of one axis in a condition, and those of the first axis, which go to the scan; more become one.
MAX_SPANS, MAX_PUSHED = 256, 32


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class ChunkCube:
    """A cube written by write_cube()."""

    spark: SparkSession
    path: str
    meta: CubeMeta = field(init=False)

    def __post_init__(self) -> None:
        self.path = check_object(self.path)
        self.meta = self._read_meta()
        self._seen = version(self.spark, self.path) if settings.get(self.spark, "revalidate_metadata") else None

    def _read_meta(self) -> CubeMeta:
        if not exists(self.spark, f"{self.path}/meta"):
            raise SourceError("object_not_found", f"there is no cube at {redacted(self.path)}")
        said = json.loads(self.spark.read.text(f"{self.path}/meta", wholetext=True).first()[0])
        if said.get("format") != 1:
            raise SourceError("format", f"{redacted(self.path)} has another format")
        variables = tuple(Variable(v["path"], tuple(v["shape"]), tuple(v["chunks"]), tuple(v["axes"]) if v["axes"] else None) for v in said["variables"])
        return CubeMeta(variables, said["crs_wkt"], tuple(said["times"]) if said["times"] is not None else None, self.path, said.get("attributes", {}))

    def cells(self, meta: CubeMeta, ranges: dict[int, list[Range]] | None = None) -> DataFrame:
        """(logical_index, variables) of the cells in chunks that the ranges touch."""
        if self._seen is not None and version(self.spark, self.path) != self._seen:
            raise SourceError("object_changed", f"{redacted(self.path)} was written anew since it was opened")
        chunks = self.spark.read.parquet(f"{self.path}/chunks")
        if threads := settings.get(self.spark, "max_threads"):
            chunks = chunks.coalesce(threads)
        sizes = meta.variables[0].chunks
        for axis, listed in (ranges or {}).items():
            chunks = chunks.where(_touched(F.col(f"off_{axis}"), listed, sizes[axis]))
        count = F.lit(1).cast("long")
        for k in range(len(meta.shape)):
            count = count * F.col(f"cnt_{k}")
        every = chunks.withColumn("_pos", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        index, step = F.lit(0).cast("long"), F.lit(1).cast("long")
        for k, stride in reversed(list(enumerate(meta.strides()))):
            index = index + (F.col(f"off_{k}") + F.call_function("div", F.col("_pos"), step) % F.col(f"cnt_{k}")) * stride
            step = step * F.col(f"cnt_{k}")
        values = [_col(n)[F.col("_pos").cast("int")].alias(n) for n in meta.names]
        return every.select(index.alias("logical_index"), *values)

    def index(self, meta: CubeMeta) -> DataFrame:
        """(logical_index) of all cells, without reading any."""
        return self.spark.range(meta.rows).select(F.col("id").alias("logical_index"))


def _touched(offset: Column, ranges: list[Range], size: int) -> Column:
    """Chunks by offset; ranges grow to whole chunks and are joined, so that few conditions remain."""
    spans: list[Range] = []
    for a, b in ranges:
        low, high = a // size * size, b // size * size
        if spans and low <= spans[-1][1] + size:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
    if len(spans) > 256:
        spans = [(spans[0][0], spans[-1][1])]
    out = F.lit(False)
    for low, high in spans:
        out = out | offset.between(low, high) if spans[0] != (low, high) else offset.between(low, high)
    return out


@dataclass
class TableCube:
    """A dense table as a cube: ``index`` gives each row's place, row-major over ``shape``."""

    df: DataFrame
    index: Column
    values: dict[str, Column]
    shape: tuple[int, ...]
    axes: tuple[str, ...] | None = None
    times: tuple[int, ...] | None = None
    identity: str = "table"

    def __post_init__(self) -> None:
        variables = tuple(Variable("/" + n if n != "value" else "", tuple(self.shape), tuple(self.shape), self.axes) for n in self.values)
        self.meta = CubeMeta(variables, None, self.times, self.identity)

    def cells(self, meta: CubeMeta, ranges: dict[int, list[Range]] | None = None) -> DataFrame:
        """The rows whose axis indices lie in the ranges. Those of the first axis, and the bounds that all axes together set,
        are plain comparisons of the index, which reach the scan of a table that stores it."""
        place = self.index.cast("long")
        rows = self.df.select(place.alias("logical_index"), *(self.values[n].cast("float").alias(n) for n in meta.names))
        ranges, strides, index = ranges or {}, meta.strides(), F.col("logical_index")
        if any(not listed for listed in ranges.values()):
            return rows.where(F.lit(False))
        if ranges:
            least, most = (sum((ranges[k][end][end] if k in ranges else (n - 1) * -end) * s for k, (n, s) in enumerate(zip(meta.shape, strides, strict=True))) for end in (0, -1))
            rows = rows.where(index.between(least, most))
        for axis, listed in ranges.items():
            spans = listed if len(listed) <= (MAX_PUSHED if axis == 0 else MAX_SPANS) else [(listed[0][0], listed[-1][1])]
            if axis == 0:
                rows = rows.where(reduce(or_, (index.between(low * strides[0], (high + 1) * strides[0] - 1) for low, high in spans)))
            else:
                at = F.call_function("div", index, F.lit(strides[axis])) % meta.shape[axis]
                rows = rows.where(reduce(or_, (at.between(low, high) for low, high in spans)))
        return rows


def chunk_rows(arrays: dict[str, np.ndarray], chunks: tuple[int, ...]):
    """A row for every chunk of small arrays that the driver holds."""
    shape = next(iter(arrays.values())).shape
    for at in itertools.product(*(range(0, n, c) for n, c in zip(shape, chunks, strict=True))):
        part = tuple(slice(a, min(a + c, n)) for a, c, n in zip(at, chunks, shape, strict=True))
        sizes = [s.stop - s.start for s in part]
        yield (*at, *sizes, *(np.ascontiguousarray(v[part], np.float32).ravel() for v in arrays.values()))


def _meta_json(variables: list[Variable], crs_wkt, times, attributes) -> str:
    return json.dumps({"format": 1, "variables": [asdict(v) for v in variables], "crs_wkt": crs_wkt, "times": times, "attributes": attributes or {}})


def write_cube(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], chunks: tuple[int, ...] | None = None, axes: tuple[str, ...] | None = None, crs_wkt: str | None = None, times: tuple[int, ...] | None = None, attributes: dict | None = None) -> str:
    """Writes arrays of equal shape that the driver holds; keys are paths, "" for the root array."""
    path = check_object(path)
    shape = next(iter(arrays.values())).shape
    chunks = tuple(chunks or shape)
    variables = [Variable(p, tuple(a.shape), chunks, tuple(axes) if axes else None) for p, a in arrays.items()]
    CubeMeta(tuple(variables), crs_wkt, times)
    names = [column_name(p) for p in arrays]
    rank = len(shape)
    columns = [*(f"off_{k}" for k in range(rank)), *(f"cnt_{k}" for k in range(rank)), *names]
    kinds = [pa.int64()] * (2 * rank) + [pa.list_(pa.float32())] * len(names)
    rows = zip(*chunk_rows(arrays, chunks), strict=True)
    table = pa.table([pa.array(list(v), k) for v, k in zip(rows, kinds, strict=True)], names=columns)
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/chunks")
    spark.createDataFrame([(_meta_json(variables, crs_wkt, times, attributes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def write_cells(cells: DataFrame, path: str, shape: tuple[int, ...], chunks: tuple[int, ...], values: list[str], axes: tuple[str, ...] | None = None, crs_wkt: str | None = None, times: tuple[int, ...] | None = None) -> str:
    """Writes a table (logical_index, values) as a cube of any size. A chunk's cells meet in one task: a chunk is bounded
    by its shape. Cells that the table lacks are NaN; of repeated cells the one with the largest values stays."""
    spark = cells.sparkSession
    variables = [Variable("" if v == "value" else "/" + v, tuple(shape), tuple(chunks), axes) for v in values]
    meta = CubeMeta(tuple(variables), crs_wkt, times)
    offsets, inner, extents = [], F.lit(0).cast("long"), []
    for k, (stride, n, c) in enumerate(zip(meta.strides(), shape, chunks, strict=True)):
        at = F.call_function("div", F.col("logical_index"), F.lit(stride)) % n
        offsets.append((at - at % c).alias(f"off_{k}"))
        extents.append(F.least(F.lit(c).cast("long"), F.lit(n) - F.col(f"off_{k}")).alias(f"cnt_{k}"))
        inner = inner * F.least(F.lit(c).cast("long"), F.lit(n) - (at - at % c)) + at % c
    placed = cells.select(*offsets, inner.alias("_pos"), F.struct(*(_col(v).cast("float").alias(f"v{i}") for i, v in enumerate(values))).alias("v"))
    names = [f"off_{k}" for k in range(len(shape))]
    # one exchange by chunk serves both groupings; cells are sorted by place, with NaN in the places that lack one
    single = placed.repartition(*names).groupBy(*names, "_pos").agg(F.max("v").alias("v"))
    found = single.groupBy(*names).agg(F.collect_list(F.struct("_pos", "v")).alias("_c")).select(*names, *extents, "_c")
    count = F.lit(1).cast("long")
    for k in range(len(shape)):
        count = count * F.col(f"cnt_{k}")
    nothing = F.struct(*(F.lit(float("nan")).cast("float").alias(f"v{i}") for i in range(len(values))))
    holes = F.array_except(F.sequence(F.lit(0).cast("long"), count - 1), F.transform("_c", lambda c: c["_pos"]))
    filled = F.when(F.size("_c") == count, F.col("_c")).otherwise(F.concat("_c", F.transform(holes, lambda p: F.struct(p.alias("_pos"), nothing.alias("v")))))
    ordered = found.withColumn("_c", F.sort_array(filled))

    def value(i: int):
        return lambda c: F.coalesce(c["v"][f"v{i}"], F.lit(float("nan")).cast("float"))

    arrays = [F.transform("_c", value(i)).alias(v) for i, v in enumerate(values)]
    ordered.select(*names, *(f"cnt_{k}" for k in range(len(shape))), *arrays).sortWithinPartitions(*names).write.mode("overwrite").parquet(f"{path}/chunks")
    spark.createDataFrame([(_meta_json(list(meta.variables), crs_wkt, times, None),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path
