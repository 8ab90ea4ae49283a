"""Scans: a cube's cells as rows, with coordinates computed from each cell's index.

Everything up to the output schema happens on the driver when the DataFrame is built, and wrong declarations raise then.
Coordinates are expressions, so a query pays only for the columns it uses; a count reads no values.
"""

from __future__ import annotations

import datetime as dt
import inspect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import BindError
from gridloom.functions.axes import SemanticAxis, bind_axes, micros, utc
from gridloom.functions.grids import SEPARATE, GaussianGrid, Grid, RegularGrid, parse_grid
from gridloom.plans import domains, identity, metrics
from gridloom.plans.meta import CubeMeta, check_names
from gridloom.plans.select import Conditions, Selection, extract, plan
from gridloom.sources.cubes import ChunkCube, TableCube
from gridloom.workers import importable

Source = str | ChunkCube | TableCube


def bad(message: str) -> BindError:
    return BindError("scan", message)


@dataclass
class Bound:
    """A scan with all declarations checked."""

    spark: SparkSession
    source: ChunkCube | TableCube
    meta: CubeMeta
    names: tuple[str, ...] | None
    grid: Grid | None
    spatial: tuple[int, ...]
    semantic: list[SemanticAxis]
    constant_time: int | None
    include_source: bool
    crs_status: str

    @property
    def rank(self) -> int:
        return len(self.meta.shape)

    def at(self, axis: int, logical: Column | None = None) -> Column:
        """Index along an axis, from the logical index."""
        logical = F.col("logical_index") if logical is None else logical
        return F.call_function("div", logical, F.lit(self.meta.strides()[axis])) % self.meta.shape[axis]

    def xy(self) -> tuple[Column, Column]:
        """Column and row of the cell in its grid."""
        if len(self.spatial) == 2:
            return self.at(self.spatial[1]), self.at(self.spatial[0])
        return self.grid.xy(self.at(self.spatial[0]))

    def point(self) -> Column:
        """The cell's point in the grid's storage order."""
        return self.at(self.spatial[0]) if len(self.spatial) == 1 else self.grid.point(*self.xy())

    @property
    def other_axes(self) -> list[int]:
        return [i for i in range(self.rank) if i not in self.spatial]

    def extra_names(self) -> list[str]:
        out = ["lat", "lon"] if self.grid else []
        out += ["valid_time"] if self.constant_time is not None else []
        return out + [a.output for a in self.semantic]


def open_source(spark: SparkSession, source: Source) -> ChunkCube | TableCube:
    return ChunkCube(spark, source) if isinstance(source, str) else source


def _spatial_axes(grid: Grid, names: tuple[str, ...] | None, spatial: list[str] | None, from_domain: bool) -> tuple[str, ...]:
    if names is None:
        raise bad("a grid needs declared dimensions")
    if from_domain:
        if spatial is not None:
            raise bad("a domain has its own spatial axes")
        if isinstance(grid, GaussianGrid):
            return ("point",) if "point" in names else ("lon",)
        return ("lat", "lon") if isinstance(grid, RegularGrid) else ("y", "x")
    if not spatial or not all(isinstance(s, str) and s for s in spatial):
        raise bad("a grid needs spatial_axes")
    return tuple(spatial)


def _bind_grid(meta: CubeMeta, names, grid, spatial, domain) -> tuple[Grid | None, tuple[int, ...], str]:
    if grid is not None and domain is not None:
        raise bad("grid and domain exclude each other")
    if grid is None and domain is None:
        if spatial is not None:
            raise bad("spatial_axes need a grid")
        return None, (), "not_specified"
    got = domains.domain(domain) if domain is not None else parse_grid(grid)
    axes = _spatial_axes(got, names, spatial, domain is not None)
    if len(set(axes)) != len(axes) or any(a not in names for a in axes):
        raise bad(f"the dimensions lack the spatial axes {list(axes)}")
    at = tuple(names.index(a) for a in axes)
    extents = [meta.shape[i] for i in at]
    if isinstance(got, GaussianGrid):
        if len(at) != 1 or extents != [got.points]:
            raise bad(f"a Gaussian grid needs one axis of {got.points} points")
    elif got.order == SEPARATE:
        if len(at) != 2 or extents != [got.ny, got.nx]:
            raise bad(f"the grid needs axes of {got.ny} and {got.nx}")
    elif len(at) != 1 or extents != [got.nx * got.ny]:
        raise bad(f"the grid needs one axis of {got.nx * got.ny} points")
    if domain is None:
        got.validate()
    domains.check_bbox(meta.crs_wkt, got)
    status = domains.check_profile(meta.crs_wkt, got) if isinstance(grid, dict) and "version" in grid else "not_checked"
    return got, at, status


def bind(spark: SparkSession, source: Source, *, dimensions=None, grid=None, spatial_axes=None, domain=None, include_source=False, valid_times=None, axes=None, variable=None) -> Bound:
    """Checks all declarations of a scan."""
    importable(spark)
    opened = open_source(spark, source)
    meta = opened.meta.select(variable)
    names = meta.declared(dimensions)
    bound, spatial, status = _bind_grid(meta, names, grid, spatial_axes, domain)
    semantic = bind_axes(axes, names, meta.shape, tuple(names[i] for i in spatial) if names else ())
    constant = None
    declared = next((a for a in semantic if a.kind == "time"), None)
    times = [micros(utc(t, "valid_times")) for t in valid_times] if valid_times is not None else None
    embedded = [t * 1_000_000 for t in meta.times] if meta.times is not None else None
    if times is not None and embedded is not None and times != embedded:
        raise bad("valid_times differ from the times that the cube holds")
    times = times if times is not None else embedded
    if times is not None and declared is not None:
        if valid_times is not None or [declared.label(i) for i in range(declared.length)] != times:
            raise bad("axes.time conflicts with other times of the cube")
    elif times is not None:
        if names and "time" in names and len(times) == meta.shape[names.index("time")]:
            semantic.insert(0, SemanticAxis("time", "time", len(times), tuple(times)))
        elif len(times) == 1 and not (names and "time" in names):
            constant = times[0]
        else:
            raise bad("times need an axis 'time' of their length")
    if include_source and bound is None:
        raise bad("include_source needs a grid or a domain")
    out = Bound(spark, opened, meta, names, bound, spatial, semantic, constant, include_source, status)
    check_names(meta.names, [*out.extra_names(), *(["om_source"] if include_source else [])])
    return out


def source_struct(b: Bound, point: Column | None = None, logical: Column | None = None) -> Column:
    """Identity of the cell: object, grid, layout and indices."""
    point = b.point() if point is None else point
    logical = F.col("logical_index") if logical is None else logical
    parent = b.grid.parent(point) if isinstance(b.grid, GaussianGrid) else point
    return F.struct(
        F.lit(identity.object_id(b.meta.identity)).alias("object_id"),
        F.lit(None).cast("string").alias("object_version"),
        F.lit("unverifiable").alias("version_strength"),
        F.lit(False).alias("content_verified"),
        F.lit(identity.grid_id(b.grid)).alias("grid_id"),
        F.lit(identity.layout_id(b.grid, b.spatial, b.meta.shape)).alias("layout_id"),
        logical.alias("logical_index"),
        point.alias("point_index"),
        parent.alias("parent_point_index"),
        F.array(*(b.at(i, logical) for i in range(b.rank))).alias("axis_indices"),
    )


def value_columns(b: Bound) -> list[Column]:
    """Values with NaN as null; infinities and the sign of zero stay."""
    cols = [F.col("`" + n + "`") for n in b.meta.names]
    return [F.when(~F.isnan(c), c).alias(n) for c, n in zip(cols, b.meta.names, strict=True)]


def label_columns(b: Bound) -> list[Column]:
    """valid_time and the other semantic columns."""
    out = []
    if b.constant_time is not None:
        stamp = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=b.constant_time)
        out.append(F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz").alias("valid_time"))
    return out + [a.column(b.at(b.names.index(a.axis))).alias(a.output) for a in b.semantic]


def coordinate_columns(b: Bound) -> list[Column]:
    if b.grid is None:
        return []
    lat, lon = b.grid.coordinates(*b.xy())
    return [lat.alias("lat"), lon.alias("lon")]


def project(b: Bound, cells: DataFrame) -> DataFrame:
    """Cells as output rows."""
    source = [source_struct(b).alias("om_source")] if b.include_source else []
    return cells.select(*value_columns(b), *coordinate_columns(b), *label_columns(b), *source)


def chosen(b: Bound, where: str | None, nearest: bool = False) -> Selection:
    conditions = extract(b.spark, where, b.semantic) if where else Conditions()
    return plan(conditions, b.grid, b.spatial, b.semantic, b.names, b.meta.shape, nearest)


def note(b: Bound, kind: str, selection: Selection, query: str | None = None) -> None:
    metrics.record(
        query or f"{kind}:{b.meta.identity}",
        {
            "scan": kind,
            "rows": b.meta.rows,
            "candidate_rows": selection.candidates,
            "selection_mode": selection.mode,
            "fallback_reasons": selection.reasons,
            "ranges": {str(k): v[:16] for k, v in selection.ranges.items()},
            "variables": b.meta.names,
            "table": isinstance(b.source, TableCube),
        },
    )


def read_array(spark: SparkSession, source: Source, *, where: str | None = None, **options) -> DataFrame:
    """All aligned variables as rows, with the coordinates that the options declare.

    ``where`` is a SQL predicate over the output columns. It is applied in full; what it implies about lat, lon and the
    semantic axes also limits the chunks that are read.
    """
    b = bind(spark, source, **options)
    selection = chosen(b, where)
    note(b, "array", selection)
    out = project(b, b.source.cells(b.meta, selection.ranges))
    return out.where(where) if where else out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The root array of a cube that has nothing else, in the order of its cells."""
    b = bind(spark, path)
    if b.meta.names != ["value"]:
        raise bad("a raw scan needs a root array and no other")
    note(b, "raw", plan(Conditions(), None, (), [], None, b.meta.shape))
    return b.source.cells(b.meta).orderBy("logical_index").select(*value_columns(b))


SCAN_OPTIONS = tuple(p for p in inspect.signature(bind).parameters if p not in ("spark", "source"))
