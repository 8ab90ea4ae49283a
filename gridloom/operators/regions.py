"""Regions: grid points that polygons cover, or one representative cell for each polygon."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import BindError
from gridloom.functions.geometry import EDGES, Region, covers_column, edges, haversine, interior_point, parse_regions
from gridloom.functions.grids import RegularGrid, Y_FASTEST, normalized
from gridloom.operators import scan
from gridloom.operators.scan import Bound
from gridloom.plans import identity
from gridloom.plans.select import around, meet
from gridloom.plans.meta import check_names

# Names in the sampling struct.
ALGORITHM, REPRESENTATIVE, DISTANCE_MODEL = "sphere_haversine_f64_v1", "point_on_surface_v1", "grid_sphere"
#: Tiles of all envelopes together, about; the tile size follows from it.
TILES = 1 << 16


def region_table(spark: SparkSession, regions: list[Region]) -> DataFrame:
    """Regions with their edges. Their number and vertices are capped (40 bytes a vertex), so the table may be broadcast."""
    return spark.createDataFrame([(r.id, edges(r.polygons)) for r in regions if r.polygons], f"region_id string, polygons {EDGES}")


def join_points(points: DataFrame, regions: list[Region], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point once for every region that covers it. Points and envelopes meet by tile, an equi-join whose small side
    has about TILES rows of an id and four numbers and is broadcast; only then do the polygons join, each once, by region.
    The envelope and the exact test decide."""
    spark = points.sparkSession
    boxes = [r.envelope for r in regions if r.polygons]
    if not boxes:
        return points.withColumn("region_id", F.lit(None).cast("string")).where(F.lit(False))
    area = sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes)
    size = max(0.05, math.sqrt(area / TILES))
    tile = lambda c: F.floor(c / F.lit(size)).cast("int")
    table = spark.createDataFrame([(r.id, *r.envelope) for r in regions if r.polygons], "region_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    tiled = table.withColumn("_tx", F.explode(F.sequence(tile(F.col("min_lon")), tile(F.col("max_lon"))))).withColumn("_ty", F.explode(F.sequence(tile(F.col("min_lat")), tile(F.col("max_lat")))))
    placed = points.withColumns({"_tx": tile(F.col(lon)), "_ty": tile(F.col(lat))})
    met = placed.join(F.broadcast(tiled), ["_tx", "_ty"])
    inside = F.col(lon).between(F.col("min_lon"), F.col("max_lon")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
    met = met.where(inside).drop("min_lon", "min_lat", "max_lon", "max_lat", "_tx", "_ty").join(F.broadcast(region_table(spark, regions)), "region_id")
    met = met.where(covers_column(F.col("polygons"), F.col(lon), F.col(lat)))
    return met.select(*points.columns, "region_id")


def _require_lonlat(b: Bound, category: str = "region_reference") -> None:
    if b.grid is None:
        raise BindError(category, "regions need a grid or a domain")


def _points(b: Bound, regions: list[Region], where: str | None) -> DataFrame:
    selection = scan.chosen(b, where)
    boxes = [r.envelope for r in regions if r.polygons]
    if boxes:  # cells outside all envelopes can't match
        for axis, ranges in around(b.grid, b.spatial, boxes).items():
            selection.ranges[axis] = meet(selection.ranges[axis], ranges) if axis in selection.ranges else ranges
    scan.note(b, "regions", selection)
    out = join_points(scan.project(b, b.source.cells(b.meta, selection.ranges)), regions)
    columns = [c for c in out.columns if c not in ("region_id", "om_source")]
    return out.select(*(F.col("`" + c + "`") for c in columns), "region_id", *(["om_source"] if b.include_source else []))


# ---- nearest -------------------------------------------------------------------------------------------------------


def _capability(b: Bound) -> RegularGrid:
    def no(message: str) -> BindError:
        return BindError("sampling_capability", message)

    g = b.grid
    if not isinstance(g, RegularGrid) or g.earth.model != "sphere" or g.beyond_poles:
        raise no("nearest needs a regular grid on a sphere without latitudes beyond the poles")
    lat, lon = g.lat0 + np.arange(g.ny) * g.dlat, g.lon0 + np.arange(g.nx) * g.dlon
    if (np.diff(lat) * np.sign(g.dlat) <= 0).any() or (np.diff(lon) * np.sign(g.dlon) <= 0).any():
        raise no("the axes must be strictly monotonic")
    if abs(lon[-1] - lon[0]) >= 360 or len(np.unique(normalized(lon))) != g.nx:
        raise no("longitudes must be unique and span less than 360 degrees")
    return g


def _inside(g: RegularGrid, x: float, y: float) -> bool:
    """Whether a target lies in the closed span of the axes; a full circle of longitudes has no ends."""
    lats = (g.lat0, g.lat0 + (g.ny - 1) * g.dlat)
    if not min(lats) <= y <= max(lats):
        return False
    if g.nx >= 2 and g.nx * abs(g.dlon) == 360.0:
        return True
    first = float(normalized(np.array(g.lon0)))
    x = float(normalized(np.array(x)))
    if g.nx == 1:
        return x == first
    way = (x - first if g.dlon > 0 else first - x) % 360.0
    return way <= abs((g.lon0 + (g.nx - 1) * g.dlon) - g.lon0)


def locate(g: RegularGrid, x: float, y: float) -> tuple[float, int, float, float]:
    """(distance, point, lon, lat) of the nearest grid point; of equally near ones, the least point. In one row distance
    grows with the difference in longitude, so only the two columns to each side of the target can be nearest."""
    lon = normalized(g.lon0 + np.arange(g.nx) * g.dlon)
    gap = np.abs((lon - x + 180.0) % 360.0 - 180.0)
    columns = np.argsort(gap, kind="stable")[:4]
    rows = np.arange(g.ny)
    cx, cy = (v.ravel() for v in np.meshgrid(columns, rows))
    lats = g.lat0 + cy * g.dlat
    if np.abs(lats).max() == 90.0:  # at a pole all longitudes are equally near
        pole = rows[np.abs(g.lat0 + rows * g.dlat) == 90.0]
        px, py = (v.ravel() for v in np.meshgrid(np.arange(g.nx), pole))
        cx, cy = np.concatenate([cx, px]), np.concatenate([cy, py])
        lats = g.lat0 + cy * g.dlat
    far = haversine(x, y, lon[cx], lats, g.earth.radius_m)
    point = cx * g.ny + cy if g.order == Y_FASTEST else cy * g.nx + cx
    best = np.lexsort((point, far))[0]
    return float(far[best]), int(point[best]), float(lon[cx[best]]), float(lats[best])


def _located(b: Bound, regions: list[Region], max_distance_m: float | None, out_of_bounds: str) -> list[tuple]:
    """(region_id, status, lon, lat, distance_m, point, source_lon, source_lat) of every region."""
    g = _capability(b)
    rows = []
    for r in regions:
        if not r.polygons:
            rows.append((r.id, "empty_geometry", None, None, None, None, None, None))
            continue
        x, y = interior_point(r.polygons)
        if not _inside(g, x, y):
            if out_of_bounds == "error":
                raise BindError("region_sampling", f"region {r.id!r} lies outside the grid")
            rows.append((r.id, "outside_domain", x, y, None, None, None, None))
            continue
        far, point, lon, lat = locate(g, x, y)
        status = "beyond_max_distance" if max_distance_m is not None and far > max_distance_m else "ok"
        rows.append((r.id, status, x, y, far, point, lon, lat))
    return rows


def _nearest(b: Bound, regions: list[Region], where: str | None, max_distance_m: float | None, out_of_bounds: str) -> DataFrame:
    spark, g = b.spark, b.grid
    found = _located(b, regions, max_distance_m, out_of_bounds)
    selection = scan.chosen(b, where, nearest=True)
    usable = sorted({r[5] for r in found if r[1] == "ok"})
    if len(b.spatial) == 1:
        selection.ranges[b.spatial[0]] = [(p, p) for p in usable]
    else:
        selection.ranges[b.spatial[0]] = [(y, y) for y in sorted({p // g.nx for p in usable})]
        selection.ranges[b.spatial[1]] = [(x, x) for x in sorted({p % g.nx for p in usable})]
    scan.note(b, "nearest", selection)

    # at most 4,096 located regions; their product with the other axes is the result
    types = "region_id string, status string, lon double, lat double, distance_m double, point long, source_lon double, source_lat double"
    located = spark.createDataFrame(found, types)
    other, strides = b.other_axes, b.meta.strides()
    tuples = math.prod(b.meta.shape[i] for i in other)
    place, step = F.lit(0).cast("long"), 1
    axis_at: dict[int, Column] = {}
    for i in reversed(other):
        axis_at[i] = F.call_function("div", F.col("_t"), F.lit(step)) % b.meta.shape[i]
        place = place + axis_at[i] * strides[i]
        step *= b.meta.shape[i]
    point = F.col("point")
    if len(b.spatial) == 1:
        place = place + point * strides[b.spatial[0]]
    else:
        place = place + F.call_function("div", point, F.lit(g.nx)) * strides[b.spatial[0]] + point % g.nx * strides[b.spatial[1]]
    base = spark.range(tuples).withColumnRenamed("id", "_t").crossJoin(F.broadcast(located)).withColumn("logical_index", place)
    base = base.withColumn("_key", F.when(F.col("status") == "ok", F.col("logical_index")))
    cells = b.source.cells(b.meta, selection.ranges).withColumnRenamed("logical_index", "_cell")
    rows = base.join(cells, F.col("_key") == F.col("_cell"), "left")

    values = dict(zip(b.meta.names, scan.value_columns(b), strict=True))
    ok = F.col("status") == "ok"
    own = []
    for n, v in values.items():
        state = F.when(~ok, F.col("status")).when(v.isNull(), F.lit("source_null")).otherwise(F.lit("ok"))
        count = F.when(ok, F.lit(1)).otherwise(F.lit(0)).cast("long")
        valid = F.when(ok & v.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
        own += [F.lit(n), F.struct(state.alias("status"), count.alias("source_count"), valid.alias("valid_source_count"))]
    sampling = F.struct(
        F.lit("nearest").alias("method"),
        F.lit(ALGORITHM).alias("algorithm"),
        F.lit(REPRESENTATIVE).alias("representative"),
        F.lit("gridloom-1").alias("spatial_version"),
        F.lit(identity.grid_id(g)).alias("grid_id"),
        F.lit(identity.layout_id(g, b.spatial, b.meta.shape)).alias("layout_id"),
        F.lit(DISTANCE_MODEL).alias("distance_model"),
        F.lit(g.earth.radius_m).alias("earth_radius_m"),
        F.col("status"),
        F.col("source_lon"),
        F.col("source_lat"),
        F.col("point").alias("source_point_index"),
        F.col("distance_m"),
        F.array(*(axis_at[i] for i in other)).cast("array<bigint>").alias("axis_indices"),
        F.create_map(*own).alias("variables"),
    )
    labels = [a.column(axis_at[b.names.index(a.axis)]).alias(a.output) for a in b.semantic]
    if b.constant_time is not None:
        labels = [c for c in scan.label_columns(b)[:1]] + labels
    source = [F.when(ok, scan.source_struct(b, point, F.col("logical_index"))).alias("om_source")] if b.include_source else []
    return rows.select(*values.values(), F.col("lat"), F.col("lon"), *labels, F.col("region_id"), sampling.alias("sampling"), *source)


def read_regions(spark: SparkSession, source, *, regions: list[dict], region_crs: str = "grid_lonlat", method: str = "points", max_distance_m: float | None = None, out_of_bounds: str = "null", where: str | None = None, **options) -> DataFrame:
    """method "points": every cell once for each region that covers it. method "nearest": one row for each region and
    tuple of the other axes, from the grid point nearest to the region's representative point."""
    if method not in ("points", "nearest"):
        raise BindError("region_method", "method must be points or nearest")
    if method == "points" and (max_distance_m is not None or out_of_bounds != "null"):
        raise BindError("region_method", "max_distance_m and out_of_bounds belong to method nearest")
    if out_of_bounds not in ("null", "error"):
        raise BindError("region_sampling", "out_of_bounds must be null or error")
    if max_distance_m is not None and (isinstance(max_distance_m, bool) or not math.isfinite(max_distance_m) or max_distance_m < 0):
        raise BindError("region_sampling", "max_distance_m must be finite and not negative")
    checked = parse_regions(regions, region_crs)
    b = scan.bind(spark, source, **options)
    _require_lonlat(b)
    check_names(b.meta.names, [*b.extra_names(), "region_id", *(["sampling"] if method == "nearest" else []), *(["om_source"] if b.include_source else [])])
    out = _points(b, checked, where) if method == "points" else _nearest(b, checked, where, max_distance_m, out_of_bounds)
    return out.where(where) if where else out
