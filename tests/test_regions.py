"""Regions: coverage, statistics, nearest cells."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as g
from gridloom.errors import BindError
from gridloom.functions.geometry import check_valid, covers, haversine, interior_point, parse_regions, parse_wkb, polygon_wkb
from gridloom.functions.grids import parse_grid
from gridloom.operators.regions import join_points, locate


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


SHAPES = {
    "A": [[box(100, 20, 102, 22)]],
    "B": [[box(101, 21, 103, 23)]],
    "Hole": [[box(100, 20, 104, 24), box(101, 21, 103, 23)]],
    "Empty": [],
    "Outside": [[box(110, 30, 111, 31)]],
    "Multi": [[box(100, 20, 101, 21)], [box(103, 23, 104, 24)]],
    "CopyA": [[box(100, 20, 102, 22)]],
    "Narrow": [[box(100, 20, 100.2, 24)]],
    "Gap": [[box(100.1, 20.1, 100.2, 20.2)]],
    "Corner": [[box(102, 22, 104, 24)]],
}
REGIONS = [{"id": k, "wkb": polygon_wkb(*v)} for k, v in SHAPES.items()]
COUNTS = {"A": 9, "B": 9, "Hole": 24, "Multi": 8, "CopyA": 9, "Narrow": 5, "Corner": 9}


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    m, t, y, x = np.meshgrid(range(2), range(3), range(5), range(5), indexing="ij")
    v = 1000.0 * m + 100 * t + 10 * y + x
    v[(t == 2) | ((y == 2) & (x == 2))] = np.nan
    path = f"{tmp_path_factory.mktemp('regions')}/regions"
    return g.write_cube(spark, path, {"": v.astype(np.float32)}, (1, 1, 2, 3), ("member", "time", "lat", "lon"))


OPTIONS = {
    "grid": {"nx": 5, "ny": 5, "lat0": 20.0, "lon0": 100.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"},
    "spatial_axes": ["lat", "lon"],
    "axes": {"time": {"axis": "time", "start": dt.datetime(2026, 1, 1), "step": dt.timedelta(hours=1)}, "member": {"axis": "member", "values": [0, 1]}},
}


def test_points(spark, cube):
    df = g.read_regions(spark, cube, regions=REGIONS, **OPTIONS)
    assert df.columns == ["value", "lat", "lon", "valid_time", "member", "region_id"]
    assert df.count() == 438
    got = {r[0]: r[1] for r in df.where("member = 0 AND valid_time = TIMESTAMP_NTZ '2026-01-01 00:00:00'").groupBy("region_id").count().collect()}
    assert got == COUNTS
    stats = [F.count("*"), F.count("value"), F.sum("value"), F.avg("value"), F.min("value"), F.max("value")]
    own = df.where("region_id = 'A' AND member = 0")
    assert tuple(own.where("valid_time = TIMESTAMP_NTZ '2026-01-01 00:00:00'").agg(*stats).first()) == (9, 8, 77.0, 9.625, 0.0, 21.0)
    assert tuple(own.where("valid_time = TIMESTAMP_NTZ '2026-01-01 02:00:00'").agg(*stats).first()) == (9, 0, None, None, None, None)


def test_no_region_gives_no_row(spark, cube):
    assert g.read_regions(spark, cube, regions=[], **OPTIONS).count() == 0
    assert g.read_regions(spark, cube, regions=[r for r in REGIONS if r["id"] == "Empty"], **OPTIONS).count() == 0


def test_edge_cases():
    shape = ([box(0, 0, 2, 2), box(0.5, 0.5, 1.5, 1.5)],)
    cases = [(0.0, 1.0, True), (0.5, 1.0, True), (1.0, 1.0, False), (math.nextafter(0.0, math.inf), 1.0, True), (math.nextafter(0.0, -math.inf), 1.0, False), (0.0, 0.0, True)]
    assert [covers(shape, x, y) for x, y, _ in cases] == [c for *_, c in cases]


def test_wkb():
    for shape in SHAPES.values():
        for big in (False, True):
            assert list(parse_wkb(polygon_wkb(*shape, big=big))) == [[[tuple(map(float, p)) for p in ring] for ring in poly] for poly in shape]
    good = polygon_wkb([box(0, 0, 1, 1)])
    for wrong in (good[:-1], good + b"\0", b"\2" + good[1:], good[:1] + b"\1" + good[2:], polygon_wkb([box(0, 0, 1, 90)]), polygon_wkb([box(-120, 0, 120, 1)]), polygon_wkb([[(0, 0), (1, 0), (0, 0)]])):
        with pytest.raises(BindError):
            parse_wkb(wrong)


@pytest.mark.parametrize("shape", [([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]],), ([box(0, 0, 2, 2), box(3, 3, 4, 4)],), ([box(0, 0, 2, 2)], [box(1, 1, 3, 3)]), ([box(0, 0, 4, 4)], [box(1, 1, 2, 2)])])
def test_invalid_geometries(shape):
    with pytest.raises(BindError):
        check_valid(shape, 1)


def test_valid_geometries():
    for shape in SHAPES.values():
        check_valid(tuple(shape), 1)
        if shape:
            assert covers(tuple(shape), *interior_point(tuple(shape)))


@pytest.mark.parametrize("change", [{"region_crs": "x"}, {"method": "mean"}, {"max_distance_m": 1.0}, {"out_of_bounds": "error"}, {"regions": [REGIONS[0], REGIONS[0]]}, {"regions": [{"id": "", "wkb": REGIONS[0]["wkb"]}]}, {"method": "nearest", "max_distance_m": -1.0}, {"method": "nearest", "out_of_bounds": "error"}])
def test_wrong_declarations(spark, cube, change):
    with pytest.raises(BindError):
        g.read_regions(spark, cube, **({"regions": REGIONS} | OPTIONS | change))


@pytest.fixture(scope="module")
def sampling(spark, tmp_path_factory):
    m, t, level, y, x = np.meshgrid(range(2), range(3), range(2), range(5), range(5), indexing="ij")
    v = t * 100000.0 + m * 10000 + level * 1000 + y * 5 + x
    h = v + 10000
    h[..., 2, 2] = np.nan
    path = f"{tmp_path_factory.mktemp('sampling')}/small"
    return g.write_cube(spark, path, {"/s/temperature": v.astype(np.float32), "/s/humidity": h.astype(np.float32)}, (1, 1, 1, 3, 3), ("member", "time", "level", "lat", "lon"))


NEAREST = {
    "grid": {"nx": 5, "ny": 5, "lat0": -2.0, "lon0": -2.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"},
    "spatial_axes": ["lat", "lon"],
    "axes": {
        "member": {"axis": "member", "values": [0, 1]},
        "time": {"axis": "time", "start": dt.datetime(2026, 1, 1), "step": dt.timedelta(hours=1)},
        "level": {"axis": "level", "values": [100, 200], "kind": "pressure", "unit": "hPa"},
    },
    "method": "nearest",
}
TARGETS = [{"id": "Gap", "wkb": polygon_wkb([box(0.1, 0.1, 0.2, 0.2)])}, {"id": "Outside", "wkb": polygon_wkb([box(10, 10, 11, 11)])}, {"id": "Empty", "wkb": polygon_wkb()}]


def test_nearest(spark, sampling):
    df = g.read_regions(spark, sampling, regions=TARGETS, include_source=True, **NEAREST)
    assert df.count() == 36
    got = {r["region_id"]: r for r in df.groupBy("region_id").agg(F.count("*").alias("n"), F.min("sampling.status").alias("s"), F.min("sampling.source_point_index").alias("p"), F.max("om_source.point_index").alias("o")).collect()}
    assert (got["Gap"]["n"], got["Gap"]["s"], got["Gap"]["p"], got["Gap"]["o"]) == (12, "ok", 12, 12)
    assert (got["Outside"]["s"], got["Outside"]["p"], got["Empty"]["s"], got["Empty"]["o"]) == ("outside_domain", None, "empty_geometry", None)
    row = df.where("region_id = 'Gap' AND sampling.axis_indices = array(1L, 2L, 1L)").first()
    assert row["s/temperature"] == 2 * 100000 + 10000 + 1000 + 12 and row["s/humidity"] is None
    states = row["sampling"]["variables"]
    assert (states["s/temperature"]["status"], states["s/humidity"]["status"]) == ("ok", "source_null")
    assert (states["s/humidity"]["source_count"], states["s/humidity"]["valid_source_count"]) == (1, 0)


def test_beyond_max_keeps_the_candidate_but_no_value(spark, sampling):
    row = g.read_regions(spark, sampling, regions=TARGETS[:1], max_distance_m=1.0, include_source=True, **NEAREST).first()
    s = row["sampling"]
    assert s["status"] == "beyond_max_distance" and s["source_point_index"] == 12 and s["distance_m"] > 1
    assert row["s/temperature"] is None and row["om_source"] is None


@pytest.mark.parametrize("grid", [NEAREST["grid"], {"nx": 36, "ny": 19, "lat0": -90.0, "lon0": -180.0, "dlat": 10.0, "dlon": 10.0, "order": "lat_fastest"}, {"nx": 7, "ny": 5, "lat0": 60.0, "lon0": 176.0, "dlat": -3.0, "dlon": 2.0, "order": "lon_fastest"}])
def test_location_is_that_of_an_exhaustive_search(grid):
    grid = parse_grid(grid)
    rng = np.random.default_rng(1)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(grid.nx), np.arange(grid.ny)))
    lat, lon = grid.coordinates_of(x, y)
    point = x * grid.ny + y if grid.order == "y_fastest" else y * grid.nx + x
    for tx, ty in [*zip(rng.uniform(-180, 180, 40), rng.uniform(-89, 89, 40), strict=True), (0.5, 0.5), (0.0, 0.0), (-175.0, 5.0)]:
        far = haversine(tx, ty, lon, lat, grid.earth.radius_m)
        best = np.lexsort((point, far))[0]
        assert locate(grid, tx, ty)[:2] == (far[best], point[best])


def test_status_alone_reads_no_values(spark, sampling):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    df = g.read_regions(spark, sampling, regions=TARGETS, **NEAREST)
    read = lambda d: d._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[-1]
    assert "temperature" not in read(df.select("region_id", "sampling.status", "lat"))
    assert "temperature" in read(df.select("sampling.variables")) and "humidity" in read(df.select("sampling"))
    one = g.read_regions(spark, sampling, regions=TARGETS, variable="s/temperature", **NEAREST)
    assert "humidity" not in read(one.select("sampling"))


def test_large_regions_are_sent_once(spark):
    """A polygon of many vertices over many tiles: the tiles carry envelopes, and the polygon is joined by region."""
    import math

    ring = [(60 * math.cos(2 * math.pi * i / 20_000), 40 * math.sin(2 * math.pi * i / 20_000)) for i in range(20_000)]
    (region,) = parse_regions([{"id": "oval", "wkb": polygon_wkb([[*ring, ring[0]]])}])
    points = spark.range(400).selectExpr("id", "CAST(id % 20 * 9 - 85.5 AS DOUBLE) AS lon", "CAST(id DIV 20 * 7 - 66.5 AS DOUBLE) AS lat")
    out = join_points(points, [region])
    want = [i for i in range(400) if ((i % 20 * 9 - 85.5) / 60) ** 2 + ((i // 20 * 7 - 66.5) / 40) ** 2 < 1]
    assert sorted(r["id"] for r in out.collect()) == want
    tiles = [n for n in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "_tx" in n and "polygons" in n]
    assert not tiles


def test_ranges_around_boxes():
    """All cells in any box lie in the ranges, on every kind of grid."""
    import numpy as np

    from gridloom.functions.grids import FLOAT32, RotatedGrid
    from gridloom.plans import domains
    from gridloom.plans.select import around, meet

    boxes = [(-20.0, 30.0, -5.0, 45.0), (100.0, -10.0, 140.0, 0.0)]
    flat, square = domains.domain("n160"), RotatedGrid(60, 40, policy=FLOAT32, x0=-30.0, y0=-20.0, dx=1.0, dy=1.0, north_pole_latitude=39.25, north_pole_longitude=-162.0, rotation=10.0)
    for grid, spatial in ((flat, (0,)), (square, (0, 1)), (domains.domain("cams_global"), (0, 1))):
        x, y = grid.xy_of(np.arange(grid.points if spatial == (0,) else grid.nx * grid.ny))
        lat, lon = grid.coordinates_of(x, y)
        inside, middle = np.zeros(len(lat), bool), len(lat) // 2 + grid.nx // 3
        own = [*boxes, (lon[middle] - 2, lat[middle] - 3, lon[middle] + 2, lat[middle] + 3)]
        for a, b, c, d in own:
            inside |= (lon >= a) & (lon <= c) & (lat >= b) & (lat <= d)
        got = around(grid, spatial, own)
        keep = np.ones(len(lat), bool)
        for axis, at in zip(spatial, (np.arange(len(lat)),) if spatial == (0,) else (y, x), strict=True):
            keep &= np.isin(at, [i for p, q in got[axis] for i in range(p, q + 1)])
        assert inside.any() and (keep | ~inside).all() and keep.mean() < 0.8
    assert meet([(0, 5), (8, 9)], [(2, 8), (9, 20)]) == [(2, 5), (8, 8), (9, 9)]
