"""Scans of rebuilt array fixtures against their value formulas."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as g
from gridloom.errors import BindError, SourceError
from gridloom.plans import settings

HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def cubes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cubes")

    def put(name, arrays, chunks, axes=None, **more):
        arrays = arrays if isinstance(arrays, dict) else {"": arrays}
        return g.write_cube(spark, f"{root}/{name}", {k: np.asarray(v, np.float32) for k, v in arrays.items()}, chunks, axes, **more)

    i = np.arange(83 * 127).reshape(83, 127)
    five = np.arange(32.0).reshape((2,) * 5)
    five.flat[7] = np.nan
    return {
        "raw": put("raw", np.arange(6).reshape(2, 3), (1, 2)),
        "special": put("special", [[np.nan, np.inf, -np.inf, 0.0], [-0.0, 42.25, -3.5, 123.125]], (1, 3)),
        "multi": put("multi", {"/temperature": np.arange(6).reshape(2, 3), "/humidity": 100 + np.arange(6).reshape(2, 3)}, (1, 2), ("row", "column")),
        "projection": put("projection", {"/humidity": i % 97, "/pressure": 1000 + i * 0.5, "/temperature": i * 0.25 - 100}, (11, 17), ("row", "column")),
        "five": put("five", five, (1, 2, 1, 2, 1), ("time", "level", "lead_time", "member", "run")),
        "flat": put("flat", np.add.outer(np.arange(2) * 100, np.arange(6)), (1, 2), ("sample", "point")),
        "conflict": put("conflict", {"/Latitude": np.zeros((2, 3)), "/lat": np.zeros((2, 3))}, (1, 2), ("row", "column")),
        "timed": put("timed", np.arange(6).reshape(2, 3), (1, 2), ("time", "member"), times=(0, 3600)),
    }


WORLD = {"nx": 127, "ny": 83, "lat0": -41.0, "lon0": -180.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_raw(spark, cubes):
    assert rows(g.read_raw(spark, cubes["raw"])) == [(float(i),) for i in range(6)]
    with pytest.raises(BindError):
        g.read_raw(spark, cubes["multi"])


def test_special_values(spark, cubes):
    df = g.read_raw(spark, cubes["special"])
    v = F.col("value")
    got = df.agg(F.count_if(v.isNull()), F.count_if(v == math.inf), F.count_if(v == -math.inf), F.count_if(v.cast("string") == "0.0"), F.count_if(v.cast("string") == "-0.0")).first()
    assert tuple(got) == (1, 1, 1, 1, 1)


def test_projection_and_count_read_no_other_values(spark, cubes):
    df = g.read_array(spark, cubes["projection"])
    assert df.columns == ["humidity", "pressure", "temperature"]
    assert df.count() == 83 * 127
    plan = df.select("pressure")._jdf.queryExecution().executedPlan().toString()
    assert "pressure" in plan and "temperature" not in plan and "humidity" not in plan
    assert df.agg(F.sum(F.col("temperature").cast("double"))).first()[0] == sum(i * 0.25 - 100 for i in range(83 * 127))


def test_spatial_window(spark, cubes):
    options = {"grid": WORLD, "spatial_axes": ["row", "column"], "dimensions": ["row", "column"]}
    df = g.read_array(spark, cubes["projection"], where="lat BETWEEN -2 AND 2", **options)
    assert df.count() == 635
    assert g.last_scan_metrics(spark).where("metrics LIKE '%\"selection_mode\": \"restricted\"%'").count() >= 1
    full = g.read_array(spark, cubes["projection"], **options)
    for where in ("lat BETWEEN -2 AND 2", "lon >= -60 OR lon < -179", "lat = 3 AND lon > -100.5", "NOT (lat > 1)", "abs(lat) < 2 AND lon < -170", "lat > 91", "2 >= lat AND -5 < lat AND (lon <= -178 OR lon BETWEEN -100 AND -99)", "lat BETWEEN 170 AND -170"):
        pruned, kept = g.read_array(spark, cubes["projection"], where=where, **options), full.where(where)
        assert pruned.exceptAll(kept).count() == kept.exceptAll(pruned).count() == 0, where


def test_seam_union(spark, cubes):
    grid = {"nx": 3, "ny": 2, "lat0": 10.0, "lon0": 179.0, "dlat": 1.0, "dlon": 1.0, "order": "lon_fastest"}
    df = g.read_array(spark, cubes["flat"], grid=grid, spatial_axes=["point"], dimensions=["sample", "point"], where="lon >= 179 OR lon < -179")
    assert sorted(rows(df.select("lon").distinct())) == [(-180.0,), (179.0,)]
    assert df.count() == 8


@pytest.mark.parametrize("order", ["lon_fastest", "lat_fastest"])
def test_storage_orders(spark, cubes, order):
    grid = {"nx": 3, "ny": 2, "lat0": 10.0, "lon0": 100.0, "dlat": 1.0, "dlon": 1.0, "order": order}
    got = rows(g.read_array(spark, cubes["flat"], grid=grid, spatial_axes=["point"], dimensions=["sample", "point"]).where("value < 100").orderBy("value"))
    place = (lambda p: (p // 3, p % 3)) if order == "lon_fastest" else (lambda p: (p % 2, p // 2))
    assert got == [(float(p), 10.0 + place(p)[0], 100.0 + place(p)[1]) for p in range(6)]


AXES = {
    "time": {"axis": "time", "start": dt.datetime(2026, 1, 1), "step": HOUR},
    "level": {"axis": "level", "values": [1000, 850], "kind": "pressure", "unit": "hPa"},
    "lead_time": {"axis": "lead_time", "start": dt.timedelta(0), "step": HOUR},
    "member": {"axis": "member", "values": ["a", "b"]},
    "run": {"axis": "run", "values": [dt.datetime(2025, 12, 31), dt.datetime(2026, 1, 1, tzinfo=dt.UTC)]},
}


def test_five_axes(spark, cubes):
    df = g.read_array(spark, cubes["five"], axes=AXES)
    assert df.columns == ["value", "valid_time", "level", "lead_time", "member", "run"]
    got = {tuple(r[1:]): r[0] for r in df.collect()}
    assert len(got) == 32
    assert got[(dt.datetime(2026, 1, 1), 1000.0, HOUR, "b", dt.datetime(2026, 1, 1))] is None
    assert got[(dt.datetime(2026, 1, 1, 1), 850.0, HOUR, "b", dt.datetime(2026, 1, 1))] == 31.0
    for where in ("level = 850", "valid_time > TIMESTAMP_NTZ '2026-01-01 00:00:00'", "member = 'b' AND lead_time >= INTERVAL '1' HOUR", "member > 'a'", "level < 900 OR level > 900"):
        pruned = g.read_array(spark, cubes["five"], axes=AXES, where=where)
        kept = df.where(where)
        assert pruned.exceptAll(kept).count() == kept.exceptAll(pruned).count() == 0, where


def test_embedded_time(spark, cubes):
    df = g.read_array(spark, cubes["timed"])
    assert rows(df.where("value = 5").select("valid_time")) == [(dt.datetime(1970, 1, 1, 1),)]
    with pytest.raises(BindError):
        g.read_array(spark, cubes["timed"], valid_times=[dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 2)])


@pytest.mark.parametrize(
    "options",
    [
        {"axes": {"level": {"axis": "level", "values": [0, 850], "kind": "pressure", "unit": "hPa"}}},
        {"axes": {"level": {"axis": "level", "values": [1, 2], "kind": "pressure", "unit": "m"}}},
        {"axes": {"time": {"axis": "time", "values": [dt.datetime(2026, 1, 1)]}}},
        {"axes": {"time": {"axis": "nowhere", "start": dt.datetime(2026, 1, 1), "step": HOUR}}},
        {"axes": {"when": {"axis": "time", "values": [1, 2]}}},
        {"axes": {"member": {"axis": "member", "values": [1, "b"]}}},
        {"dimensions": ["time", "level"]},
        {"variable": "nothing"},
        {"variable": ""},
        {"include_source": True},
        {"grid": WORLD},
        {"grid": WORLD, "domain": "jma_gsm"},
        {"domain": "unknown"},
    ],
)
def test_wrong_declarations_raise_when_bound(spark, cubes, options):
    with pytest.raises(BindError):
        g.read_array(spark, cubes["five"], **options)


def test_collisions_and_missing_objects(spark, cubes):
    options = {"grid": {"nx": 3, "ny": 2, "lat0": 0.0, "lon0": 0.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"}, "spatial_axes": ["row", "column"]}
    with pytest.raises(BindError):
        g.read_array(spark, cubes["conflict"], **options)
    for path in ("", "/nowhere/at/all", "/tmp/*.om", "ftp://host/x", "s3://user@host/x"):
        with pytest.raises(SourceError):
            g.read_array(spark, path)


def test_source_struct_and_grid_info(spark, cubes):
    grid = {"nx": 3, "ny": 2, "lat0": 0.0, "lon0": 0.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"}
    options = {"grid": grid, "spatial_axes": ["row", "column"]}
    s = g.read_array(spark, cubes["multi"], include_source=True, **options).where("temperature = 5").first()["om_source"]
    assert (s["logical_index"], s["point_index"], s["axis_indices"], s["object_version"]) == (5, 5, [1, 2], None)
    info = g.grid_info(spark, cubes["multi"], **options)
    assert len(info.columns) == 13
    row = info.first()
    assert row["grid_id"] == s["grid_id"] and row["grid_type"] == "regular_latlon" and row["parent_grid_id"] is None
    other = g.grid_info(spark, cubes["multi"], grid=grid | {"dlat": 2.0}, spatial_axes=["row", "column"]).first()
    assert other["grid_id"] != row["grid_id"] and other["object_id"] == row["object_id"]


def test_variable_selector_and_map_dimensions(spark, cubes):
    assert g.read_array(spark, cubes["multi"], variable="/humidity").columns == ["humidity"]
    assert g.read_array(spark, cubes["multi"], dimensions={"temperature": ["row", "column"], "humidity": ["row", "column"]}).count() == 6
    with pytest.raises(BindError):
        g.read_array(spark, cubes["multi"], dimensions={"temperature": ["row", "column"]})


def test_cells_of_any_size_are_written_by_tasks(spark, tmp_path):
    shape, chunks = (5, 7, 3), (2, 3, 2)
    cells = spark.range(5 * 7 * 3).where("id <> 4").selectExpr("id AS logical_index", "CAST(id AS FLOAT) AS value")
    path = g.write_cells(cells, f"{tmp_path}/cube", shape, chunks, ["value"], ("a", "b", "c"))
    got = rows(g.read_raw(spark, path))
    assert got == [(None if i == 4 else float(i),) for i in range(105)]


def test_remote_path_by_hadoop(spark, cubes):
    assert g.read_array(spark, "file://" + cubes["raw"]).count() == 6


def test_settings_bound_tasks_and_notice_changes(spark, tmp_path):
    values = np.arange(12, dtype=np.float32).reshape(3, 4)
    path = g.write_cube(spark, f"{tmp_path}/cube", {"": values}, (1, 2))
    try:
        settings.put(spark, "max_threads", 1)
        assert g.read_array(spark, path).rdd.getNumPartitions() == 1
        settings.put(spark, "revalidate_metadata", True)
        cube = g.ChunkCube(spark, path)
        assert g.read_array(spark, cube).count() == 12
        g.write_cube(spark, path, {"": values + 1}, (1, 2))
        with pytest.raises(SourceError, match="object_changed"):
            g.read_array(spark, cube)
    finally:
        settings.put(spark, "max_threads", 0)
        settings.put(spark, "revalidate_metadata", False)


def test_index_ranges_reach_the_scan_of_a_table(spark, tmp_path):
    """Whole row groups outside a range of latitudes are never read; a LIMIT stops a scan early."""
    spark.range(200_000).selectExpr("id", "CAST(id % 97 AS FLOAT) AS v").coalesce(1).write.option("parquet.block.size", 1 << 17).parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    cube = g.TableCube(df, F.col("id"), {"value": F.col("v")}, (2000, 100), ("lat", "lon"))
    options = {"grid": {"nx": 100, "ny": 2000, "lat0": 0.0, "lon0": 0.0, "dlat": 0.01, "dlon": 1.0, "order": "separate"}, "spatial_axes": ["lat", "lon"]}
    some = g.read_array(spark, cube, where="lat BETWEEN 5 AND 5.095", **options)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50000)" in plan and "LessThanOrEqual(id,50999)" in plan
    assert len(some.collect()) == some.count() == 1000
    (read,) = g.finished_scan_metrics(some).collect()
    assert read["status"] == "finished" and read["scan_complete"] and read["rows_read"] < 100_000 and read["bytes"] > 0
    few = g.read_array(spark, cube, **options).limit(5)
    assert g.finished_scan_metrics(few).first()["status"] == "planned"
    assert len(few.collect()) == 5
    (read,) = g.finished_scan_metrics(few).collect()
    assert read["status"] == "finished" and not read["scan_complete"]


def test_a_large_chunk_with_holes_and_repeats(spark, tmp_path):
    n = 256 * 256
    cells = spark.range(n).where("id % 5 <> 2").selectExpr("id AS logical_index", "CAST(id AS FLOAT) AS value", "CAST(-id AS FLOAT) AS other")
    again = cells.where("logical_index < 100").selectExpr("logical_index", "value - 1 AS value", "other")
    path = g.write_cells(cells.unionAll(again), f"{tmp_path}/cube", (256, 256), (256, 256), ["value", "other"], ("y", "x"))
    got = g.read_array(spark, path).collect()
    assert len(got) == n and sum(r["value"] is None for r in got) == len(range(2, n, 5))
    assert all(r["other"] == -r["value"] for r in got if r["value"] is not None)


def test_failures_by_class_not_by_message():
    from gridloom.sources.paths import category_of

    assert category_of([("java.io.FileNotFoundException", None)]) == "object_not_found"
    assert category_of([("java.io.IOException", None), ("java.net.SocketTimeoutException", None)]) == "timeout"
    assert category_of([("com.example.S3Exception", 403)]) == "access_denied"
    assert category_of([("com.example.S3Exception", 500)]) == "http" and category_of([("com.example.S3Exception", 429)]) == "rate_limited"
    assert category_of([("java.io.IOException", None)]) == "transport" == category_of([])


def test_range_settings_reach_hadoop(spark):
    """What a session's Parquet reads take as their configuration holds the settings."""
    try:
        for name, value in (("remote_merge_gap", 1 << 16), ("remote_max_request", 1 << 20), ("async_max_inflight", 4), ("remote_merge", False)):
            settings.put(spark, name, value)
            conf = spark._jsparkSession.sessionState().newHadoopConf()
            assert conf.get(settings.HADOOP[name]) == str(value).lower() and settings.get(spark, name) == value
        with pytest.raises(BindError):
            settings.put(spark, "remote_max_request", 1)
    finally:
        for name in settings.HADOOP:
            spark.conf.unset(f"gridloom.{name}")
            spark.conf.unset(settings.HADOOP[name])
