"""Grids against landmarks, and expressions against NumPy."""

import numpy as np
import pytest

from gridloom.errors import BindError
from gridloom.functions.grids import FLOAT32, FLOAT64, GaussianRow, LambertGrid, RotatedGrid, Segment, StereographicGrid, gaussian, parse_grid
from gridloom.plans import domains
from gridloom.plans.identity import grid_id


@pytest.mark.parametrize(
    ("name", "x", "y", "lon", "lat"),
    [
        ("gem_rdps_10km", 597, 892, -26.3572083, 89.9515381),
        ("aladin_central_europe_2km", 0, 0, 1.3339996, 38.5990028),
        ("gem_regional", 0, 0, -142.8925781, 18.1450310),
    ],
)
def test_landmarks(name, x, y, lon, lat):
    got = domains.domain(name).coordinates_of(np.array([x]), np.array([y]))
    assert abs(got[0][0] - lat) < 1e-4 and abs(got[1][0] - lon) < 1e-4


def test_domains():
    assert len(domains.REGULAR) == 68
    assert domains.domain("ecmwf_seas5").points == 421120
    assert domains.domain("n160").points == 138346
    assert domains.domain("ecmwf_ifs").points == 6599680
    assert domains.domain("ncep_gfs025").nx == 1440
    for name in ("n320", "nothing"):
        with pytest.raises(BindError):
            domains.domain(name)


def test_supplied_rows(monkeypatch):
    """N320 and its region follow from the row table that a caller gives."""
    assert len(domains.N160_ROWS) == 160 and 2 * sum(domains.N160_ROWS) == 138346
    for wrong in ([1, 2], [800] * 320):
        with pytest.raises(BindError):
            domains.supply_rows("N320", wrong)
    with pytest.raises(BindError):
        domains.supply_rows("N80", [800] * 320)
    counts = [18 + 5 * i for i in range(320)]
    counts[-1] += 271_040 - sum(counts)
    monkeypatch.setattr(domains, "_supplied", {})
    try:
        domains.supply_rows("N320", counts)
        whole, part = domains.domain("n320"), domains.domain(domains.N320_REGION)
        assert whole.points == 542_080 and len(whole.rows) == 640
        lat, lon = part.coordinates_of(*part.xy_of(np.arange(part.points)))
        assert lon.min() >= -11 and lon.max() <= 37 and abs(lat.max() - 70.9601) < 1e-3 and abs(lat.min() - 33.0211) < 1e-3
        all_lat, all_lon = whole.coordinates_of(*whole.xy_of(np.arange(whole.points)))
        assert part.points == ((all_lon >= -11) & (all_lon <= 37) & (all_lat >= lat.min()) & (all_lat <= lat.max())).sum()
        first = part.rows[67].point_count
        assert lon[0] < 0 and part.segments[1].parent_begin == 0 and part.segments[0].parent_begin + part.segments[0].count == first
    finally:
        domains.domain.cache_clear()
        domains._gaussian.cache_clear()


GRIDS = [
    RotatedGrid(20, 30, policy=FLOAT64, x0=-5.0, y0=-7.0, dx=0.5, dy=0.5, north_pole_latitude=39.25, north_pole_longitude=-162.0, rotation=10.0),
    LambertGrid(20, 30, policy=FLOAT64, x0=-5e5, y0=-4e5, dx=3e4, dy=3e4, central_meridian=10.0, latitude_of_origin=50.0, standard_parallel_1=40.0, standard_parallel_2=60.0),
    StereographicGrid(21, 31, policy=FLOAT64, x0=-1e6, y0=-1.5e6, dx=1e5, dy=1e5, central_meridian=20.0, latitude_of_origin=70.0, scale_factor=0.9),
    domains.domain("gem_regional"),
    domains.domain("jma_gsm"),
]


@pytest.mark.parametrize("grid", GRIDS, ids=lambda g: f"{g.kind}-{g.policy}")
def test_expressions_agree_with_numpy(spark, grid):
    pos = spark.range(min(600, grid.nx * grid.ny)).selectExpr("id", f"id % {grid.nx} AS x", f"id div {grid.nx} AS y")
    lat, lon = grid.coordinates(pos.x, pos.y)
    got = np.array(pos.select("x", "y", lat.alias("lat"), lon.alias("lon")).collect(), float)
    want = grid.coordinates_of(got[:, 0].astype(int), got[:, 1].astype(int))
    assert np.allclose(got[:, 2], want[0], atol=1e-9) and np.allclose(got[:, 3], want[1], atol=1e-9)


@pytest.mark.parametrize("policy", [FLOAT64, FLOAT32])
def test_native_latitudes_beyond_poles(policy):
    """A column that goes on across a native pole meets the points of the opposite meridian."""
    more = {"dx": 90.0, "dy": 30.0, "north_pole_latitude": 39.25, "north_pole_longitude": -162.0, "rotation": 10.0, "policy": policy}
    with pytest.raises(BindError):
        RotatedGrid(4, 13, x0=0.0, y0=-75.0, **more)
    tall = RotatedGrid(4, 13, x0=0.0, y0=-75.0, beyond_poles=True, **more)
    y, x = np.divmod(np.arange(tall.points), 4)
    native = -75.0 + 30 * y
    over = (native > 90) & (native < 270)
    plain = RotatedGrid(4, 6, x0=0.0, y0=-75.0, **more)
    row = np.where(over, (180 - native + 75) / 30, (native - np.where(native >= 270, 360, 0) + 75) / 30).astype(int)
    got, want = tall.coordinates_of(x, y), plain.coordinates_of((x + np.where(over, 2, 0)) % 4, row)
    turn = (np.asarray(got[1], float) - want[1] + 180) % 360 - 180
    assert np.abs(got[0] - want[0]).max() < 1e-4 and np.abs(turn).max() < 1e-4


ROWS = (GaussianRow(60.0, 3, 0.0, 120.0), GaussianRow(20.0, 5, 0.0, 72.0), GaussianRow(-20.0, 5, 0.0, 72.0), GaussianRow(-60.0, 3, 0.0, 120.0))


def test_gaussian(spark):
    whole = gaussian(2, "explicit_v1", ROWS)
    part = gaussian(2, "explicit_v1", ROWS, (Segment(1, 4, 1), Segment(1, 0, 2), Segment(2, 0, 2)))
    assert whole.points == 16 and part.points == 5
    assert part.parent_of(np.arange(5)).tolist() == [7, 3, 4, 8, 9]
    pos = spark.range(5)
    lat, lon = part.coordinates(*part.xy(pos.id))
    got = [tuple(r) for r in pos.select(lat.alias("lat"), lon.alias("lon"), part.parent(pos.id).alias("p")).collect()]
    assert got == [(20.0, -72.0, 7), (20.0, 0.0, 3), (20.0, 72.0, 4), (-20.0, 0.0, 8), (-20.0, 72.0, 9)]
    for wrong in ((Segment(0, 2, 2),), (Segment(0, 0, 2), Segment(0, 1, 1)), (Segment(4, 0, 1),)):
        with pytest.raises(BindError):
            gaussian(2, "explicit_v1", ROWS, wrong)
    with pytest.raises(BindError):
        gaussian(2, "explicit_v1", ROWS[::-1])


GOOD = {"nx": 2, "ny": 2, "lat0": 0.0, "lon0": 0.0, "dlat": 1.0, "dlon": 1.0, "order": "separate"}


@pytest.mark.parametrize("change", [{"nx": 0}, {"nx": None}, {"lat0": float("nan")}, {"dlat": 0.0}, {"order": "x_fastest"}, {"lat0": 90.0}, {"more": 1}, {"nx": True}])
def test_wrong_regular_declarations(change):
    with pytest.raises(BindError):
        parse_grid(GOOD | change)


def test_version_one():
    spec = {
        "version": 1,
        "type": "reduced_gaussian",
        "numeric_policy": "float64_v1",
        "earth": {"model": "wgs84", "semi_major_m": 6378137.0, "inverse_flattening": 298.257223563},
        "layout": {"order": "row_major"},
        "parameters": {"n": 2, "latitude_rule": "explicit_v1", "rows": [r.__dict__ for r in ROWS], "subset_segments": None},
    }
    assert parse_grid(spec).points == 16
    for change in ({"version": 2}, {"type": "hexagons"}, {"numeric_policy": "x"}, {"layout": {"order": "separate"}}, {"earth": {"model": "sphere"}}, {"extra": 1}):
        with pytest.raises(BindError):
            parse_grid(spec | change)
    # the storage order is no part of the grid's identity, the policy is
    a = parse_grid(GOOD)
    assert grid_id(a) == grid_id(parse_grid(GOOD | {"order": "lon_fastest"})) != grid_id(parse_grid(spec))


GAUSSIAN_WKT = (
    'GEOGCRS["Reduced Gaussian Grid",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563]],CS[ellipsoidal,2],'
    'AXIS["latitude",north],AXIS["longitude",east],ANGLEUNIT["degree",0.0174532925199433],REMARK["Reduced Gaussian Grid O320 (ECMWF)"]]'
)


def test_reference_systems():
    assert domains.gaussian_profile(None) == ("none", None)
    assert domains.gaussian_profile(GAUSSIAN_WKT) == ("gaussian_wgs84", 320)
    assert domains.gaussian_profile(GAUSSIAN_WKT.replace("6378137", "6378136"))[0] == "unknown"
    assert domains.gaussian_profile("GEOGCRS[nonsense")[0] == "unknown"
    assert domains.check_profile(GAUSSIAN_WKT, domains.domain("ecmwf_seas5")) == "compatible"
    with pytest.raises(BindError):
        domains.check_profile(GAUSSIAN_WKT, domains.domain("n160"))
    grid = parse_grid(GOOD)
    domains.check_bbox('GEOGCRS["x",USAGE[AREA["a"],BBOX[0.0005,0,1,1]]]', grid)
    with pytest.raises(BindError):
        domains.check_bbox('GEOGCRS["x",USAGE[AREA["a"],BBOX[0.01,0,1,1]]]', grid)
