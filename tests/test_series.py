"""Chunked time series."""

import datetime as dt

import numpy as np
import pytest

import gridloom as g
from gridloom.errors import BindError, SourceError
from gridloom.plans import series as plans

HOUR = dt.timedelta(hours=1)
OPTIONS = {
    "model": "ecmwf_ifs",
    "chunk_time_length": 4,
    "dimensions": ["lead", "point", "time"],
    "grid": {"nx": 3, "ny": 2, "lat0": 10.0, "lon0": 100.0, "dlat": 1.0, "dlon": 1.0, "order": "lon_fastest"},
    "spatial_axes": ["point"],
}
EPOCH = dt.datetime(1970, 1, 1)


def chunk(n):
    point, slot = np.meshgrid(range(6), range(4), indexing="ij")
    v = (1000.0 * n + 100 * point + slot)[None]
    if n == 1:
        v[0, 2, 1] = np.nan
    return v.astype(np.float32)


@pytest.fixture(scope="module")
def prefix(spark, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('series')}/temperature"
    for n in (-1, 0, 1, 2):
        g.write_cube(spark, f"{root}/{plans.key(n)}", {"": chunk(n)}, (1, 3, 2))
    return root


def at(h):
    return EPOCH + h * HOUR


def test_window(spark, prefix):
    df = g.read_series(spark, prefix, valid_times=[at(3), at(5)], **OPTIONS)
    assert df.columns == ["value", "lat", "lon", "valid_time"]
    assert df.count() == 18 and df.where("value IS NULL").count() == 1
    assert {r["count"] for r in df.groupBy("valid_time").count().collect()} == {6}
    assert df.where("lat = 10 AND lon = 101 AND valid_time = TIMESTAMP_NTZ '1970-01-01 04:00:00'").first()["value"] == 1100.0
    assert g.read_series(spark, prefix, start=at(3), end=at(5), where="lat = 11", **OPTIONS).count() == 9


def test_times_before_1970(spark, prefix):
    df = g.read_series(spark, prefix, valid_times=[at(-2), at(0)], **OPTIONS)
    assert sorted(r[0] for r in df.where("lat = 10 AND lon = 100").select("value").collect()) == [-998.0, -997.0, 0.0]


def test_absent_objects(spark, prefix):
    assert g.read_series(spark, prefix, valid_times=[at(11), at(40)], **OPTIONS).count() == 6
    with pytest.raises(SourceError):
        g.read_series(spark, prefix, valid_times=[at(11), at(40)], strict=True, **OPTIONS)
    none = g.read_series(spark, prefix, valid_times=[at(400), at(401)], include_source=True, **OPTIONS)
    assert none.columns == ["value", "lat", "lon", "valid_time", "om_source"] and none.count() == 0


@pytest.mark.parametrize("change", [{"axes": {}}, {"model": None}, {"chunk_time_length": 0}, {"time_step": dt.timedelta(milliseconds=1)}, {"dimensions": ["a", "b", "c"]}, {"valid_times": [at(1)]}, {"valid_times": [at(2), at(1)]}, {"start": at(1)}, {"chunk_time_length": 3}])
def test_wrong_declarations(spark, prefix, change):
    with pytest.raises(BindError):
        g.read_series(spark, prefix, **({"valid_times": [at(3), at(5)]} | OPTIONS | change))


@pytest.mark.parametrize("path", ["", "/a/*", "/a/x.om", "/a/data_run/b", "/a//", "/a?b"])
def test_wrong_prefixes(spark, path):
    with pytest.raises((BindError, SourceError)):
        plans.prefix(path)


def test_plan():
    lay = plans.layout("dwd_icon", None, None)
    assert (lay.slots, lay.step) == (253, 3_600_000_000)
    assert plans.key(-1) == "chunk_-001.om" and plans.key(12) == "chunk_0012.om"
    lay = plans.layout(None, 4, HOUR)
    got = plans.candidates(plans.window([at(-1), at(4)], None, None), lay)
    assert [(c.number, c.first, c.last) for c in got] == [(-1, 3, 3), (0, 0, 3), (1, 0, 0)]
    between = plans.window([at(0) + HOUR / 4, at(0) + HOUR / 2], None, None)
    assert plans.candidates(between, lay)[0].empty
    with pytest.raises(BindError):
        plans.candidates(plans.window([at(0), at(4 * 5000)], None, None), lay)
    assert len(plans.MODELS) == 11
