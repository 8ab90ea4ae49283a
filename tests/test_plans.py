"""Settings, the scan ledger, index ranges and metadata rules, without data."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.errors import BindError
from gridloom.plans import select, settings
from gridloom.plans.identity import encode
from gridloom.plans.meta import CubeMeta, Variable, column_name, encode_segment


def test_settings(spark):
    assert settings.get(spark, "remote_merge_gap") == 4096 and settings.get(spark, "revalidate_metadata") is False
    settings.put(spark, "remote_merge_gap", 0)
    settings.put(spark, "async_io", False)
    assert settings.get(spark, "remote_merge_gap") == 0 and settings.get(spark, "async_io") is False
    for name, value in (("async_max_inflight", 257), ("remote_max_request", 511), ("max_threads", -1), ("async_io", 1), ("async_prefetch_batches", True), ("nothing", 1)):
        with pytest.raises(BindError):
            settings.put(spark, name, value)


@given(st.lists(st.booleans(), max_size=60))
def test_ranges(mask):
    ranges = select.ranges_of(np.array(mask, bool))
    assert [i for a, b in ranges for i in range(a, b + 1)] == [i for i, m in enumerate(mask) if m]
    assert select.joined(ranges) == ranges


def test_too_many_ranges_only_grow():
    ranges = [(3 * i, 3 * i) for i in range(select.MAX_RANGES + 500)]
    joined = select.joined(ranges)
    assert len(joined) <= select.MAX_RANGES
    kept = {i for a, b in joined for i in (a, b)}
    assert min(kept) == 0 and max(kept) == ranges[-1][1]
    assert all(any(a <= x <= b for a, b in joined) for x, _ in ranges[::97])


@given(st.floats(allow_nan=False), st.floats(allow_nan=False), st.sampled_from(["=", "<", "<=", ">", ">="]))
def test_interval_is_the_comparison(value, constant, op):
    i = select.Interval()
    i.meet(op, constant)
    want = {"=": value == constant, "<": value < constant, "<=": value <= constant, ">": value > constant, ">=": value >= constant}[op]
    assert bool(i.mask(np.array([value]))[0]) == want


@pytest.mark.parametrize(
    ("where", "reason"),
    [
        ("lat > 1 OR lat < 0", "unsafe_or_expression"),
        ("lon > 1 OR lon < 0 OR lon = 5", "unsafe_or_expression"),
        ("(lon > 1 OR lon < 0) AND (lon > 2 OR lon < -1)", "unsupported_or_expression"),
        ("NOT (lat > 1)", "unsupported_boolean_expression"),
        ("lat > lon", "unsupported_comparison_operand"),
        ("lat BETWEEN lon AND 3", "unsupported_between_operand"),
        ("abs(lat) IN (1)", "unsupported_filter_expression"),
    ],
)
def test_fallback_reasons(spark, where, reason):
    assert reason in select.extract(spark, where, []).reasons


def test_conditions(spark):
    c = select.extract(spark, "lat > -1.5 AND 3 >= lat AND lon BETWEEN CAST(2 AS DOUBLE) AND 7e0 AND other = 1", [])
    assert (c.intervals["lat"].low, c.intervals["lat"].high, c.intervals["lat"].low_open) == (-1.5, 3, True)
    assert (c.intervals["lon"].low, c.intervals["lon"].high) == (2, 7)
    c = select.extract(spark, "lon >= 179 OR lon < -179", [])
    assert [(i.low, i.high) for i in c.union] == [(179, float("inf")), (-float("inf"), -179)]


def test_names_and_alignment():
    assert column_name("") == "value" and column_name("/a/b") == "a/b" and encode_segment("x/%") == "x%2F%25"
    a, b = Variable("/a", (2, 3), (1, 2), ("x", "y")), Variable("/B", (2, 3), (2, 3), ("x", "y"))
    assert CubeMeta((a, b)).names == ["B", "a"]
    for wrong in ((a, Variable("/A", (2, 3), (1, 2), ("x", "y"))), (a, Variable("/c", (3, 2), (1, 2), ("x", "y"))), (a, Variable("/c", (2, 3), (1, 2), ("y", "x"))), ()):
        with pytest.raises(BindError):
            CubeMeta(wrong)
    for shape, chunks, axes in (((), (), None), ((2, 0), (1, 1), None), ((2,), (3,), None), ((1,) * 9, (1,) * 9, None), ((2, 2), (1, 1), ("x", "x"))):
        with pytest.raises(BindError):
            Variable("/v", shape, chunks, axes)


def test_encoding_tells_values_apart():
    values = [1, 1.0, "1", True, None, [1], [[1]], {"a": 1}, {"a": [1]}, [], "", 0, -1]
    assert len({encode(v) for v in values}) == len(values)
    assert encode({"a": 1, "b": 2}) == encode({"b": 2, "a": 1}) and encode(-0.0) == encode(0.0)
