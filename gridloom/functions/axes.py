"""Semantic axes: labels of time, level, lead time, member and run for the positions of an array axis."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import BindError

#: Output names in their order.
OUTPUT = {"time": "valid_time", "level": "level", "lead_time": "lead_time", "member": "member", "run": "run"}
LEVEL_UNITS = {"pressure": ("Pa", "hPa"), "height": ("m",), "model": ("1",)}
_EPOCH = dt.datetime(1970, 1, 1)
_MICRO = dt.timedelta(microseconds=1)
_INT64 = 1 << 63


def bad(message: str) -> BindError:
    return BindError("axes", message)


def utc(value: object, name: str) -> dt.datetime:
    """A naive UTC time; aware times are converted."""
    if not isinstance(value, dt.datetime):
        raise bad(f"{name} must be a timestamp")
    return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value


def micros(value: dt.datetime) -> int:
    return (value - _EPOCH) // _MICRO


def _duration(value: object, name: str) -> int:
    if not isinstance(value, dt.timedelta):
        raise bad(f"{name} must be an interval without months")
    return value // _MICRO


def _integer(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not -_INT64 <= value < _INT64:
        raise bad(f"{name} must be a 64-bit integer")
    return value


def _number(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise bad(f"{name} must be a finite number")
    if isinstance(value, int) and int(float(value)) != value:
        raise bad(f"{name} has no exact double")
    return float(value)


@dataclass(frozen=True)
class SemanticAxis:
    """Labels of one kind for an axis: ``values``, or ``start`` and ``step``; times and durations in microseconds."""

    kind: str
    axis: str
    length: int
    values: tuple | None = None
    start: float | int | None = None
    step: float | int | None = None
    level_kind: str | None = None
    unit: str | None = None

    @property
    def output(self) -> str:
        return OUTPUT[self.kind]

    def label(self, i: int):
        """The label at a position, in plain numbers or text."""
        return self.values[i] if self.values is not None else self.start + self.step * i

    def column(self, index: Column) -> Column:
        """The label as an expression over the axis index."""
        if self.kind == "member" and self.values and isinstance(self.values[0], str):
            return F.element_at(F.array(*map(F.lit, self.values)), (index + 1).cast("int"))
        if self.values is None:
            number = F.lit(self.start) + index.cast("double" if self.kind == "level" else "long") * F.lit(self.step)
        else:
            number = F.element_at(F.array(*map(F.lit, self.values)), (index + 1).cast("int"))
        if self.kind in ("time", "run"):
            return F.timestamp_add("MICROSECOND", number, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        if self.kind == "lead_time":
            return number * F.lit(dt.timedelta(microseconds=1))
        return number.cast("long") if self.kind == "member" else number


def _check_level(number: float, kind: str) -> float:
    if kind == "pressure" and number <= 0:
        raise bad("pressure levels must be positive")
    if kind == "model" and number != math.trunc(number):
        raise bad("model levels must be whole")
    return number


def bind_axis(kind: str, spec: dict, length: int) -> SemanticAxis:
    """Checks one declaration: ``axis`` and either ``values`` or ``start`` and ``step``; levels also have ``kind`` and ``unit``."""
    if kind not in OUTPUT:
        raise bad(f"unknown semantic key {kind!r}")
    if not isinstance(spec, dict):
        raise bad(f"axes.{kind} must be a struct")
    named = {"axis"} | ({"kind", "unit"} if kind == "level" else set())
    rest = set(spec) - named
    if not named <= set(spec) or rest not in ({"values"}, {"start", "step"}):
        raise bad(f"axes.{kind} needs {', '.join(sorted(named))} and either values or start and step")
    more = {}
    if kind == "level":
        if spec["unit"] not in LEVEL_UNITS.get(spec["kind"], ()):
            raise bad(f"level kind and unit {spec['kind']}/{spec['unit']} are not supported")
        more = {"level_kind": spec["kind"], "unit": spec["unit"]}
    read = {
        "time": lambda v, n: micros(utc(v, n)),
        "run": lambda v, n: micros(utc(v, n)),
        "lead_time": _duration,
        "level": _number,
        "member": _integer,
    }[kind]
    if "values" in spec:
        values = spec["values"]
        if not isinstance(values, (list, tuple)) or len(values) != length:
            raise bad(f"axes.{kind} needs {length} values")
        if kind == "member" and all(isinstance(v, str) for v in values):
            return SemanticAxis(kind, spec["axis"], length, tuple(values))
        got = tuple(read(v, f"axes.{kind} value") for v in values)
        if kind == "level":
            got = tuple(_check_level(v, spec["kind"]) for v in got)
        return SemanticAxis(kind, spec["axis"], length, got, **more)
    start = read(spec["start"], "start")
    step = _duration(spec["step"], "step") if kind in ("time", "run") else read(spec["step"], "step")
    last = start + step * (length - 1)
    if kind == "level":
        if not math.isfinite(last):
            raise bad("the last level is not finite")
        for v in (start, last, *([start + step] if length > 1 else [])):
            _check_level(v, spec["kind"])
    elif not -_INT64 <= last < _INT64:
        raise bad(f"axes.{kind} overflows")
    return SemanticAxis(kind, spec["axis"], length, None, start, step, **more)


def bind_axes(specs: dict | None, names: tuple[str, ...] | None, shape: tuple[int, ...], spatial: tuple[str, ...]) -> list[SemanticAxis]:
    """All declared semantic axes, in the order of their output columns."""
    if not specs:
        return []
    if names is None:
        raise bad("semantic axes need declared dimensions")
    out, used = [], set()
    for kind in OUTPUT:
        if kind in specs:
            axis = specs[kind].get("axis") if isinstance(specs[kind], dict) else None
            if axis not in names or axis in spatial or axis in used:
                raise bad(f"axes.{kind} must name a dimension of its own that is not spatial")
            used.add(axis)
            out.append(bind_axis(kind, specs[kind], shape[names.index(axis)]))
    if unknown := set(specs) - set(OUTPUT):
        raise bad(f"unknown semantic key {sorted(unknown)[0]!r}")
    return out
