"""Grids: where each point of an array lies on the earth.

A grid gives latitude and longitude as Column expressions over the axis indices, so that filters on them are ordinary
predicates, and as NumPy functions, which the driver uses for pruning and validation. Double-precision regular and
projected grids stay inside Catalyst. Single-precision policies and reduced Gaussian rows are Arrow-batched functions,
since Spark computes its trigonometry in double precision and has no lookup by binary search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import BindError

# Names of options.
FLOAT64, FLOAT32 = "float64_v1", "openmeteo_f32_v1"
SEPARATE, X_FASTEST, Y_FASTEST, ROW_MAJOR = "separate", "x_fastest", "y_fastest", "row_major"
LEGACY_ORDERS = {"separate": SEPARATE, "lon_fastest": X_FASTEST, "lat_fastest": Y_FASTEST}
LATITUDE_RULES = ("openmeteo_approx_v1", "legendre_roots_v1", "explicit_v1")
SPHERE_RADIUS_M = 6371229.0
WGS84 = (6378137.0, 298.257223563)
MAX_POINTS = 1 << 53


def bad(message: str) -> BindError:
    return BindError("grid", message)


def finite(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, np.integer, np.floating)) or not math.isfinite(value):
        raise bad(f"{name} must be a finite number")
    return float(value)


def extent(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, np.integer)) or value <= 0 or value >= MAX_POINTS:
        raise bad(f"{name} must be a positive integer")
    return int(value)


def normalized_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180); the remainder keeps the sign of the dividend."""
    rest = lon % F.lit(360.0)
    return F.when(rest < -180.0, rest + 360.0).when(rest >= 180.0, rest - 360.0).otherwise(rest)


def normalized(lon: np.ndarray) -> np.ndarray:
    """The same on arrays, in the precision of the input."""
    kind = np.asarray(lon).dtype.type
    rest = np.fmod(lon, kind(360))
    rest = np.where(rest < kind(-180), rest + kind(360), rest)
    return np.where(rest >= kind(180), rest - kind(360), rest).astype(kind)


@dataclass(frozen=True)
class Earth:
    """A sphere, or the fixed WGS84 ellipsoid as the source's datum."""

    model: str = "sphere"
    radius_m: float = SPHERE_RADIUS_M
    semi_major_m: float | None = None
    inverse_flattening: float | None = None

    def __post_init__(self) -> None:
        if self.model == "sphere":
            if finite(self.radius_m, "earth.radius_m") <= 0:
                raise bad("earth.radius_m must be positive")
        elif self.model == "wgs84":
            if (self.semi_major_m, self.inverse_flattening) != WGS84:
                raise bad("earth.model wgs84 has fixed axes")
        else:
            raise bad("earth.model must be sphere or wgs84")


@dataclass(frozen=True)
class Grid:
    """nx * ny points in a storage order. Subclasses give coordinates by column x and row y."""

    nx: int
    ny: int
    order: str = SEPARATE
    policy: str = FLOAT64
    earth: Earth = field(default_factory=Earth)

    kind = ""

    def _check(self) -> None:
        extent(self.nx, "nx")
        extent(self.ny, "ny")
        if self.nx * self.ny >= MAX_POINTS:
            raise bad("the grid has too many points")
        if self.order not in (SEPARATE, X_FASTEST, Y_FASTEST):
            raise bad("the storage order must be separate, x_fastest or y_fastest")
        if self.policy not in (FLOAT64, FLOAT32):
            raise bad(f"numeric_policy must be {FLOAT64} or {FLOAT32}")

    @property
    def points(self) -> int:
        return self.nx * self.ny

    def xy(self, point: Column) -> tuple[Column, Column]:
        """Column and row of a flattened point."""
        if self.order == Y_FASTEST:
            return _div(point, self.ny), point % self.ny
        return point % self.nx, _div(point, self.nx)

    def xy_of(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.order == Y_FASTEST:
            return point // self.ny, point % self.ny
        return point % self.nx, point // self.nx

    def point(self, x: Column, y: Column) -> Column:
        """The point's place in the storage order; row-major if axes are separate."""
        return x * self.ny + y if self.order == Y_FASTEST else y * self.nx + x

    def coordinates(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude."""
        both = _arrow_coordinates(self)(x, y)
        return both.getField("lat"), both.getField("lon")

    def coordinates_of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def definition(self) -> dict:
        """What identifies the grid, in plain values."""
        raise NotImplementedError

    def validate(self, window: int = 1 << 16) -> None:
        """Every point must have finite coordinates with a latitude on the earth."""
        for start in range(0, self.points, window):
            at = np.arange(start, min(self.points, start + window))
            lat, lon = self.coordinates_of(*self.xy_of(at))
            if not (np.isfinite(lat).all() and np.isfinite(lon).all()):
                raise bad("the grid has a point without finite coordinates")


def _div(a: Column, b: int) -> Column:
    """Whole division of non-negative numbers."""
    return F.call_function("div", a, F.lit(b))


def _arrow_coordinates(grid: Grid):
    """An Arrow-batched function of column and row."""

    @F.pandas_udf("lat double, lon double")
    def both(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        lat, lon = grid.coordinates_of(x.to_numpy(), y.to_numpy())
        return pd.DataFrame({"lat": lat.astype(float), "lon": lon.astype(float)})

    return both


@dataclass(frozen=True)
class RegularGrid(Grid):
    """Equal steps in latitude and longitude."""

    lat0: float = 0.0
    lon0: float = 0.0
    dlat: float = 1.0
    dlon: float = 1.0
    beyond_poles: bool = False

    kind = "regular_latlon"

    def __post_init__(self) -> None:
        self._check()
        for name in ("lat0", "lon0", "dlat", "dlon"):
            finite(getattr(self, name), name)
        if self.dlat == 0 or self.dlon == 0:
            raise bad("dlat and dlon must not be zero")
        last = self.lat0 + (self.ny - 1) * self.dlat
        if not math.isfinite(last) or not math.isfinite(self.lon0 + (self.nx - 1) * self.dlon):
            raise bad("the grid's extent is not finite")
        if not self.beyond_poles and (min(self.lat0, last) < -90 or max(self.lat0, last) > 90):
            raise bad("latitudes must lie within [-90, 90]")

    def coordinates(self, x: Column, y: Column) -> tuple[Column, Column]:
        lat = F.lit(self.lat0) + y.cast("double") * F.lit(self.dlat)
        return lat, normalized_longitude(F.lit(self.lon0) + x.cast("double") * F.lit(self.dlon))

    def coordinates_of(self, x, y):
        return self.lat0 + np.asarray(y, float) * self.dlat, normalized(self.lon0 + np.asarray(x, float) * self.dlon)

    def validate(self, window: int = 1 << 16) -> None:
        """Affine axes are finite where their ends are."""

    def definition(self) -> dict:
        return {"type": self.kind, "nx": self.nx, "ny": self.ny, "lat0": self.lat0, "lon0": self.lon0, "dlat": self.dlat, "dlon": self.dlon}


@dataclass(frozen=True)
class ProjectedGrid(Grid):
    """Equal steps x, y in a projection; coordinates by the inverse projection."""

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0

    def _check(self) -> None:
        super()._check()
        for name in self._numbers():
            finite(getattr(self, name), name)
        if self.dx == 0 or self.dy == 0:
            raise bad("dx and dy must not be zero")
        if self.earth.model != "sphere":
            raise bad(f"{self.kind} requires a sphere")

    def _numbers(self) -> tuple[str, ...]:
        return ("x0", "y0", "dx", "dy")

    def definition(self) -> dict:
        return {"type": self.kind, "nx": self.nx, "ny": self.ny} | {n: getattr(self, n) for n in self._numbers()}

    def _native(self, x, y, kind):
        return kind(self.x0) + np.asarray(x).astype(kind) * kind(self.dx), kind(self.y0) + np.asarray(y).astype(kind) * kind(self.dy)

    def coordinates_of(self, x, y):
        kind = np.float32 if self.policy == FLOAT32 else np.float64
        with np.errstate(all="ignore"):
            lat, lon = self._inverse(*self._native(x, y, kind), kind)
        return lat, normalized(lon)

    def coordinates(self, x: Column, y: Column) -> tuple[Column, Column]:
        if self.policy == FLOAT32:
            return super().coordinates(x, y)
        lat, lon = self.unwound(x, y)
        return lat, normalized_longitude(lon)

    def unwound(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude in double precision, before longitudes are brought into [-180, 180)."""
        return self._columns(F.lit(self.x0) + x.cast("double") * F.lit(self.dx), F.lit(self.y0) + y.cast("double") * F.lit(self.dy))

    def _inverse(self, u, v, kind):
        raise NotImplementedError

    def _columns(self, u: Column, v: Column) -> tuple[Column, Column]:
        raise NotImplementedError


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


@dataclass(frozen=True)
class RotatedGrid(ProjectedGrid):
    """Latitude and longitude about a moved pole. Beyond a native pole, where allowed, a column goes on across it."""

    north_pole_latitude: float = 90.0
    north_pole_longitude: float = 0.0
    rotation: float = 0.0
    beyond_poles: bool = False

    kind = "rotated_latlon"

    def __post_init__(self) -> None:
        self._check()
        if abs(self.north_pole_latitude) > 90:
            raise bad("north_pole_latitude must lie within [-90, 90]")
        ends = (self.y0, self.y0 + (self.ny - 1) * self.dy)
        if not self.beyond_poles and (min(ends) < -90 or max(ends) > 90):
            raise bad("native latitudes must lie within [-90, 90]")

    def _numbers(self):
        return (*super()._numbers(), "north_pole_latitude", "north_pole_longitude", "rotation")

    def _inverse(self, u, v, kind):
        if kind is np.float32:
            # single precision uses its own closed form, with the rotation counted from 180 degrees
            deg, pi = lambda a: a * kind(math.pi) / kind(180), kind(math.pi)
            tilt, turn = deg(kind(90) + kind(self.north_pole_latitude)), deg(kind(self.north_pole_longitude))
            lon, lat = deg(u + (kind(self.rotation) - kind(180))), deg(v)
            sine = np.cos(tilt) * np.sin(lat) - np.cos(lon) * np.sin(tilt) * np.cos(lat)
            out = -np.arcsin(np.clip(sine, kind(-1), kind(1)))
            across, along = np.sin(lon), np.tan(lat) * np.sin(tilt) + np.cos(lon) * np.cos(tilt)
            if self.beyond_poles:
                # both are divided by the cosine of the native latitude, which is negative there
                back = np.cos(lat) < 0
                across, along = np.where(back, -across, across), np.where(back, -along, along)
            east = -(np.arctan2(across, along) - turn)
            return out * kind(180) / pi, east * kind(180) / pi
        x, y, z = self._vector(np, np.radians(v), np.radians(u + self.rotation))
        lat = np.degrees(np.arcsin(np.clip(z, -1.0, 1.0)))
        return lat, np.where(np.hypot(x, y) <= 1e-15, 0.0, np.degrees(np.arctan2(y, x)))

    def _vector(self, m, lat, lon):
        """The point as a unit vector, in the functions of ``m``."""
        p, q = math.radians(self.north_pole_latitude), math.radians(self.north_pole_longitude)
        along, across, up = m.cos(lat) * m.cos(lon), m.cos(lat) * m.sin(lon), m.sin(lat)
        forward = along * math.sin(p) + up * math.cos(p)
        return forward * math.cos(q) - across * math.sin(q), forward * math.sin(q) + across * math.cos(q), up * math.sin(p) - along * math.cos(p)

    def _columns(self, u, v):
        x, y, z = self._vector(F, F.radians(v), F.radians(u + F.lit(self.rotation)))
        return F.degrees(F.asin(_clamp(z))), F.when(F.hypot(x, y) <= 1e-15, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x)))


@dataclass(frozen=True)
class LambertGrid(ProjectedGrid):
    """Lambert conformal conic on a sphere."""

    central_meridian: float = 0.0
    latitude_of_origin: float = 45.0
    standard_parallel_1: float = 45.0
    standard_parallel_2: float = 45.0

    kind = "lambert_conformal_conic"

    def __post_init__(self) -> None:
        self._check()
        if not -90 < self.latitude_of_origin < 90 or max(abs(self.standard_parallel_1), abs(self.standard_parallel_2)) >= 90:
            raise bad("latitudes of a Lambert grid must lie within (-90, 90)")
        n, f, rho = self._cone(np.float64)
        if not all(map(math.isfinite, (n, f, rho))) or n == 0:
            raise bad("the standard parallels give no cone")

    def _numbers(self):
        return (*super()._numbers(), "central_meridian", "latitude_of_origin", "standard_parallel_1", "standard_parallel_2")

    def _cone(self, kind):
        """Cone constant, scale and the radius of the origin's parallel."""
        a, b, c = (kind(d) * kind(math.pi) / kind(180) for d in (self.standard_parallel_1, self.standard_parallel_2, self.latitude_of_origin))
        half = lambda phi: np.tan(kind(math.pi) / kind(4) + phi / kind(2))
        with np.errstate(all="ignore"):
            n = np.sin(a) if self.standard_parallel_1 == self.standard_parallel_2 else np.log(np.cos(a) / np.cos(b)) / np.log(half(b) / half(a))
            f = np.cos(a) * np.power(half(a), n) / n
            return n, f, f / np.power(half(c), n)

    def _inverse(self, u, v, kind):
        n, f, rho0 = self._cone(kind)
        u, v, pi = u / kind(self.earth.radius_m), v / kind(self.earth.radius_m), kind(math.pi)
        theta = np.arctan2(u, rho0 - v) if n >= 0 else np.arctan2(-u, v - rho0)
        far = np.hypot(u, rho0 - v)
        scale = np.maximum(np.maximum(kind(1), abs(u)), np.maximum(abs(v), abs(rho0)))
        ratio = f / np.copysign(far, n)
        undefined = (far <= kind(8) * np.finfo(kind).eps * scale) | ~(ratio > 0)
        lat = (kind(2) * np.arctan(np.power(ratio, kind(1) / n)) - pi / kind(2)) * kind(180) / pi
        lon = (kind(self.central_meridian) * pi / kind(180) + theta / n) * kind(180) / pi
        return np.where(undefined, kind(np.nan), lat), np.where(undefined, kind(np.nan), lon)

    def _columns(self, u, v):
        n, f, rho0 = map(float, self._cone(np.float64))
        u, v = u / F.lit(self.earth.radius_m), v / F.lit(self.earth.radius_m)
        theta = F.atan2(u, F.lit(rho0) - v) if n >= 0 else F.atan2(-u, v - F.lit(rho0))
        far = F.hypot(u, F.lit(rho0) - v)
        ratio = F.lit(f) / (far if n >= 0 else -far)
        lat = F.degrees(F.lit(2.0) * F.atan(F.pow(ratio, F.lit(1.0 / n))) - F.lit(math.pi / 2))
        return lat, F.degrees(F.lit(math.radians(self.central_meridian)) + theta / F.lit(n))


@dataclass(frozen=True)
class StereographicGrid(ProjectedGrid):
    """Oblique stereographic on a sphere."""

    central_meridian: float = 0.0
    latitude_of_origin: float = 90.0
    scale_factor: float = 1.0

    kind = "stereographic"

    def __post_init__(self) -> None:
        self._check()
        if abs(self.latitude_of_origin) > 90 or self.scale_factor <= 0:
            raise bad("latitude_of_origin or scale_factor is out of range")

    def _numbers(self):
        return (*super()._numbers(), "central_meridian", "latitude_of_origin", "scale_factor")

    def _inverse(self, u, v, kind):
        pi = kind(math.pi)
        phi, lam = (kind(a) * pi / kind(180) for a in (self.latitude_of_origin, self.central_meridian))
        rho = np.sqrt(u * u + v * v) if kind is np.float32 else np.hypot(u, v)
        c = kind(2) * np.arctan2(rho, kind(2) * kind(self.earth.radius_m) * kind(self.scale_factor))
        sine = np.cos(c) * np.sin(phi) + v * np.sin(c) * np.cos(phi) / rho
        lat = np.arcsin(np.clip(sine, kind(-1), kind(1))) * kind(180) / pi
        lon = (lam + np.arctan2(u * np.sin(c), rho * np.cos(phi) * np.cos(c) - v * np.sin(phi) * np.sin(c))) * kind(180) / pi
        return np.where(rho == 0, kind(self.latitude_of_origin), lat), np.where(rho == 0, kind(self.central_meridian), lon)

    def _columns(self, u, v):
        phi, lam = math.radians(self.latitude_of_origin), math.radians(self.central_meridian)
        rho = F.hypot(u, v)
        some = F.when(rho == 0, F.lit(1.0)).otherwise(rho)
        c = F.lit(2.0) * F.atan2(rho, F.lit(2.0 * self.earth.radius_m * self.scale_factor))
        lat = F.degrees(F.asin(_clamp(F.cos(c) * math.sin(phi) + v * F.sin(c) * math.cos(phi) / some)))
        lon = F.degrees(F.lit(lam) + F.atan2(u * F.sin(c), rho * math.cos(phi) * F.cos(c) - v * math.sin(phi) * F.sin(c)))
        return F.when(rho == 0, F.lit(self.latitude_of_origin)).otherwise(lat), F.when(rho == 0, F.lit(self.central_meridian)).otherwise(lon)


@dataclass(frozen=True)
class GaussianRow:
    latitude: float
    point_count: int
    longitude_origin: float
    longitude_step: float


@dataclass(frozen=True)
class Segment:
    """A stretch of a parent row that a subset holds."""

    parent_row: int
    parent_begin: int
    count: int


@dataclass(frozen=True)
class GaussianGrid(Grid):
    """Rows of falling latitude, each with its own number of points; a subset lists segments of rows in local order."""

    n: int = 0
    latitude_rule: str = "explicit_v1"
    rows: tuple[GaussianRow, ...] = ()
    segments: tuple[Segment, ...] = ()

    kind = "reduced_gaussian"

    def __post_init__(self) -> None:
        extent(self.n, "n")
        if self.latitude_rule not in LATITUDE_RULES:
            raise bad("latitude_rule is not known")
        if self.policy not in (FLOAT64, FLOAT32):
            raise bad(f"numeric_policy must be {FLOAT64} or {FLOAT32}")
        if len(self.rows) != 2 * self.n:
            raise bad("a Gaussian grid has exactly 2n rows")
        for row in self.rows:
            extent(row.point_count, "point_count")
            if abs(finite(row.latitude, "latitude")) > 90 or finite(row.longitude_step, "longitude_step") == 0:
                raise bad("a Gaussian row is out of range")
            finite(row.longitude_origin + (row.point_count - 1) * row.longitude_step, "a row's longitudes")
        if any(a.latitude <= b.latitude for a, b in zip(self.rows, self.rows[1:], strict=False)):
            raise bad("latitudes of Gaussian rows must fall strictly")
        taken: dict[int, list[tuple[int, int]]] = {}
        for s in self.segments:
            if not 0 <= s.parent_row < len(self.rows) or s.count <= 0 or s.parent_begin < 0 or s.parent_begin + s.count > self.rows[s.parent_row].point_count:
                raise bad("a subset segment is outside its row")
            taken.setdefault(s.parent_row, []).append((s.parent_begin, s.parent_begin + s.count))
        for spans in taken.values():
            spans.sort()
            if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
                raise bad("subset segments overlap")

    @cached_property
    def _tables(self) -> dict[str, np.ndarray]:
        begins = np.concatenate([[0], np.cumsum([r.point_count for r in self.rows])])
        parts = self.segments or tuple(Segment(i, 0, r.point_count) for i, r in enumerate(self.rows))
        return {
            "begins": begins,
            "starts": np.concatenate([[0], np.cumsum([s.count for s in parts])]),
            "row": np.array([s.parent_row for s in parts]),
            "first": np.array([s.parent_begin for s in parts]),
            "lat": np.array([r.latitude for r in self.rows]),
            "origin": np.array([r.longitude_origin for r in self.rows]),
            "step": np.array([r.longitude_step for r in self.rows]),
        }

    @property
    def points(self) -> int:
        return int(self._tables["starts"][-1])

    def xy_of(self, point):
        return point, np.zeros_like(point)

    def parent_of(self, point: np.ndarray) -> np.ndarray:
        """The point's index in the whole grid."""
        t = self._tables
        part = np.searchsorted(t["starts"], point, side="right") - 1
        return t["begins"][t["row"][part]] + t["first"][part] + point - t["starts"][part]

    def parent(self, point: Column) -> Column:
        if not self.segments:
            return point
        grid = self

        @F.pandas_udf("long")
        def of(p: pd.Series) -> pd.Series:
            return pd.Series(grid.parent_of(p.to_numpy()))

        return of(point)

    def xy(self, point: Column):
        return point, F.lit(0).cast("long")

    def coordinates_of(self, x, y):
        """x is the local point; there is one long row."""
        t, point = self._tables, np.asarray(x)
        part = np.searchsorted(t["starts"], point, side="right") - 1
        row, at = t["row"][part], t["first"][part] + point - t["starts"][part]
        kind = np.float32 if self.policy == FLOAT32 else np.float64
        lon = t["origin"][row].astype(kind) + at.astype(kind) * t["step"][row].astype(kind)
        return t["lat"][row].astype(kind), normalized(lon)

    def definition(self) -> dict:
        out = {"type": self.kind, "n": self.n, "latitude_rule": self.latitude_rule, "rows": [[r.latitude, r.point_count, r.longitude_origin, r.longitude_step] for r in self.rows]}
        return out | ({"subset_segments": [[s.parent_row, s.parent_begin, s.count] for s in self.segments]} if self.segments else {})


def octahedral_rows(n: int) -> tuple[GaussianRow, ...]:
    """Rows of the octahedral reduced grid: 20 points next to the poles, four more each row; approximate latitudes."""
    return approximate_rows([20 + 4 * min(y, 2 * n - y - 1) for y in range(2 * n)])


def approximate_rows(counts: list[int]) -> tuple[GaussianRow, ...]:
    """Rows of these point counts at evenly spaced single-precision latitudes."""
    f, n = np.float32, len(counts) // 2
    dy = f(180.0 / float(f(2.0 * n + 0.5)))
    lats = [float(f(n - y - 1) * dy + dy / f(2)) for y in range(2 * n)]
    return tuple(GaussianRow(lat, c, 0.0, float(f(360.0 / c))) for lat, c in zip(lats, counts, strict=True))


# ---- declarations --------------------------------------------------------------------------------------------------


def _exact(value: object, name: str, fields: tuple[str, ...], nullable: tuple[str, ...] = ()) -> dict:
    if not isinstance(value, dict):
        raise bad(f"{name} must be a struct")
    if set(value) != set(fields):
        raise bad(f"{name} must have exactly the fields {', '.join(fields)}")
    for k, v in value.items():
        if v is None and k not in nullable:
            raise bad(f"{name}.{k} must not be null")
    return value


PROJECTIONS = {c.kind: c for c in (RotatedGrid, LambertGrid, StereographicGrid)}
PARAMETERS = {
    "rotated_latlon": ("x0", "y0", "dx", "dy", "north_pole_latitude", "north_pole_longitude", "rotation"),
    "lambert_conformal_conic": ("x0", "y0", "dx", "dy", "central_meridian", "latitude_of_origin", "standard_parallel_1", "standard_parallel_2"),
    "stereographic": ("x0", "y0", "dx", "dy", "central_meridian", "latitude_of_origin", "scale_factor"),
}


def parse_grid(spec: dict | Grid) -> Grid:
    """A grid from its declaration: seven fields for a regular grid, or the version 1 form for all others."""
    if isinstance(spec, Grid):
        return spec
    if not isinstance(spec, dict):
        raise bad("grid must be a struct")
    if "version" not in spec:
        s = _exact(spec, "grid", ("nx", "ny", "lat0", "lon0", "dlat", "dlon", "order"))
        if s["order"] not in LEGACY_ORDERS:
            raise bad("order must be separate, lon_fastest or lat_fastest")
        numbers = {n: finite(s[n], n) for n in ("lat0", "lon0", "dlat", "dlon")}
        return RegularGrid(extent(s["nx"], "nx"), extent(s["ny"], "ny"), LEGACY_ORDERS[s["order"]], **numbers)
    s = _exact(spec, "grid", ("version", "type", "numeric_policy", "earth", "layout", "parameters"))
    if s["version"] != 1:
        raise bad("version must be 1")
    if s["numeric_policy"] not in (FLOAT64, FLOAT32):
        raise bad(f"numeric_policy must be {FLOAT64} or {FLOAT32}")
    model = s["earth"].get("model") if isinstance(s["earth"], dict) else None
    e = _exact(s["earth"], "earth", ("model", "radius_m") if model != "wgs84" else ("model", "semi_major_m", "inverse_flattening"))
    earth = Earth(**({"model": model} | {k: finite(v, f"earth.{k}") for k, v in e.items() if k != "model"}))
    if s["type"] in PROJECTIONS:
        at = _exact(s["layout"], "layout", ("nx", "ny", "order"))
        own = _exact(s["parameters"], "parameters", PARAMETERS[s["type"]])
        numbers = {k: finite(v, f"parameters.{k}") for k, v in own.items()}
        return PROJECTIONS[s["type"]](extent(at["nx"], "layout.nx"), extent(at["ny"], "layout.ny"), at["order"], s["numeric_policy"], earth, **numbers)
    if s["type"] == GaussianGrid.kind:
        if _exact(s["layout"], "layout", ("order",))["order"] != ROW_MAJOR:
            raise bad("layout.order of a Gaussian grid must be row_major")
        p = _exact(s["parameters"], "parameters", ("n", "latitude_rule", "rows", "subset_segments"), ("subset_segments",))
        if not isinstance(p["rows"], list) or not p["rows"] or p["subset_segments"] == []:
            raise bad("parameters.rows must be a list, and subset_segments null or a list that is not empty")
        rows = tuple(GaussianRow(**_exact(r, "a row", ("latitude", "point_count", "longitude_origin", "longitude_step"))) for r in p["rows"])
        parts = tuple(Segment(**_exact(r, "a segment", ("parent_row", "parent_begin", "count"))) for r in p["subset_segments"] or ())
        return gaussian(extent(p["n"], "n"), p["latitude_rule"], rows, parts, s["numeric_policy"], earth)
    raise bad(f"grid type {s['type']!r} is unknown")


def gaussian(n: int, rule: str, rows: tuple[GaussianRow, ...], segments: tuple[Segment, ...] = (), policy: str = FLOAT64, earth: Earth | None = None) -> GaussianGrid:
    """A Gaussian grid; its points lie in one flattened row."""
    points = sum(s.count for s in segments) or sum(r.point_count for r in rows)
    return GaussianGrid(max(1, points), 1, X_FASTEST, policy, earth or Earth(), n, rule, rows, segments)
