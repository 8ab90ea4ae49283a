"""Polygons: parsing, validity, coverage of points, representative points, distances on the sphere."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import BindError

# Limits of a region collection.
MAX_REGIONS = 4096
MAX_WKB, MAX_WKB_TOTAL = 1 << 20, 16 << 20
MAX_VERTICES, MAX_VERTICES_TOTAL = 1 << 16, 1 << 20

Ring = list[tuple[float, float]]
Polygon = list[Ring]


def bad(message: str) -> BindError:
    return BindError("region_input", message)


@dataclass(frozen=True)
class Region:
    """An id and its polygons; none for an empty geometry."""

    id: str
    polygons: tuple[Polygon, ...]

    @property
    def envelope(self) -> tuple[float, float, float, float] | None:
        points = [p for polygon in self.polygons for p in polygon[0]]
        return (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else None


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise bad("the WKB ends early")
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return value


def _polygon(r: _Bytes, end: str) -> Polygon:
    rings = []
    for _ in range(r.take(end + "I")):
        count = r.take(end + "I")
        if count > MAX_VERTICES:
            raise BindError("region_input_limit", "a region has too many vertices")
        ring = [(r.take(end + "d"), r.take(end + "d")) for _ in range(count)]
        if count < 4 or ring[0] != ring[-1]:
            raise bad("a ring needs four points and must be closed")
        for x, y in ring:
            if not (math.isfinite(x) and math.isfinite(y)) or not -180 <= x <= 180 or not -90 < y < 90:
                raise bad("coordinates must lie in [-180, 180] and (-90, 90)")
        if any(abs(b[0] - a[0]) >= 180 for a, b in zip(ring, ring[1:], strict=False)):
            raise bad("an edge spans 180 degrees or more")
        rings.append(ring)
    return rings


def _header(r: _Bytes) -> tuple[str, int]:
    order = r.take("B")
    if order not in (0, 1):
        raise bad("the byte order is unknown")
    end = "<" if order else ">"
    return end, r.take(end + "I")


def parse_wkb(data: bytes) -> tuple[Polygon, ...]:
    """Polygons of a 2-D Polygon or MultiPolygon in either byte order."""
    r = _Bytes(bytes(data))
    end, kind = _header(r)
    if kind == 3:
        out = [_polygon(r, end)]
    elif kind == 6:
        out = []
        for _ in range(r.take(end + "I")):
            own, part = _header(r)
            if part != 3:
                raise bad("a MultiPolygon holds polygons only")
            out.append(_polygon(r, own))
    else:
        raise bad("only 2-D Polygon and MultiPolygon are supported")
    if r.at != len(r.data):
        raise bad("bytes follow the geometry")
    out = [p for p in out if p]
    xs = [x for p in out for x, _ in p[0]]
    if xs and max(xs) - min(xs) >= 180:
        raise bad("a region spans 180 degrees or more")
    return tuple(out)


def polygon_wkb(*polygons: Polygon, multi: bool = False, big: bool = False) -> bytes:
    """WKB of polygons, for tests and callers without a geometry library."""
    end, mark = (">", b"\0") if big else ("<", b"\1")

    def one(p: Polygon) -> bytes:
        rings = b"".join(struct.pack(end + "I", len(ring)) + b"".join(struct.pack(end + "dd", *xy) for xy in ring) for ring in p)
        return mark + struct.pack(end + "II", 3, len(p)) + rings

    if multi or len(polygons) > 1:
        return mark + struct.pack(end + "II", 6, len(polygons)) + b"".join(map(one, polygons))
    return one(polygons[0] if polygons else [])


def ring_relation(ring: Ring, x: float, y: float) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return 1 if inside else -1


def covers(polygons: tuple[Polygon, ...], x: float, y: float) -> bool:
    """Whether a polygon covers the point: boundaries of shell and holes do, the inside of holes does not."""
    return any(p and ring_relation(p[0], x, y) >= 0 and not any(ring_relation(hole, x, y) > 0 for hole in p[1:]) for p in polygons)


def _crossing(a, b, c, d) -> bool:
    """Whether two segments cross in an inner point of both or overlap in more than a point."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    t = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if all(t) and (t[0] > 0) != (t[1] > 0) and (t[2] > 0) != (t[3] > 0):
        return True
    if t[0] == t[1] == 0:
        k = 0 if a[0] != b[0] else 1
        return max(min(a[k], b[k]), min(c[k], d[k])) < min(max(a[k], b[k]), max(c[k], d[k]))
    return False


def check_valid(polygons: tuple[Polygon, ...], ordinal: int) -> None:
    """Rings must not cross themselves or each other; holes lie in their shell, parts of a MultiPolygon apart."""
    wrong = BindError("region_input", f"region {ordinal} is not a valid geometry")
    for p in polygons:
        edges = [(i, a, b) for i, ring in enumerate(p) for a, b in zip(ring, ring[1:], strict=False) if a != b]
        edges.sort(key=lambda e: min(e[1][0], e[2][0]))
        live: list = []
        for e in edges:  # a sweep over x: only edges whose spans meet are compared
            left = min(e[1][0], e[2][0])
            live = [o for o in live if max(o[1][0], o[2][0]) >= left]
            if any(_crossing(e[1], e[2], o[1], o[2]) for o in live):
                raise wrong
            live.append(e)
        for ring in p:
            if len(set(ring)) < 3 or sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) == 0 or len(set(ring)) != len(ring) - 1:
                raise wrong
        if any(ring_relation(p[0], x, y) < 0 for hole in p[1:] for x, y in hole):
            raise wrong
    for i, p in enumerate(polygons):
        for q in polygons[i + 1 :]:
            if any(_crossing(a, b, c, d) for a, b in zip(p[0], p[0][1:], strict=False) for c, d in zip(q[0], q[0][1:], strict=False)):
                raise wrong
            if covers_inside(p, interior_point((q,))) or covers_inside(q, interior_point((p,))):
                raise wrong


def covers_inside(polygon: Polygon, point: tuple[float, float]) -> bool:
    return ring_relation(polygon[0], *point) > 0 and not any(ring_relation(h, *point) >= 0 for h in polygon[1:])


def interior_point(polygons: tuple[Polygon, ...]) -> tuple[float, float]:
    """A point that the polygons cover: on the level half way between the vertex levels around the middle of the
    largest part's height, the middle of the widest stretch inside."""
    p = max(polygons, key=lambda q: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q[0], q[0][1:], strict=False))))
    levels = sorted({y for ring in p for _, y in ring})
    middle = (levels[0] + levels[-1]) / 2
    low, high = max((v for v in levels if v <= middle), default=levels[0]), min((v for v in levels if v > middle), default=levels[-1])
    y = (low + high) / 2
    cuts = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for ring in p for a, b in zip(ring, ring[1:], strict=False) if (a[1] > y) != (b[1] > y))
    width, x = max((b - a, -(a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    if not covers((p,), -x, y):
        raise bad("no representative point found")
    return -x, y


def parse_regions(regions: list[dict], region_crs: str = "grid_lonlat") -> list[Region]:
    """Checked regions from (id, wkb) pairs."""
    if region_crs != "grid_lonlat":
        raise BindError("region_reference", "region_crs must be grid_lonlat")
    if regions is None or not isinstance(regions, (list, tuple)):
        raise bad("regions must be a list")
    if len(regions) > MAX_REGIONS:
        raise BindError("region_input_limit", f"more than {MAX_REGIONS} regions")
    out, seen, size, vertices = [], set(), 0, 0
    for i, r in enumerate(regions, 1):
        if not isinstance(r, dict) or set(r) != {"id", "wkb"} or r["id"] is None or r["wkb"] is None:
            raise bad(f"region {i} must have exactly id and wkb")
        key = r["id"].encode()
        if not 1 <= len(key) <= 256 or key in seen:
            raise bad(f"the id of region {i} must be unique and of 1 to 256 bytes")
        seen.add(key)
        size += len(r["wkb"])
        if len(r["wkb"]) > MAX_WKB or size > MAX_WKB_TOTAL:
            raise BindError("region_input_limit", "the WKB is too large")
        polygons = parse_wkb(r["wkb"])
        own = sum(len(ring) for p in polygons for ring in p)
        vertices += own
        if own > MAX_VERTICES or vertices > MAX_VERTICES_TOTAL:
            raise BindError("region_input_limit", "too many vertices")
        check_valid(polygons, i)
        out.append(Region(r["id"], polygons))
    return out


# ---- expressions ---------------------------------------------------------------------------------------------------

#: Polygons as arrays of rings as arrays of edges.
EDGES = "array<array<array<struct<x1:double,y1:double,x2:double,y2:double>>>>"


def edges(polygons: tuple[Polygon, ...]) -> list:
    return [[[(*a, *b) for a, b in zip(ring, ring[1:], strict=False)] for ring in p] for p in polygons]


def _on(ring: Column, x: Column, y: Column) -> Column:
    def touches(e: Column) -> Column:
        level = (x - e.x1) * (e.y2 - e.y1) == (y - e.y1) * (e.x2 - e.x1)
        return level & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    return F.exists(ring, touches)


def _inside(ring: Column, x: Column, y: Column) -> Column:
    def crosses(e: Column) -> Column:
        # the branch keeps level edges from dividing by zero
        return F.when((e.y1 > y) != (e.y2 > y), x < e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)).otherwise(False)

    return F.size(F.filter(ring, crosses)) % 2 == 1


def covers_column(polygons: Column, x: Column, y: Column) -> Column:
    """covers() as an expression over a column of EDGES."""

    def polygon(p: Column) -> Column:
        shell = F.element_at(p, 1)
        holes = F.slice(p, F.lit(2), F.size(p))
        return (_on(shell, x, y) | _inside(shell, x, y)) & ~F.exists(holes, lambda h: ~_on(h, x, y) & _inside(h, x, y))

    return F.exists(polygons, polygon)


def haversine(lon1, lat1, lon2, lat2, radius: float) -> np.ndarray:
    """Distance from (lon1, lat1) to points (lon2, lat2) on the sphere; exactly 0 for the same point."""
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon1, lat1, lon2, lat2)))
    rad = math.pi / 180
    turn = lon2 - lon1
    turn = turn - 360.0 * np.rint(turn / 360.0)
    s1, s2 = np.sin((lat2 * rad - lat1 * rad) / 2), np.sin(turn * rad / 2)
    a = np.clip(s1 * s1 + np.cos(lat1 * rad) * np.cos(lat2 * rad) * (s2 * s2), 0.0, 1.0)
    angle = 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
    angle = np.where(lat2 == 90.0, (90.0 - lat1) * rad, np.where(lat2 == -90.0, (90.0 + lat1) * rad, angle))
    return np.where((lat1 == lat2) & (turn == 0), 0.0, radius * angle)


def haversine_column(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    """haversine() as an expression."""
    rad = F.lit(math.pi / 180)
    turn = lon2 - lon1
    turn = turn - F.lit(360.0) * F.rint(turn / 360.0)
    s1, s2 = F.sin((lat2 * rad - lat1 * rad) / 2.0), F.sin(turn * rad / 2.0)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s1 * s1 + F.cos(lat1 * rad) * F.cos(lat2 * rad) * (s2 * s2)))
    angle = F.when(lat2 == 90.0, (F.lit(90.0) - lat1) * rad).when(lat2 == -90.0, (F.lit(90.0) + lat1) * rad)
    angle = angle.otherwise(F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))
    return F.when((lat1 == lat2) & (turn == 0.0), F.lit(0.0)).otherwise(F.lit(radius) * angle)
