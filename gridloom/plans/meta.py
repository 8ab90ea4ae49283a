"""What is known about a cube before any cell is read: variables, shape, axis names, time, reference system."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from gridloom.errors import BindError


def bad(message: str) -> BindError:
    return BindError("schema", message)


def column_name(path: str) -> str:
    """The column of a variable: ``value`` for the root array, else the path without its first slash. Slashes and
    percent signs inside a segment are given as %2F and %25 in the path."""
    return path.lstrip("/") or "value"


def encode_segment(name: str) -> str:
    return name.replace("%", "%25").replace("/", "%2F")


@dataclass(frozen=True)
class Variable:
    """A value array. ``axes`` are the names its metadata declare, if any."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    axes: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.shape) <= 8 or len(self.chunks) != len(self.shape):
            raise bad(f"{column_name(self.path)} must have 1 to 8 axes")
        if any(n <= 0 for n in self.shape) or any(not 0 < c <= n for c, n in zip(self.chunks, self.shape, strict=True)):
            raise bad(f"{column_name(self.path)} has an empty axis or a chunk beyond it")
        if self.axes is not None and (len(self.axes) != len(self.shape) or len(set(self.axes)) != len(self.axes) or not all(self.axes)):
            raise bad(f"{column_name(self.path)} must name each of its axes once")


@dataclass(frozen=True)
class CubeMeta:
    """Aligned variables, in the byte order of their paths."""

    variables: tuple[Variable, ...]
    crs_wkt: str | None = None
    #: Embedded times in Unix seconds: one for each position of a time axis, or one for the whole cube.
    times: tuple[int, ...] | None = None
    identity: str = ""
    attributes: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if not self.variables:
            raise bad("the cube has no value array")
        ordered = tuple(sorted(self.variables, key=lambda v: v.path.encode()))
        object.__setattr__(self, "variables", ordered)
        check_names([column_name(v.path) for v in ordered], [])
        first = ordered[0]
        for v in ordered[1:]:
            if v.shape != first.shape or v.axes != first.axes:
                raise bad(f"{column_name(v.path)} and {column_name(first.path)} differ in shape or axes")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.variables[0].shape

    @property
    def axes(self) -> tuple[str, ...] | None:
        return self.variables[0].axes

    @property
    def rows(self) -> int:
        return prod(self.shape)

    @property
    def names(self) -> list[str]:
        return [column_name(v.path) for v in self.variables]

    def select(self, variable: str | None) -> CubeMeta:
        """The cube with one variable, by its column name with or without a leading slash."""
        if variable is None:
            return self
        if not isinstance(variable, str) or not variable.strip("/"):
            raise bad("variable must name a value array")
        found = [v for v in self.variables if column_name(v.path) == variable.removeprefix("/")]
        if not found:
            raise bad(f"there is no value array {variable!r}")
        return CubeMeta(tuple(found), self.crs_wkt, self.times, self.identity, self.attributes)

    def declared(self, dimensions: list[str] | dict[str, list[str]] | None) -> tuple[str, ...] | None:
        """Axis names: those given, checked against the metadata, or those of the metadata."""
        if dimensions is None:
            return self.axes
        lists = {n: dimensions for n in self.names} if isinstance(dimensions, (list, tuple)) else dimensions
        if not isinstance(lists, dict) or {k.removeprefix("/") for k in lists} != set(self.names):
            raise bad("dimensions must cover exactly the selected variables")
        named = {tuple(v) for v in lists.values()}
        if len(named) != 1:
            raise bad("variables must share the same ordered axes")
        (names,) = named
        if len(names) != len(self.shape) or len(set(names)) != len(names) or not all(isinstance(n, str) and n for n in names):
            raise bad(f"dimensions must name each of {len(self.shape)} axes once")
        if self.axes is not None and self.axes != names:
            raise bad(f"dimensions {list(names)} differ from the declared {list(self.axes)}")
        return names

    def strides(self) -> list[int]:
        return [prod(self.shape[i + 1 :]) for i in range(len(self.shape))]


def check_names(names: list[str], more: list[str]) -> None:
    """Column names must differ, whatever their case."""
    seen: set[str] = set()
    for n in [*names, *more]:
        if n.lower() in seen:
            raise bad(f"column {n!r} occurs twice")
        seen.add(n.lower())
