"""Chunked time series: which objects of a variable's directory a closed time window needs."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from gridloom.errors import BindError
from gridloom.functions.axes import micros, utc
from gridloom.sources.paths import check_object

# Slots in an object and seconds between slots.
MODELS = {
    "ecmwf_ifs": (504, 3600),
    "ecmwf_ifs025": (104, 10800),
    "ncep_gfs013": (481, 3600),
    "ncep_gfs025": (481, 3600),
    "dwd_icon": (253, 3600),
    "dwd_icon_eu": (193, 3600),
    "dwd_icon_d2": (121, 3600),
    "jma_gsm": (110, 21600),
    "cmc_gem_gdps": (110, 10800),
    "meteofrance_arpege_world025": (210, 3600),
    "ukmo_global_deterministic_10km": (193, 3600),
}
MAX_CANDIDATES = 4096


def bad(message: str) -> BindError:
    return BindError("series", message)


@dataclass(frozen=True)
class Layout:
    """Slots in an object, and microseconds between them."""

    slots: int
    step: int

    @property
    def span(self) -> int:
        return self.slots * self.step


@dataclass(frozen=True)
class Candidate:
    """An object by number: when it begins and which of its slots lie in the window (none if first > last)."""

    number: int
    start: int
    first: int
    last: int
    key: str

    @property
    def empty(self) -> bool:
        return self.first > self.last


def layout(model: str | None, chunk_time_length: int | None, time_step: dt.timedelta | None) -> Layout:
    """Each of the two from the override or else the model."""
    if model is not None and (not isinstance(model, str) or not model):
        raise bad("model must be a name")
    known = MODELS.get(model)
    if known is None and (chunk_time_length is None or time_step is None):
        raise bad("chunk_time_length and time_step are both needed for an unknown model")
    slots = known[0] if chunk_time_length is None else chunk_time_length
    if isinstance(slots, bool) or not isinstance(slots, int) or slots <= 0:
        raise bad("chunk_time_length must be a positive integer")
    step = dt.timedelta(seconds=known[1]) if time_step is None else time_step
    if not isinstance(step, dt.timedelta) or step <= dt.timedelta(0) or step % dt.timedelta(seconds=1):
        raise bad("time_step must be a positive number of whole seconds")
    out = Layout(slots, step // dt.timedelta(microseconds=1))
    if out.span >= 1 << 63:
        raise bad("the span of an object overflows")
    return out


def window(valid_times: list | None, start: dt.datetime | None, end: dt.datetime | None) -> tuple[int, int]:
    """The closed window in microseconds, from two endpoints given one way or the other."""
    if valid_times is not None and (start is not None or end is not None):
        raise bad("valid_times excludes start and end")
    if valid_times is not None:
        if not isinstance(valid_times, (list, tuple)) or len(valid_times) != 2:
            raise bad("valid_times must hold two endpoints")
        start, end = valid_times
    if start is None or end is None:
        raise bad("a window needs both endpoints")
    a, b = micros(utc(start, "start")), micros(utc(end, "end"))
    if a > b:
        raise bad("the window ends before it starts")
    return a, b


def key(number: int) -> str:
    """Four places, the sign counted."""
    return f"chunk_{number:04d}.om"


def candidates(w: tuple[int, int], lay: Layout) -> list[Candidate]:
    """Objects that the window touches. Division rounds down, also before 1970."""
    first, last = w[0] // lay.span, w[1] // lay.span
    if last - first + 1 > MAX_CANDIDATES:
        raise bad(f"the window needs more than {MAX_CANDIDATES} objects")
    out = []
    for n in range(first, last + 1):
        begin = n * lay.span
        out.append(Candidate(n, begin, max(0, -(-(w[0] - begin) // lay.step)), min(lay.slots - 1, (w[1] - begin) // lay.step), key(n)))
    return out


def prefix(path: str) -> str:
    """A directory of one variable."""
    if not isinstance(path, str) or not path or re.search(r"[*?\[\]{}#]", path):
        raise bad("the prefix must be a directory without glob, query or fragment")
    if path.endswith("//"):
        raise bad("the prefix may have one slash at its end")
    path = check_object(path)
    parts = re.sub(r"^[a-z0-9+]+://", "", path).split("/")
    if parts[-1].endswith(".om"):
        raise bad("the prefix must not name an object")
    if {"data_run", "data_spatial"} & set(parts):
        raise bad("data_run and data_spatial have another layout")
    return path
