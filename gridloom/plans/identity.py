"""Stable identifiers of grids, layouts and objects: SHA-256 over a length-prefixed encoding of their definition."""

from __future__ import annotations

import hashlib
import struct

from gridloom.functions.grids import GaussianGrid, Grid


def encode(value: object) -> bytes:
    """Each value has a kind, its length and its bytes; fields go in the order of their names."""
    if isinstance(value, bool):
        kind, body = b"b", bytes([value])
    elif isinstance(value, int):
        kind, body = b"i", value.to_bytes(16, "big", signed=True)
    elif isinstance(value, float):
        kind, body = b"d", struct.pack(">d", value + 0.0)  # -0.0 and 0.0 are one
    elif isinstance(value, str):
        kind, body = b"s", value.encode()
    elif value is None:
        kind, body = b"n", b""
    elif isinstance(value, dict):
        kind, body = b"m", b"".join(encode(k) + encode(v) for k, v in sorted(value.items()))
    else:
        kind, body = b"l", b"".join(map(encode, value))
    return kind + len(body).to_bytes(8, "big") + body


def _sha(prefix: str, value: object) -> str:
    return "sha256:" + hashlib.sha256(encode([prefix, value])).hexdigest()


def earth(grid: Grid) -> dict:
    e = grid.earth
    return {"model": "sphere", "radius_m": e.radius_m} if e.model == "sphere" else {"model": e.model, "semi_major_m": e.semi_major_m, "inverse_flattening": e.inverse_flattening}


def grid_id(grid: Grid) -> str:
    """Equal for grids whose points have equal coordinates by equal rules; the storage order does not matter."""
    return _sha("grid-v1", {"definition": grid.definition(), "earth": earth(grid), "policy": grid.policy})


def parent_grid_id(grid: Grid) -> str | None:
    """The whole grid of a subset."""
    if isinstance(grid, GaussianGrid) and grid.segments:
        whole = {k: v for k, v in grid.definition().items() if k != "subset_segments"}
        return _sha("grid-v1", {"definition": whole, "earth": earth(grid), "policy": grid.policy})
    return None


def layout_id(grid: Grid, spatial: tuple[int, ...], shape: tuple[int, ...]) -> str:
    """How the grid's points lie in the array."""
    order = "row_major" if isinstance(grid, GaussianGrid) else grid.order
    return _sha("layout-v1", {"order": order, "axes": list(spatial), "rank": len(shape), "extent": [shape[i] for i in spatial]})


def object_id(identity: str) -> str:
    return _sha("object-v1", identity)
