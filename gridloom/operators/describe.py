"""One row about a cube's grid, from metadata alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from gridloom.errors import BindError
from gridloom.functions.grids import GaussianGrid
from gridloom.operators import scan
from gridloom.plans import identity

SCHEMA = (
    "descriptor_version int, grid_id string, parent_grid_id string, grid_type string, definition string, layout string, crs string, "
    "capabilities string, provenance string, object_id string, object_version string, version_strength string, content_verified boolean"
)


def grid_info(spark: SparkSession, source, **options) -> DataFrame:
    """The descriptor; definition, layout, crs, capabilities and provenance are JSON."""
    b = scan.bind(spark, source, **options)
    if b.grid is None:
        raise BindError("grid_info", "a grid or a domain is needed")
    text = lambda x: json.dumps(x, sort_keys=True)
    order = "row_major" if isinstance(b.grid, GaussianGrid) else b.grid.order
    layout = {"layout_id": identity.layout_id(b.grid, b.spatial, b.meta.shape), "order": order, "spatial_axes": [b.names[i] for i in b.spatial], "shape": list(b.meta.shape)}
    unsupported = dict.fromkeys(("area_weights", "bounds", "interpolation", "neighbours", "reprojection"), "unsupported")
    row = (
        1,
        identity.grid_id(b.grid),
        identity.parent_grid_id(b.grid),
        b.grid.kind,
        text(b.grid.definition() | {"earth": identity.earth(b.grid), "numeric_policy": b.grid.policy}),
        text(layout),
        text({"wkt": b.meta.crs_wkt, "status": b.crs_status}),
        text({"point_semantics": "supported"} | unsupported),
        text({"origin": "domain" if options.get("domain") else "declared", "domain": options.get("domain")}),
        identity.object_id(b.meta.identity),
        None,
        "unverifiable",
        False,
    )
    return spark.createDataFrame([row], SCHEMA)
