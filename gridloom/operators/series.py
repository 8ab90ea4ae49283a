"""Scans over a chunked time series."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import SourceError
from gridloom.functions.grids import parse_grid
from gridloom.operators import scan
from gridloom.plans import domains, identity
from gridloom.plans import series as plans
from gridloom.plans.meta import check_names
from gridloom.sources.paths import exists, redacted


def _signature(b: scan.Bound) -> tuple:
    """What all objects of a series must share."""
    ids = (identity.grid_id(b.grid), identity.layout_id(b.grid, b.spatial, b.meta.shape)) if b.grid else ()
    return b.meta.names, b.names, b.meta.shape, ids


def read_series(spark: SparkSession, path: str, *, model: str | None = None, chunk_time_length: int | None = None, time_step: dt.timedelta | None = None, valid_times: list | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, dimensions: list[str] | None = None, strict: bool = False, where: str | None = None, **options) -> DataFrame:
    """Rows of a closed time window from the objects of a variable's directory. Objects that are absent when the
    DataFrame is built are skipped, or raise with ``strict``; one that goes missing later fails the query."""
    w = plans.window(valid_times, start, end)
    lay = plans.layout(model, chunk_time_length, time_step)
    if options.pop("axes", None) is not None:
        raise plans.bad("a series makes its own axes")
    path = plans.prefix(path)
    if dimensions is None or list(dimensions).count("time") != 1:
        raise plans.bad("dimensions must name exactly one axis time")
    children, signature = [], None
    for c in plans.candidates(w, lay):
        at = f"{path}/{c.key}"
        if not exists(spark, f"{at}/meta"):
            if strict:
                raise SourceError("object_not_found", f"{redacted(at)} is absent")
            continue
        begin = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=c.start)
        axes = {"time": {"axis": "time", "start": begin, "step": dt.timedelta(microseconds=lay.step)}}
        b = scan.bind(spark, at, dimensions=dimensions, axes=axes, **options)
        if b.meta.shape[b.names.index("time")] != lay.slots:
            raise plans.bad(f"{redacted(at)} does not have {lay.slots} slots")
        signature = signature or _signature(b)
        if _signature(b) != signature:
            raise plans.bad(f"{redacted(at)} differs from the other objects")
        if not c.empty:
            selection = scan.chosen(b, where)
            axis = b.names.index("time")
            inside = [(max(a, c.first), min(z, c.last)) for a, z in selection.ranges.get(axis, [(0, lay.slots - 1)])]
            selection.ranges[axis] = [r for r in inside if r[0] <= r[1]]
            scan.note(b, "series", selection, f"series:{path}")
            children.append(scan.project(b, b.source.cells(b.meta, selection.ranges)))
    if not children:
        return _declared(spark, dimensions, options)
    low, high = (F.lit((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)).isoformat(sep=" ")).cast("timestamp_ntz") for t in w)
    out = reduce(DataFrame.unionAll, children).where(F.col("valid_time").between(low, high))
    return out.where(where) if where else out


def lattice(df: DataFrame, ts: str, lay: plans.Layout, w: tuple[int, int]) -> DataFrame:
    """A table's rows in the closed window, with the number of the object and the slot that each would lie in."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    number = F.floor(at / F.lit(lay.span)).cast("long")
    slot = F.call_function("div", at - number * F.lit(lay.span), F.lit(lay.step))
    return df.where(at.between(*w)).withColumns({"chunk": number, "slot": slot})


def _declared(spark: SparkSession, dimensions: list[str], options: dict) -> DataFrame:
    """No rows, with the schema that the declarations alone give."""
    variable = options.get("variable")
    names = [variable.removeprefix("/") if variable else "value"]
    fields = [f"`{names[0]}` float"]
    more = []
    if options.get("grid") is not None or options.get("domain") is not None:
        grid = parse_grid(options["grid"]) if options.get("grid") is not None else domains.domain(options["domain"])
        del grid
        more += ["lat double", "lon double"]
    more.append("valid_time timestamp_ntz")
    if options.get("include_source"):
        more.append("om_source struct<object_id:string,object_version:string,version_strength:string,content_verified:boolean,grid_id:string,layout_id:string,logical_index:bigint,point_index:bigint,parent_point_index:bigint,axis_indices:array<bigint>>")
    check_names(names, [f.split()[0] for f in more])
    return spark.createDataFrame([], ", ".join(fields + more))
