"""Rows that arrive while a query runs, laid out on the same lattice of objects and slots as stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.series import Layout


def arriving(df: DataFrame, ts: str, lay: Layout, late: str = "1 hour") -> DataFrame:
    """Statistics of each object's slots, emitted once no row for them can come any more: (chunk_start, slot_start,
    slot, n). ``df`` is a stream with an event time; rows later than ``late`` are left out by the watermark."""
    at = F.col(ts).cast("timestamp")
    step = f"{lay.step} microseconds"
    timed = df.withColumn("_at", at).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", step)).agg(F.count("*").alias("n"))
    start = F.unix_micros(F.col("window.start"))
    number = F.floor(start / F.lit(lay.span)).cast("long")
    slot = F.call_function("div", start - number * F.lit(lay.span), F.lit(lay.step))
    return counted.select(number.alias("chunk"), slot.alias("slot"), F.col("window.start").alias("slot_start"), "n")
