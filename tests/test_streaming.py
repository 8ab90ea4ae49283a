"""A stream of arriving rows against the batch lattice."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.operators.series import lattice
from gridloom.plans import series as plans
from gridloom.streaming.arrivals import arriving

SF = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(SF)
    lay = plans.layout(None, 6, dt.timedelta(hours=1))
    folder = f"{tmp_path}/in"
    events.write.parquet(folder)
    stream = arriving(spark.readStream.schema(events.schema).parquet(folder), "ts", lay)
    query = stream.writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    try:
        query.processAllAvailable()
        got = {(r["chunk"], r["slot"]): r["n"] for r in spark.table("arrivals").collect()}
    finally:
        query.stop()
    everything = plans.window([dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)], None, None)
    want = {(r["chunk"], r["slot"]): r["n"] for r in lattice(events, "ts", lay, everything).groupBy("chunk", "slot").agg(F.count("*").alias("n")).collect()}
    assert got == want
