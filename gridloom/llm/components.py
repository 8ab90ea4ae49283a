"""Connected components by alternating large and small stars (Kiveris et al., 2014), on tables in the shared folder.

A component never meets in one task: each step takes, for every node, the least neighbour by a partial aggregate, and
joins it back; joins start from written tables, so adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, materialize


def _star(edges: DataFrame) -> DataFrame:
    """Links every neighbour v of u, as far as listed, and u itself to the least of them. edges: (u, v)."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = materialize(least, "components-least", narrow=True)
    joined = edges.join(least, "u")
    out = joined.select(F.col("v").alias("a"), "m").unionAll(least.select(F.col("u").alias("a"), "m"))
    return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the component is its least node. Loops are allowed."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "components-links", narrow=True)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the neighbours above u; small star: those below it
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least", narrow=True)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "components-large", narrow=True)
        small = materialize(_star(large), "components-small", narrow=True)
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(edges)
        discard(large)
        discard(least)
        edges = small
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
