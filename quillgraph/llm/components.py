"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and an equi-join over the edge list: nothing is gathered per
node, so a hub with very many links is a partial minimum and a join Spark can split. Each
round's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the links (u, v); component: its smallest node.

    Self-links, repeated and reversed links change nothing; rows with nulls are left out.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = scratch.write(e, "links")
    state = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.drop(e)
        e, old, state = new, state, _state(new)
        if state == old:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
