"""Conditions of automation rules: a pattern around the nodes that changed, and a test of
what it finds. Edges are (src, dst, edge_id, label); nothing is gathered per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
_TESTS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def pattern(edges: DataFrame, direction: str = "out", label: str | None = None, bound: DataFrame | None = None) -> DataFrame:
    """(node, other, edge_id, ...): every edge seen from a node, all nodes or those bound
    (column node). Undirected, an edge is seen from both ends, and so a loop twice."""
    e = edges if label is None else edges.filter(F.col("label") == label)
    more = [c for c in e.columns if c not in ("src", "dst")]
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), *more)
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), *more)
    rows = {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()
    return rows if bound is None else rows.join(bound.select("node").distinct(), "node", "left_semi")


def holds(bound: DataFrame, rows: DataFrame, fn: str, op: str, value, field: Column | None = None) -> DataFrame:
    """(node, holds) for each bound node: an aggregate over its pattern rows against a value.
    Over no rows a count and a sum are 0; other aggregates are missing, and their tests false."""
    what = _AGGREGATES[fn](F.lit(1) if field is None else field)
    got = bound.select("node").distinct().join(rows.groupBy("node").agg(what.alias("x")), "node", "left")
    x = F.coalesce("x", F.lit(0)) if fn in ("count", "sum") else F.col("x")
    return got.select("node", F.coalesce(_TESTS[op](x, F.lit(value)), F.lit(False)).alias("holds"))


def dispatched(triggered: DataFrame, checked: DataFrame, node: str = "node_id") -> DataFrame:
    """Triggered changes whose node's condition holds."""
    return triggered.join(checked.filter("holds").select(F.col("node").alias(node)), node, "left_semi")
