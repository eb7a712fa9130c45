"""Optimistic transactions: work on a snapshot, refused at commit where others wrote the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Graph
from .errors import Conflict


def written(before: Graph, after: Graph) -> dict[str, DataFrame]:
    """By label, the keys (k) of nodes that differ between two snapshots of a graph."""
    out = {}
    for label, t in after.nodes.items():
        old = before.nodes.get(label)
        if old is None:
            out[label] = t.df.select(F.col(t.key).alias("k"))
        elif old.df is not t.df:
            row = lambda df, key: df.select(F.col(key).alias("k"), F.xxhash64(*sorted(t.df.columns)).alias("h"))
            a, b = (df.select([F.col(c) if c in df.columns else F.lit(None).alias(c) for c in t.df.columns]) for df in (old.df, t.df))
            a, b = row(a, t.key).groupBy("k").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("ha")), row(b, t.key).groupBy("k").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("hb"))
            out[label] = a.join(b, "k", "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("k")
    return out


class Transaction:
    """Statements on the engine's snapshot as it was; ``commit`` brings them to the engine."""

    def __init__(self, engine):
        self.engine, self.base = engine, engine.graph
        self.own = type(engine)(engine.graph, engine.row_budget, **engine.options)

    def execute(self, statement, params: dict | None = None):
        return self.own.execute(statement, params)

    def rows(self, statement, params: dict | None = None) -> DataFrame:
        return self.own.rows(statement, params)

    def commit(self) -> Graph:
        """The engine's new snapshot; Conflict where a node, or an edge label, was written by
        both sides since the transaction began."""
        theirs, mine = written(self.base, self.engine.graph), written(self.base, self.own.graph)
        for label in theirs.keys() & mine.keys():
            if not theirs[label].join(mine[label], "k", "left_semi").isEmpty():
                raise Conflict(f"nodes of {label} were written since")
        out = self.engine.graph.copy()
        edges = [x for x, parts in self.own.graph.edges.items() if self._touched(self.base, self.own.graph, x)]
        for label in edges:
            if self._touched(self.base, self.engine.graph, label):
                raise Conflict(f"{label} edges were written since")
        for label, keys in mine.items():
            t = self.own.graph.nodes[label]
            if label not in theirs:
                out.nodes[label] = t
                continue
            now = out.nodes[label]
            kept = now.df.join(keys, F.col(now.key) == F.col("k"), "left_anti")
            new = t.df.join(keys, F.col(t.key) == F.col("k"), "left_semi")
            out.nodes[label] = replace(now, df=kept.unionByName(new, allowMissingColumns=True))
        for label in edges:
            out.edges[label] = list(self.own.graph.edges[label])
        for label, parts in out.edges.items():  # edges held in a node's table follow it
            held = {id(g.nodes[x].df): x for g in (self.base, self.own.graph, self.engine.graph) for x in g.nodes}
            out.edges[label] = [replace(p, df=out.nodes[held[id(p.df)]].df) if p.held_by and id(p.df) in held else p for p in parts]
        self.engine.graph = out
        return out

    @staticmethod
    def _touched(before: Graph, after: Graph, label: str) -> bool:
        a, b = before.edges.get(label, []), after.edges.get(label, [])
        return len(a) != len(b) or any((x.df is not y.df and not (x.held_by and y.held_by)) or x.held_by != y.held_by for x, y in zip(a, b))
