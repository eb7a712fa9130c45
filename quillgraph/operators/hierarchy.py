"""Trees over ``contains`` edges: subtrees, children, ancestors, moves and their checks.

Edges are DataFrames (src, dst, edge_id, ord) of whole-graph ids. Descents go level by
level; each level is one join with the edges and one anti-join with what its root has
visited, so a level costs what it reaches. Levels are checkpointed every few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Graph, node_id
from ..errors import BudgetExceeded, Conflict


def edge_frame(graph: Graph, label: str = "contains", pairs: list[tuple[str, str]] | None = None, filters=None) -> DataFrame:
    """(src, dst, edge_id, ord) of a label's edges in whole-graph ids. ``filters``: conditions
    on the rows of an edge part."""
    out = []
    for p in graph.parts(label):
        if pairs is None or (p.source, p.target) in pairs:
            e = p.df.filter(F.col(p.src).isNotNull() & F.col(p.dst).isNotNull())
            for c in filters(p) if filters else []:
                e = e.filter(c)
            order = F.col(p.order).cast("double") if p.order else F.lit(None).cast("double")
            out.append(e.select(node_id(p.source, F.col(p.src)).alias("src"), node_id(p.target, F.col(p.dst)).alias("dst"), p.id_column().alias("edge_id"), order.alias("ord")))
    return reduce(lambda a, b: a.unionByName(b), out)


def subtree(roots: DataFrame, edges: DataFrame, min_depth: int = 0, max_depth: int = -1, direction: str = "out", max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(root, node, parent, edge_id, ord, depth) for roots (column root): breadth first, each
    node once per root, the root itself at depth 0 unless min_depth is above. Unbounded
    with max_depth -1: it ends when a level is empty. All roots together visit ``max_nodes``
    nodes and follow ``max_edges`` edges at most, or a level beyond them is an error."""
    budgeted = max_nodes is not None or max_edges is not None
    e = edges if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "ord")
    at = roots.select("root", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("double").alias("ord"), F.lit(0).alias("depth")).distinct()
    seen, depth = at, 0
    nodes, followed = (at.count() if budgeted else 0), 0
    _within(nodes, max_nodes, "nodes")
    best = Window.partitionBy("root", "node").orderBy(F.col("ord").asc_nulls_last(), "edge_id")
    while max_depth < 0 or depth < max_depth:
        depth += 1
        nxt = at.select("root", F.col("node").alias("src")).join(e, "src").select("root", F.col("dst").alias("node"), F.col("src").alias("parent"), "edge_id", "ord", F.lit(depth).alias("depth"))
        if max_edges is not None:
            nxt = nxt.checkpoint()
            followed += nxt.count()
            _within(followed, max_edges, "edges")
        nxt = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        nxt = nxt.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
        if max_depth < 0 or budgeted or depth % 3 == 0:  # written once: every later level reads it
            nxt = nxt.checkpoint()
            if budgeted:
                nodes += nxt.count()
                _within(nodes, max_nodes, "nodes")
            if nxt.isEmpty():
                break
        at, seen = nxt, seen.unionByName(nxt)
    return seen.filter(F.col("depth") >= min_depth)


def _within(n: int, most: int | None, what: str) -> None:
    if most is not None and n > most:
        raise BudgetExceeded(f"more than {most} {what}")


def child_order():
    """Children by numeric order, ordered ones first, then edge id."""
    return Window.partitionBy("src").orderBy(F.col("ord").asc_nulls_last(), "edge_id")


def children(edges: DataFrame) -> DataFrame:
    """(parent, child, place from 1)."""
    return edges.withColumn("place", F.row_number().over(child_order())).select(F.col("src").alias("parent"), F.col("dst").alias("child"), "place")


def parents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("child"), F.col("src").alias("parent"))


def ancestors(nodes: DataFrame, edges: DataFrame, max_depth: int = 256) -> DataFrame:
    """(node, ancestor, depth) by walking up; cycles end where a node comes again."""
    at = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"), F.array("node").alias("seen"))
    out = []
    up = edges.select(F.col("dst").alias("ancestor"), F.col("src").alias("above"))
    for depth in range(1, max_depth + 1):
        at = at.join(up, "ancestor").filter(~F.array_contains("seen", F.col("above")))
        at = at.select("node", F.col("above").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("seen", F.array("above")).alias("seen"))
        if max_depth > 8:
            at = at.checkpoint()
            if at.isEmpty():
                break
        out.append(at.select("node", "ancestor", "depth"))
    if not out:
        return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), out)


def nearest_ancestor(nodes: DataFrame, edges: DataFrame, labels: list[str], max_depth: int = 256) -> DataFrame:
    """(node, ancestor, depth): the first node on the way up, itself included, of a label."""
    every = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(ancestors(nodes, edges, max_depth))
    hit = every.filter(F.substring_index("ancestor", ":", 1).isin(labels))
    return hit.groupBy("node").agg(F.min(F.struct("depth", "ancestor")).alias("x")).select("node", "x.ancestor", "x.depth")


def remove_nested(selected: DataFrame, edges: DataFrame, max_depth: int = 256) -> DataFrame:
    """Selected nodes (column node) without a selected ancestor."""
    up = ancestors(selected, edges, max_depth).join(selected.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    return selected.join(up.select("node").distinct(), "node", "left_anti")


def trees(flat: DataFrame) -> DataFrame:
    """(root, members): a root's nodes as an array ordered by depth, order, id; a missing or
    non-numeric order counts as 0."""
    one = F.struct("depth", F.coalesce("ord", F.lit(0.0)).alias("ord"), "node", "parent")
    return flat.groupBy("root").agg(F.sort_array(F.collect_list(one)).alias("members"))


def nest(members: list) -> dict:
    """One collected tree as nested dictionaries (an API edge, not a plan)."""
    made = {m["node"]: {"node": m["node"], "children": []} for m in members}
    root = None
    for m in members:
        if m["parent"] in made:
            made[m["parent"]]["children"].append(made[m["node"]])
        elif root is None:
            root = made[m["node"]]
    return root


def source_text(flat: DataFrame, texts: DataFrame) -> DataFrame:
    """(root, text, source_hash): a root's text with its descendants' as indented bullets in
    child order. ``flat`` comes from subtree; texts: (node, text)."""
    rows = flat.join(texts, "node", "left").withColumn("text", F.coalesce("text", F.lit("")))
    # a node's place is the path of its ancestors' places, padded so text order is tree order
    place = F.lpad(F.coalesce(F.col("ord"), F.lit(0.0)).cast("bigint").cast("string"), 20, "0")
    own = rows.select("root", "node", "parent", "depth", "text", F.concat_ws("/", place, "node").alias("place"))
    paths = own.filter("depth = 0").select("root", "node", "depth", "text", F.lit("").alias("path"))
    out, at, level = paths, paths, 0
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    while level < deepest:
        level += 1
        at = own.filter(F.col("depth") == level).join(at.select("root", F.col("node").alias("parent"), F.col("path").alias("above")), ["root", "parent"])
        at = at.select("root", "node", "depth", "text", F.concat("above", F.lit("/"), "place").alias("path"))
        out = out.unionByName(at)
    line = F.when(F.col("depth") == 0, F.col("text")).otherwise(F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), "text"))
    body = out.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return body.withColumn("source_hash", F.sha2("text", 256))


def violations(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(rule, node): nodes with several parents, and nodes on cycles."""
    many = edges.groupBy("dst").agg(F.countDistinct("src").alias("n")).filter("n > 1").select(F.lit("single_parent").alias("rule"), F.col("dst").alias("node"))
    loops = edges.filter("src = dst").select(F.lit("acyclic").alias("rule"), F.col("src").alias("node")).distinct()
    # nodes that stay when nodes without a parent are peeled off, again and again
    core = edges.filter("src <> dst")
    for _ in range(max_depth):
        nxt = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*core.columns).checkpoint()
        if nxt.count() == core.count():
            break
        core = nxt
    cyc = core.select(F.lit("acyclic").alias("rule"), F.col("src").alias("node")).distinct()
    return many.unionByName(loops.unionByName(cyc).distinct())


def move(edges: DataFrame, node: str, new_parent: str, order: float | None = None) -> DataFrame:
    """Edges with ``node`` under another parent; its edge keeps its id. A move under one's
    own subtree is a Conflict."""
    spark = edges.sparkSession
    below = subtree(spark.createDataFrame([(node,)], "root string"), edges)
    if not below.filter(F.col("node") == new_parent).isEmpty():
        raise Conflict("a node can't move below itself")
    mine = F.col("dst") == node
    return edges.withColumn("src", F.when(mine, F.lit(new_parent)).otherwise(F.col("src"))).withColumn("ord", F.when(mine, F.lit(order).cast("double")).otherwise(F.col("ord")))


def reorder(edges: DataFrame, parent: str, ordered: list[str], step: float = 1.0) -> DataFrame:
    """Edges with a parent's children in the given order: n * step from 1. Every child must
    be named exactly once."""
    have = [r["dst"] for r in edges.filter(F.col("src") == parent).select("dst").collect()]  # one parent's children
    if sorted(have) != sorted(ordered):
        raise Conflict("the order must name every child exactly once")
    new = edges.sparkSession.createDataFrame([(c, float((i + 1) * step)) for i, c in enumerate(ordered)], "__c string, __o double")
    hit = edges.join(F.broadcast(new), (F.col("src") == parent) & (F.col("dst") == F.col("__c")), "left")
    return hit.withColumn("ord", F.coalesce("__o", "ord")).drop("__c", "__o")


def delete_recursively(nodes: DataFrame, edges: DataFrame, roots: DataFrame, other_edges: DataFrame | None = None):
    """(nodes, edges): without the roots (column root), their descendants and every edge at
    any of them. nodes: column node."""
    gone = subtree(roots, edges).select("node").distinct()
    every = edges if other_edges is None else edges.unionByName(other_edges)
    left = every.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left.select(*edges.columns)
