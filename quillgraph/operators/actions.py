"""What automations do to a graph: templates, updates that skip what is unchanged, upserts
of edges, and ordered lists of mutations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Graph
from ..errors import Conflict, Unsupported
from ..functions import values as V
from ..model import Delete, Insert, Item, LinkNodes, NodePattern, Query, Ref, SetFields, Step
from .hierarchy import edge_frame, move, reorder
from .mutate import replace_references

_HOLE = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}")


def render(template: str, df: DataFrame, missing: str = "") -> Column:
    """A text with ``{{changed.title}}``, ``{{old.title}}`` or ``{{alias.field}}`` filled from
    columns named like that (dots within structs or within names)."""
    types = dict(df.dtypes)
    parts, at = [], 0
    for m in _HOLE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1]
        if name in types:
            c, kind = F.col(f"`{name}`"), types[name]
        elif name.split(".")[0] in types:
            c = F.col(f"`{name.split('.')[0]}`")
            for f in name.split(".")[1:]:
                c = c[f]
            kind = df.select(c.alias("x")).dtypes[0][1]
        else:
            raise Unsupported(f"{name} is not known")
        parts.append(F.coalesce(V.render(c, kind), F.lit(missing)))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def update_changed(nodes: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes after, (key, changed_fields)): fields of ``updates`` replace those of the same
    key; values whose text is the same count as unchanged. A null in updates is no update."""
    fields = [c for c in updates.columns if c != key]
    types = dict(nodes.dtypes)
    u = updates.select(key, *[F.col(f"`{c}`").alias(f"__{c}") for c in fields])
    both = nodes.join(u, key, "left")
    new = lambda c: F.col(f"`__{c}`")
    old_text = lambda c: F.coalesce(V.render(F.col(f"`{c}`"), types[c]), F.lit(V.MISSING)) if c in types else F.lit(V.MISSING)
    kinds = dict(updates.dtypes)
    hit = {c: new(c).isNotNull() & (V.render(new(c), kinds[c]) != old_text(c)) for c in fields}
    changed = F.array_compact(F.array(*[F.when(hit[c], F.lit(c)) for c in fields]))
    log = both.select(key, changed.alias("changed_fields")).filter(F.size("changed_fields") > 0)
    cols = [F.when(hit[c], new(c).cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in nodes.columns]
    more = [F.when(hit[c], new(c)).alias(c) for c in fields if c not in types]
    return both.select(*cols, *more), log


def upsert_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges (src, dst, label, edge_id, …) with the wanted (src, dst, label, …) put in: an
    edge of the same ends and label is updated (its edge_id stays), others are added."""
    keys = ["src", "dst", "label"]
    props = [c for c in wanted.columns if c not in keys]
    one = wanted.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"__{c}") for c in props], F.lit(True).alias("__hit"))
    both = edges.join(one, keys, "left")
    kept = both.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in props else F.col(c) for c in edges.columns])
    fresh = wanted.dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti").withColumn("edge_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), 256))
    return kept.unionByName(fresh, allowMissingColumns=True)


def same_snapshot(before: dict, after: dict) -> None:
    """A search's parts must all have seen the same revision, analyser and format."""
    if before != after:
        raise Conflict(f"the snapshot changed: {sorted(k for k in {*before, *after} if before.get(k) != after.get(k))}")


def batch(graph: Graph, operations: list[dict], compiler_of) -> Graph:
    """An ordered list of mutations in one go; all or nothing, as the graph is a snapshot.

    A ``mask`` of update_node or upsert_node names the fields that it writes: others of
    ``fields`` are ignored, and a named one that ``fields`` lacks is cleared. Kinds: create_node, update_node, upsert_node, delete_node, create_edge, update_edge,
    delete_edge, replace_references, move_subtree, reorder_children.
    """
    from . import mutate

    for op in operations:
        kind = op["op"]
        if kind in ("update_node", "upsert_node") and op.get("mask") is not None:
            op = {**op, "fields": {name: op["fields"].get(name) for name in op["mask"]}}  # noqa: PLW2901
        apply = lambda st, g=graph: mutate.apply(g, st, compiler_of(g))[0]
        node = lambda alias="n", op=op: NodePattern(alias, [op["label"]], op.get("match", {}))
        if kind == "create_node":
            graph = apply(Insert(NodePattern(None, [op["label"]], op["fields"])))
        elif kind in ("update_node", "upsert_node"):
            q = Query(node(), items=[Item("n")])
            if kind == "upsert_node" and (op["label"] not in graph.nodes or compiler_of(graph).run(Query(node(), items=[Item("n")])).rows.isEmpty()):
                graph = apply(Insert(NodePattern(None, [op["label"]], {**op.get("match", {}), **op["fields"]})))
            else:
                graph = apply(SetFields(q, [(Ref("n", k), v) for k, v in op["fields"].items()]))
        elif kind == "delete_node":
            graph = apply(Delete(Query(node(), items=[Item("n")]), ["n"]))
        elif kind == "create_edge":
            ends = [NodePattern("a", [op["from"][0]], op["from"][1]), NodePattern("b", [op["to"][0]], op["to"][1])]
            graph = apply(LinkNodes(ends, "a", "b", op["edge"], None, op.get("fields", {}), False))
        elif kind == "delete_edge":
            step = Step("out", [op["edge"]], NodePattern("b", [op["to"][0]], op["to"][1]), "e")
            q = Query(NodePattern("a", [op["from"][0]], op["from"][1]), [step], items=[Item(Ref("e", "edge_id"))], mode="edges")
            graph = apply(Delete(q, ["e"]))
        elif kind == "update_edge":
            graph = _update_edge(graph, op)
        elif kind in ("replace_references", "move_subtree", "reorder_children"):
            graph = _reshape(graph, op)
        else:
            raise Unsupported(f"operation {kind} is not known")
    return graph


def _update_edge(graph: Graph, op: dict) -> Graph:
    from dataclasses import replace

    out, parts = graph.copy(), []
    for p in graph.parts(op["edge"]):
        hit, df = p.id_column() == F.lit(op["edge_id"]), p.df
        for k, v in op["fields"].items():
            old = F.col(f"`{k}`") if k in df.columns else F.lit(None)
            df = df.withColumn(k, F.when(hit, F.lit(v)).otherwise(old))
        parts.append(replace(p, df=df, held_by=None, props=list({*p.props, *op["fields"]})))
    out.edges[op["edge"]] = parts
    return out


def _reshape(graph: Graph, op: dict) -> Graph:
    """Reference updates, moves and orders, over whole-graph ids."""
    e = edge_frame(graph, op["edge"])
    if op["op"] == "move_subtree":
        e = move(e, op["node"], op["parent"], op.get("order"))
    elif op["op"] == "reorder_children":
        e = reorder(e, op["parent"], op["children"], op.get("step", 1.0))
    else:
        want = e.sparkSession.createDataFrame([(op["source"], t) for t in op["targets"]] or [(op["source"], None)], "src string, dst string")
        e = replace_references(e, want, op.get("mode", "replace")).withColumn("ord", F.lit(None).cast("double"))
    out, pairs = graph.copy(), sorted({(p.source, p.target) for p in graph.parts(op["edge"])})
    out.edges[op["edge"]] = []
    strip = lambda c: F.substring_index(c, ":", -1)
    for s, t in pairs:
        own = e.filter(F.startswith("src", F.lit(f"{s}:")) & F.startswith("dst", F.lit(f"{t}:")))
        ks, kt = graph.node(s).columns()[graph.node(s).key], graph.node(t).columns()[graph.node(t).key]
        own = own.select(strip("src").cast(ks).alias("src"), strip("dst").cast(kt).alias("dst"), "edge_id", "ord")
        out.add_edge(op["edge"], s, t, own, "src", "dst", edge_id=F.col("edge_id"), order="ord")
    return out


#: Rows that a context query may ask for.
CONTEXT_ROWS = 500


def context_query(engine, text: str, bound: str, changed: DataFrame, most: int = CONTEXT_ROWS, params: dict | None = None) -> DataFrame:
    """What a read says about each node that changed (column node), its rows by ``bound``.

    The statement only reads, names a label for every edge, uses the alias ``bound`` and asks
    for CONTEXT_ROWS rows at most; its FETCH FIRST counts for each node. A node with more
    than ``most`` rows is an error, not a cut."""
    from dataclasses import replace

    from ..errors import BindingProblem, BudgetExceeded
    from ..gql import parse

    q = parse(text, params)
    if not isinstance(q, Query):
        raise Unsupported("a context query only reads")
    if q.limit is None or q.limit > CONTEXT_ROWS:
        raise BudgetExceeded(f"a context query asks for {CONTEXT_ROWS} rows at most, by FETCH FIRST")
    if any(not s.labels for s in q.steps):
        raise Unsupported("the edges of a context query have labels")
    if bound not in [p.alias for p in q.patterns()]:
        raise BindingProblem(f"a context query uses {bound}")
    names = [i.output for i in q.items]
    more = [Item(Ref(bound, "node_id"), "__bound"), *[Item(r, f"__o{n}") for n, (r, _) in enumerate(q.order)]]
    rows = engine.rows_of(replace(q, items=[*q.items, *more], order=[], limit=None, offset=None))
    rows = rows.join(changed.select(F.col("node").alias("__bound")).distinct(), "__bound", "left_semi")
    by = [F.col(f"__o{n}").desc_nulls_last() if down else F.col(f"__o{n}").asc_nulls_last() for n, (_, down) in enumerate(q.order)] or [F.lit(0)]
    first = q.offset or 0
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__bound").orderBy(*by))).filter((F.col("__n") > first) & (F.col("__n") <= first + q.limit))
    if q.limit > most and not rows.filter(F.col("__n") > first + most).isEmpty():
        raise BudgetExceeded(f"a node has more than {most} rows")
    return rows.select(F.col("__bound").alias("bound"), *[F.col(f"`{n}`") for n in names])


def context(rows: DataFrame, most: int = CONTEXT_ROWS) -> DataFrame:
    """A bounded context read: more than ``most`` rows are an error, not a cut."""
    from ..errors import BudgetExceeded

    if rows.limit(most + 1).count() > most:
        raise BudgetExceeded(f"more than {most} rows")
    return rows


