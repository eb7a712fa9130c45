"""Mutations: a snapshot and a statement give a new snapshot. Nothing is written in place;
a typed table becomes a union, a projection or an anti-join of the one before."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import places
from ..catalog import EdgePart, Graph, NodeTable, node_id
from ..errors import BindingProblem, BudgetExceeded, Conflict, Unsupported
from ..functions import values as V
from ..model import Delete, Insert, Item, LinkNodes, MergeNode, NodePattern, Query, Ref, SetFields
from . import hierarchy


def apply(graph: Graph, st, compiler):
    """(new snapshot, returned rows)."""
    spark = next(iter(graph.nodes.values())).df.sparkSession
    if isinstance(st, Insert):
        return _insert(graph, st.node, spark), spark.createDataFrame([], "inserted int")
    if isinstance(st, MergeNode):
        return _merge_node(graph, st, compiler, spark)
    if isinstance(st, SetFields):
        return _set(graph, st, compiler)
    if isinstance(st, Delete):
        return _delete(graph, st, compiler)
    if isinstance(st, LinkNodes):
        return _link(graph, st, compiler, spark)
    raise Unsupported(type(st).__name__)


def new_row(t: NodeTable, props: dict, key) -> DataFrame:
    """One row for a node table; columns it lacks are added."""
    spark = t.df.sparkSession
    types = t.columns()
    cols = [F.lit(key).cast(types[t.key]).alias(t.key)] + [F.lit(v).cast(types[k]).alias(k) if k in types else F.lit(v).alias(k) for k, v in props.items() if k != t.key]
    return spark.range(1).select(*cols)


def fresh_key(t: NodeTable, props: dict, revision: int):
    """The key a row names, else one that its content and the snapshot settle."""
    if t.key in props:
        return props[t.key]
    h = hashlib.sha256(json.dumps([t.label, props, revision], sort_keys=True, default=str).encode()).hexdigest()
    return -(int(h[:15], 16)) if t.columns()[t.key] in V.INTEGER else h[:32]


def _put(graph: Graph, t: NodeTable, df: DataFrame) -> Graph:
    """The snapshot with a label's table replaced; edges held in that table follow."""
    out = graph.copy()
    out.nodes[t.label] = replace(t, df=df)
    for label, parts in out.edges.items():
        out.edges[label] = [replace(p, df=df) if p.df is t.df else p for p in parts]
    return out


def _insert(graph: Graph, node: NodePattern, spark) -> Graph:
    label = node.labels[0]
    if label not in graph.nodes:
        key = node.props.get("id") or hashlib.sha256(json.dumps(node.props, sort_keys=True, default=str).encode()).hexdigest()[:32]
        df = spark.range(1).select(F.lit(str(key)).alias("id"), *[F.lit(v).alias(k) for k, v in node.props.items() if k != "id"])
        return graph.copy().add_node(label, df, "id")
    t = graph.node(label)
    row = new_row(t, node.props, fresh_key(t, node.props, graph.revision))
    if t.labels:
        row = row.withColumn(t.labels, F.array(*[F.lit(x) for x in node.labels]))
    return _put(graph, t, t.df.unionByName(row, allowMissingColumns=True))


def _page(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def _merge_node(graph, st: MergeNode, compiler, spark):
    q = Query(st.node, items=st.items, limit=st.limit)
    if st.node.labels and st.node.labels[0] in graph.nodes and not compiler.run(Query(NodePattern("n", st.node.labels, st.node.props), items=[Item("n")])).rows.isEmpty():
        return graph, compiler.run(q).rows
    out = _insert(graph, st.node, spark)
    again = type(compiler)(out, **compiler.options())
    return out, again.run(q).rows


def _set(graph, st: SetFields, compiler):
    """All rows are matched first; a node or edge met twice is written once. The rows that
    matched are returned, with what was written wherever they show it."""
    q = st.match
    al = compiler.bind(q)
    nodes: dict[str, dict] = {}
    edges: dict[str, dict] = {}
    for ref, v in st.assignments:
        if ref.alias not in al or al[ref.alias].kind == "path":
            raise BindingProblem(f"{ref.alias} is not a node or an edge")
        (nodes if al[ref.alias].kind == "node" else edges).setdefault(ref.alias, {})[ref.field] = v
    matched = compiler.match(q, al, [Ref(a, "edge_id") for a in edges])
    keys = [f"`{p.alias}__k`" for p in q.patterns()]
    if q.limit is not None or q.offset is not None:
        matched = compiler._page(q, al, matched, keys)
    out = graph
    for alias, sets in nodes.items():
        t = out.node(al[alias].label)
        if t.key in sets:
            raise Unsupported("keys stay as they are")
        hit = matched.select(F.col(f"`{alias}__k`").alias("__hit")).distinct()
        out = _put(out, t, _written(t.df.join(hit, F.col(t.key) == F.col("__hit"), "left"), sets))
    for alias, sets in edges.items():
        hit = matched.select(F.col(f"`{alias}__properties.edge_id`").alias("__hit")).distinct()
        out = out.copy()
        parts = []
        for p in out.parts(al[alias].label):
            if {p.src, p.dst} & set(sets):
                raise Unsupported("ends of an edge stay as they are")
            df = p.df.withColumn("__id", p.id_column().cast("string"))
            if p.edge_id is not None:  # a written property must not change the id
                df = df.withColumn("__edge", F.col("__id"))
            df = _written(df.join(hit, F.col("__id") == F.col("__hit"), "left"), sets).drop("__id")
            own = [c for c in dict.fromkeys([*(p.props or [c for c in p.df.columns if c not in (p.src, p.dst)]), *sets])]
            parts.append(replace(p, df=df, held_by=None, props=own, edge_id=F.col("__edge") if p.edge_id is not None else None))
        out.edges[al[alias].label] = parts
    # the matched rows, with the new values at every alias that shows a written node or edge
    again = type(compiler)(out, **compiler.options())
    rows = matched
    for kind, written in (("node", nodes), ("edge", edges)):
        mark = "k" if kind == "node" else "properties.edge_id"
        for alias, sets in written.items():
            for other, what in al.items():
                if what.kind != kind or what.label != al[alias].label or (kind == "edge" and f"{other}__{mark}" not in rows.columns):
                    continue
                if other != alias:
                    hit = matched.select(F.col(f"`{alias}__{mark}`").alias("__hit")).distinct()
                    rows = rows.join(hit, F.col(f"`{other}__{mark}`") == F.col("__hit"), "left")
                for name, v in sets.items():
                    c, have = f"{other}__properties.{name}", f"{other}__properties.{name}" in rows.columns
                    new = _literal(v, dict(out.node(what.label).df.dtypes).get(name) if kind == "node" else None)
                    old = F.col(f"`{c}`") if have else F.lit(None)
                    rows = rows.withColumn(c, new if other == alias else F.when(F.col("__hit").isNotNull(), new).otherwise(old))
                    what.types[f"properties.{name}"] = dict(rows.dtypes)[c]
                rows = rows.drop("__hit")
    return out, again.shape(replace(q, limit=None, offset=None, order=[]), al, rows, keys)


def _literal(v, kind: str | None):
    return F.lit(v).cast(kind) if kind else F.lit(v)


def _written(df: DataFrame, sets: dict) -> DataFrame:
    """Rows that were hit (column __hit) with their new values."""
    types = dict(df.dtypes)
    for name, v in sets.items():
        new = _literal(v, types.get(name))
        old = F.col(f"`{name}`") if name in types else F.lit(None).cast("string" if v is None else dict(df.select(F.lit(v).alias("x")).dtypes)["x"])
        df = df.withColumn(name, F.when(F.col("__hit").isNotNull(), new).otherwise(old))
    return df.drop("__hit")


def incident(graph: Graph, label: str, keys: DataFrame) -> DataFrame:
    """(edge label, edge_id) of the edges at nodes (column k) of a label."""
    found = []
    for name, parts in graph.edges.items():
        for p in parts:
            for side, end in ((p.src, p.source), (p.dst, p.target)):
                if end == label:
                    found.append(p.df.filter(F.col(p.src).isNotNull() & F.col(p.dst).isNotNull()).join(keys, F.col(side) == F.col("k"), "left_semi").select(F.lit(name).alias("label"), p.id_column().alias("edge_id")))
    if not found:
        return keys.sparkSession.createDataFrame([], "label string, edge_id string")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _delete(graph, st: Delete, compiler):
    al = compiler.bind(st.match)
    for a in st.aliases:
        if a not in al or al[a].kind == "path":
            raise BindingProblem(f"{a} can't be deleted")
    edge_aliases = [a for a in st.aliases if al[a].kind == "edge"]
    matched = compiler.match(st.match, al, [Ref(a, "edge_id") for a in edge_aliases])
    rows = _page(compiler.shape(replace(st.match, limit=None), al, matched, [f"`{p.alias}__k`" for p in st.match.patterns()]), st.match.limit)
    out = graph
    for a in edge_aliases:  # edges first
        gone = matched.select(F.col(f"`{a}__properties.edge_id`").alias("__gone")).distinct()
        out = without_edges(out, al[a].label, gone)
    for a in st.aliases:
        if al[a].kind != "node":
            continue
        keys = matched.select(F.col(f"`{a}__k`").alias("k")).distinct()
        if not incident(out, al[a].label, keys).isEmpty():
            raise Conflict("a node still has edges")
        t = out.node(al[a].label)
        out = _put(out, t, t.df.join(keys, F.col(t.key) == F.col("k"), "left_anti"))
    return out, rows


def without_edges(graph: Graph, label: str, gone: DataFrame) -> Graph:
    """The snapshot without edges whose edge_id is in ``gone`` (column __gone). Edges held
    by a node's row are cut loose from it: the row stays."""
    out = graph.copy()
    parts = []
    for p in out.edges[label]:
        df = p.df.withColumn("__id", p.id_column()).join(gone, F.col("__id") == F.col("__gone"), "left_anti").drop("__id")
        parts.append(replace(p, df=df, held_by=None))
    out.edges[label] = parts
    return out


def _link(graph, st: LinkNodes, compiler, spark):
    by = {n.alias: n for n in st.nodes}
    if st.source not in by or st.target not in by or st.label is None:
        raise BindingProblem("an edge needs a label and two matched nodes")
    ends = {}
    for a in (st.source, st.target):
        if st.merge and not by[a].props:
            raise BindingProblem(f"{a} needs a property that tells it apart")
        q = Query(by[a], items=[Item(a)])
        al = compiler.bind(q)
        ends[a] = (al[a].label, compiler.match(Query(by[a], items=[]), al).select(F.col(f"`{a}__k`").alias(a)).distinct())
        if st.merge and ends[a][1].limit(2).count() > 1:
            raise Conflict(f"{a} matches more than one node")
    (sl, sdf), (tl, tdf) = ends[st.source], ends[st.target]
    # independent matches make every pair, as the statement says, within the budget
    if st.source != st.target and sdf.count() * tdf.count() > compiler.pair_budget:
        raise BudgetExceeded(f"more than {compiler.pair_budget} pairs of {st.source} and {st.target}")
    pairs = sdf.crossJoin(tdf) if st.source != st.target else sdf.withColumn("__t", F.col(st.source))
    new = pairs.select(F.col(pairs.columns[0]).alias("src"), F.col(pairs.columns[1]).alias("dst"), *[F.lit(v).alias(k) for k, v in st.props.items()])
    out = graph.copy()
    have = [p for p in out.edges.get(st.label, []) if (p.source, p.target) == (sl, tl)]
    if st.merge and have:
        for p in have:
            old = p.df
            types = dict(old.dtypes)
            for k, v in st.props.items():
                old = old.filter(V.compare(F.col(k), types[k], "=", v)) if k in types else old.limit(0)
            old = old.select(F.col(p.src).alias("__s"), F.col(p.dst).alias("__d")).distinct()
            new = new.join(old, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "left_anti")
    digest = F.sha2(F.concat_ws("|", F.lit(st.label), F.lit(str(out.revision)), F.col("src").cast("string"), F.col("dst").cast("string")), 256)
    new = new.withColumn("edge_id", digest)
    out.edges.setdefault(st.label, []).append(EdgePart(st.label, sl, tl, new, "src", "dst", edge_id=F.col("edge_id"), props=list(st.props)))
    if compiler.schema is not None and any(e.hierarchy and st.label in (e.name, *e.labels) for e in compiler.schema.edges):
        places.checkpoints(spark)
        if not hierarchy.violations(hierarchy.edge_frame(out, st.label)).isEmpty():
            raise Conflict(f"{st.label} is a hierarchy: a node would have two parents, or be below itself")
    rows = pairs.select(node_id(sl, F.col(pairs.columns[0])).alias("source"), node_id(tl, F.col(pairs.columns[1])).alias("target"))
    if st.items:
        keep = [i for i in st.items if i.what in (st.source, st.target)]
        names = {st.source: "source", st.target: "target"}
        if keep:
            rows = rows.select(*[F.col(names[i.what]).alias(i.output) for i in keep])
    return out, _page(rows, st.limit)


def overlay(base: DataFrame, key: str, deletes: DataFrame | None = None, puts: DataFrame | None = None) -> DataFrame:
    """Read-your-writes: the base without staged deletes and replaced rows, plus the puts."""
    out = base
    if deletes is not None:
        out = out.join(deletes.select(F.col(key)).distinct(), key, "left_anti")
    if puts is not None:
        out = out.join(puts.select(F.col(key)).distinct(), key, "left_anti").unionByName(puts, allowMissingColumns=True)
    return out


def replace_references(edges: DataFrame, wanted: DataFrame, mode: str = "replace", label: str | None = None) -> DataFrame:
    """Edges (src, dst, edge_id) after a reference update to ``wanted`` (src, dst): replace,
    add or remove. Duplicate edges to one target collapse to the lowest edge_id; remove for
    a source with a null target removes all its edges. With a ``label`` (column label) only
    edges that bear it are touched, and new ones bear it."""
    if label is not None:
        mine = replace_references(edges.filter(F.col("label") == label).select("src", "dst", "edge_id"), wanted, mode)
        return edges.filter(~F.col("label").eqNullSafe(F.lit(label))).select("src", "dst", "edge_id", "label").unionByName(mine.withColumn("label", F.lit(label)))
    one = edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    want = wanted.select("src", "dst").distinct()
    fresh = want.filter("dst IS NOT NULL").join(one, ["src", "dst"], "left_anti").withColumn("edge_id", F.sha2(F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string")), 256))
    if mode == "add":
        return one.unionByName(fresh)
    if mode == "remove":
        every = want.filter("dst IS NULL").select("src")
        return one.join(every, "src", "left_anti").join(want.filter("dst IS NOT NULL"), ["src", "dst"], "left_anti")
    touched = want.select("src").distinct()
    kept = one.join(touched, "src", "left_anti").unionByName(one.join(want, ["src", "dst"], "left_semi"))
    return kept.unionByName(fresh)


def check_base(graph: Graph, base_revision: int, touched: set, written: set) -> None:
    """Optimistic check: work based on an older revision may only commit if what it wrote
    and what was committed since are disjoint."""
    if graph.revision != base_revision and touched & written:
        raise Conflict("the same rows were written since")
