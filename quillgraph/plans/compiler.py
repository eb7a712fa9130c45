"""Logical query to DataFrame.

Only the columns that a query names leave a scan. A hop is an equi-join on native keys; one
over a foreign key is a single join. Filters stand on the tables they speak of, Catalyst
pushes them to the scans. Bounded walks are unions of unrolled joins over ids, with the
visited ids in an array; fields of their targets join at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import EdgePart, Graph, NodeTable, node_id
from ..errors import AccessPathMissing, BindingProblem, SchemaProblem, Unsupported
from ..functions import values as V
from ..operators import hierarchy
from ..model import BUILDER_MAX_DEPTH, Aggregate, And, Compare, Exists, HasTag, IsNull, Item, NodePattern, Or, Predicate, Query, Ref, Similar, Step, Text, all_of, conjuncts, refs_of

PSEUDO_NODE, PSEUDO_EDGE = ("node_id", "content"), ("edge_id", "from_node_id", "to_node_id", "label")


@dataclass
class Result:
    """Rows, and for RETURN GRAPH the distinct nodes and edges behind them."""

    rows: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    explain: dict = field(default_factory=dict)


@dataclass
class _Alias:
    kind: str  # node, edge, path
    label: str | None = None
    types: dict[str, str] = field(default_factory=dict)


def col(alias: str, name: str) -> Column:
    return F.col(f"`{alias}__{name}`")


class Compiler:
    def __init__(self, graph: Graph, strict_order: bool = False, index_semantics: bool = False, vectors=None, strict_schema: bool = False, pair_budget: int = 1_000_000, schema=None):
        """``index_semantics``: an ordered read of a field with a declared ordered index drops
        rows without the field, as a walk over the index does. ``strict_order``: refuse
        orders that no index serves. ``vectors``: fn(query, top) giving (node_id, rank, score).
        ``pair_budget``: pairs that matches without an edge between them may make. ``schema``:
        a schema document; in strict mode names that it lacks and ends that it forbids are
        refused, in warn mode they are listed in ``warnings``."""
        self.graph, self.strict_order, self.index_semantics, self.vectors, self.strict_schema = graph, strict_order, index_semantics, vectors, strict_schema
        self.pair_budget, self.schema, self.warnings = pair_budget, schema, []

    def options(self) -> dict:
        return {k: getattr(self, k) for k in ("strict_order", "index_semantics", "vectors", "strict_schema", "pair_budget", "schema")}

    # names -----------------------------------------------------------------------------
    def bind(self, q: Query) -> dict[str, _Alias]:
        out: dict[str, _Alias] = {}

        def add(name, what):
            if name in out:
                raise BindingProblem(f"{name} is used twice")
            out[name] = what

        for n, p in enumerate(q.patterns()):
            if p.alias is None:
                p.alias = f"_n{n}"
            add(p.alias, _Alias("node", p.labels[0] if p.labels else None))
        for n, s in enumerate(q.steps):
            if len(s.labels) != 1:
                raise AccessPathMissing("every edge needs exactly one label", "name the edge's label")
            if not 0 <= s.min_depth <= s.max_depth <= BUILDER_MAX_DEPTH:
                raise BindingProblem("depths are out of range")
            if s.quantified and s.alias:
                raise BindingProblem("an edge of several steps has no alias")
            if s.alias is None:
                s.alias = f"_e{n}"
            add(s.alias, _Alias("edge", s.labels[0]))
        if q.path:
            if not q.steps:
                raise BindingProblem("a path needs an edge")
            add(q.path, _Alias("path"))
        self._infer(q, out)
        seen_equal: dict[tuple, object] = {}
        for p in q.patterns():
            for k, v in p.props.items():
                seen_equal[(p.alias, k)] = v
        for c in conjuncts(q.where):
            if isinstance(c, Compare) and c.op == "=" and c.ref.namespace == "properties":
                key = (c.ref.alias, c.ref.field)
                if key in seen_equal and seen_equal[key] != c.value:
                    raise BindingProblem(f"conflicting values for {c.ref.name}")
                seen_equal[key] = c.value
        for ref in [*refs_of(q.where), *[r for r, _ in q.order], *[i.what for i in q.items if isinstance(i.what, Ref)]]:
            if ref.alias not in out:
                raise BindingProblem(f"{ref.alias} is not known")
            if out[ref.alias].kind == "path":
                raise BindingProblem("a path has no fields")
        for i in q.items:
            name = i.what if isinstance(i.what, str) else i.what.arg if isinstance(i.what, Aggregate) else None
            name = name.alias if isinstance(name, Ref) else name
            if name is not None and name not in out:
                raise BindingProblem(f"{name} is not known")
        names = [i.output for i in q.items]
        if len(set(names)) != len(names):
            raise BindingProblem("two outputs have the same name")
        if self.schema is not None and self.schema.mode != "permissive":
            self._against_schema(q, out)
        return out

    def _against_schema(self, q: Query, al: dict[str, _Alias]) -> None:
        """Labels, fields and ends that the schema document doesn't have."""
        found, doc = [], self.schema

        def types(kinds, names):
            return [t for t in kinds if set(names) & {t.name, *t.labels}]

        def fields_known(ts, refs):
            for name, ns in refs:
                if ts and name not in (*PSEUDO_NODE, *PSEUDO_EDGE) and not any(f.name == name for t in ts for f in getattr(t, ns)):
                    found.append(f"{ts[0].name} has no field {ns}.{name}")

        used: dict[str, list] = {a: [] for a in al}
        for r in [*refs_of(q.where), *[r for r, _ in q.order], *[i.what for i in q.items if isinstance(i.what, Ref)], *[i.what.arg for i in q.items if isinstance(i.what, Aggregate) and isinstance(i.what.arg, Ref)]]:
            used[r.alias].append((r.field, r.namespace))
        nodes = {}
        for p in q.patterns():
            nodes[p.alias] = types(doc.nodes, p.labels)
            found += [f"label {x} is not in the schema" for x in p.labels if not types(doc.nodes, [x])]
            fields_known(nodes[p.alias], [*used[p.alias], *[(k, "properties") for k in p.props]])
        for near, s in zip(q.patterns(), q.steps):
            es = types(doc.edges, s.labels)
            found += [f"edge label {x} is not in the schema" for x in s.labels if not types(doc.edges, [x])]
            fields_known(es, [*used[s.alias], *[(k, "properties") for k in s.props]])
            ways = {"out": [(near, s.target)], "in": [(s.target, near)], "both": [(near, s.target), (s.target, near)]}[s.direction]
            ends = [(nodes[a.alias], nodes[b.alias]) for a, b in ways]
            fits = lambda names, ts: not names or any(set(names) & {t.name, *t.labels} for t in ts)
            if es and all(a and b for a, b in ends) and not s.quantified and not any(fits(e.source, a) and fits(e.target, b) for e in es for a, b in ends):
                found.append(f"{s.labels[0]} doesn't join these labels")
        if found and doc.mode == "strict":
            raise SchemaProblem("; ".join(found))
        self.warnings += found

    def _infer(self, q: Query, al: dict[str, _Alias]) -> None:
        """Labels of unlabelled nodes, where an edge's ends leave one choice."""
        ps = q.patterns()
        for _ in range(2):
            for a, s, b in zip(ps, q.steps, ps[1:]):
                if s.quantified or s.max_depth > 1 or s.min_depth == 0:  # several steps may end anywhere
                    continue
                for x, y, ends in ((a, b, 0), (b, a, 1)):
                    if al[x.alias].label is None:
                        got = set()
                        for part, rev in self._sides(s):
                            own, other = (part.source, part.target) if (ends == 0) != rev else (part.target, part.source)
                            if al[y.alias].label in (None, other):
                                got.add(own)
                        if len(got) == 1:
                            al[x.alias].label = got.pop()

    def _sides(self, s: Step) -> list[tuple[EdgePart, bool]]:
        parts = self.graph.parts(s.labels[0])
        return [(p, False) for p in parts if s.direction in ("out", "both")] + [(p, True) for p in parts if s.direction in ("in", "both")]

    # scans -----------------------------------------------------------------------------
    def table(self, label: str | None) -> NodeTable:
        if label is not None:
            return self.graph.node(label)
        # no label: every label's nodes under their whole-graph id
        frames = []
        for t in self.graph.nodes.values():
            keep = [c for c, k in t.df.dtypes if not k.startswith(("array", "struct", "map"))]
            frames.append(t.df.select(node_id(t.label, F.col(t.key)).alias("__id"), *[F.col(c).cast("string") if c == t.key else F.col(c) for c in keep]))
        return NodeTable("", reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), "__id")

    def field(self, t: NodeTable, name: str, namespace: str = "properties") -> tuple[Column, str]:
        """A node field and its type; unknown fields are missing everywhere."""
        types = t.columns()
        if name == "node_id":
            return (F.col(t.key) if not t.label else node_id(t.label, F.col(t.key))), "string"
        if name == "content" or (namespace == "payload" and name == "text" and "text" not in types):
            if t.content:
                return F.col(t.content), types[t.content]
            return F.lit(None).cast("string"), "string"
        if name in types:
            return F.col(f"`{name}`"), types[name]
        want = " ".join(name.split()).lower()
        for c in types:
            if " ".join(c.split()).lower() == want:
                return F.col(f"`{c}`"), types[c]
        if self.strict_schema:
            raise SchemaProblem(f"{t.label} has no field {name}")
        return F.lit(None).cast("string"), "string"

    def scan(self, p: NodePattern, al: _Alias, need: list[tuple[str, str]], where: Predicate | None = None) -> DataFrame:
        """alias__k and the needed fields of a pattern's nodes that pass its own filters."""
        t = self.table(al.label)
        df = t.df
        for other in p.labels[1:]:
            if t.labels:
                df = df.filter(F.array_contains(t.labels, other))
            else:
                o = self.graph.node(other)
                df = df.join(o.df.select(F.col(o.key).alias("__other")), F.col(t.key) == F.col("__other"), "left_semi")
        if p.ids is not None:
            own = [i.split(":", 1)[1] for i in p.ids if i.split(":", 1)[0] == t.label] if t.label else p.ids
            kind = t.columns()[t.key]
            df = df.filter(F.col(t.key).isin([int(x) for x in own if x.lstrip("-").isdigit()] if kind in V.INTEGER else own))
        for k, v in p.props.items():
            c, kind = self.field(t, k)
            df = df.filter(V.compare(c, kind, "=", v) if v is not None else c.isNull())
        if where is not None:
            df = df.filter(self.predicate(where, lambda r: self.field(t, r.field, r.namespace)))
        cols = [F.col(t.key).alias(f"{p.alias}__k")]
        for name, ns in need:
            c, kind = self.field(t, name, ns)
            al.types[f"{ns}.{name}"] = kind
            cols.append(c.alias(f"{p.alias}__{ns}.{name}"))
        return df.select(*cols)

    # predicates ------------------------------------------------------------------------
    def predicate(self, p: Predicate, resolve) -> Column:
        if isinstance(p, (And, Or)):
            cols = [self.predicate(i, resolve) for i in p.items]
            return reduce((lambda a, b: a & b) if isinstance(p, And) else (lambda a, b: a | b), cols)
        if isinstance(p, HasTag):
            c, kind = resolve(Ref(p.alias, "tags"))
            return V.has_tag(c, p.tag) if kind == "array<string>" else F.lit(False)
        if isinstance(p, Similar):
            raise Unsupported("a likeness search stands alone or under AND, once")
        c, kind = resolve(p.ref)
        if isinstance(p, Compare):
            return V.compare(c, kind, p.op, p.value)
        if isinstance(p, IsNull):
            return c.isNotNull() if p.negate else c.isNull()
        if isinstance(p, Exists):
            return c.isNotNull()
        if isinstance(p, Text):
            return V.text_test(c, kind, p.op, p.value)
        raise Unsupported(type(p).__name__)

    # matching --------------------------------------------------------------------------
    def match(self, q: Query, al: dict[str, _Alias], extra: list[Ref] = ()) -> DataFrame:
        need: dict[str, list[tuple[str, str]]] = {a: [] for a in al}

        def want(ref: Ref):
            pair = (ref.field, ref.namespace)
            if pair not in need[ref.alias]:
                need[ref.alias].append(pair)

        parts = conjuncts(q.where)
        similar = [p for p in parts if isinstance(p, Similar)]
        if len(similar) > 1 or any(isinstance(p, Or) and _has_similar(p) for p in parts):
            raise Unsupported("a likeness search stands alone or under AND, once")
        own: dict[str, list[Predicate]] = {}
        rest = []
        for p in parts:
            if isinstance(p, Similar):
                continue
            names = {r.alias for r in refs_of(p)}
            if len(names) == 1 and al[next(iter(names))].kind == "node":
                own.setdefault(names.pop(), []).append(p)
            else:
                rest.append(p)
                for r in refs_of(p):
                    want(r)
        for r in [*extra, *[r for r, _ in q.order]]:
            want(r)
        for i in q.items:
            if isinstance(i.what, Ref):
                want(i.what)
            elif isinstance(i.what, Aggregate) and isinstance(i.what.arg, Ref):
                want(i.what.arg)
            elif isinstance(i.what, str) and al[i.what].kind == "node":
                for c in self.table(al[i.what].label).columns():
                    want(Ref(i.what, c))
            elif isinstance(i.what, str) and al[i.what].kind == "edge":
                for c in [*PSEUDO_EDGE, *self.edge_columns(al[i.what].label)]:
                    want(Ref(i.what, c))

        track = bool(q.path) or q.graph or any(s.quantified or s.max_depth > 1 for s in q.steps)
        carried = {} if track or q.mode == "edges" else self._carried(q, al, need)
        start = q.start
        df = self.scan(start, al[start.alias], need[start.alias], all_of(own.get(start.alias, [])))
        if similar:
            s = similar[0]
            if self.vectors is None:
                raise AccessPathMissing("no vector index is declared", "give Compiler vectors")
            if s.alias != start.alias:
                raise Unsupported("a likeness search stands on the first node")
            label = al[start.alias].label
            there = self.table(label).df.select(self.field(self.table(label), "node_id")[0].alias("__there"))
            near = self.vectors(s.query, s.top).join(there, F.col("node_id") == F.col("__there"), "left")
            near = near.filter(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("candidate "), "node_id", F.lit(" is gone")))).otherwise(F.lit(True)))
            near = near.select(F.col("node_id").alias("__near"), F.col("rank").alias(f"{s.alias}__rank"), F.col("score").alias(f"{s.alias}__score"))
            df = df.join(near, node_id(al[start.alias].label, col(start.alias, "k")) == F.col("__near")).drop("__near")
        previous, done = start, []
        if track:
            df = df.withColumn("__nodes", F.array(self._gid(al, start.alias))).withColumn("__edges", F.array().cast("array<string>"))
        for s in q.steps:
            done.append(previous.alias)
            where = all_of(own.get(s.target.alias, []))
            if s.quantified or s.max_depth > 1 or s.min_depth == 0:
                df = self.walk(df, previous, s, al, need, where, q, done)
            else:
                df = self.hop(df, previous, s, al, need, where, q, done, track, carried.get(s.alias))
            previous = s.target
        if rest:
            df = df.filter(self.predicate(all_of(rest), lambda r: self.resolve(al, r)))
        return df

    def _carried(self, q: Query, al, need) -> dict[str, str]:
        """Steps whose edge is a foreign key in the near node's own row: edge alias to the
        key's column, which then comes along with the near node and needs no join."""
        out = {}
        for near, s in zip(q.patterns(), q.steps):
            sides = [(p, r) for p, r in self._sides(s) if al[near.alias].label == (p.target if r else p.source) and al[s.target.alias].label == (p.source if r else p.target)]
            if len(sides) != 1 or s.props or need[s.alias] or al[near.alias].label is None:
                continue
            part, rev = sides[0]
            t = self.table(al[near.alias].label)
            own, far = (part.dst, part.src) if rev else (part.src, part.dst)
            if part.held_by == ("dst" if rev else "src") and t.df is part.df and own == t.key:
                need[near.alias].append((far, "__fk"))
                out[s.alias] = far
        return out

    def _gid(self, al, alias) -> Column:
        label = al[alias].label
        return col(alias, "k") if label is None else node_id(label, col(alias, "k"))

    def resolve(self, al: dict[str, _Alias], r: Ref) -> tuple[Column, str]:
        return F.col(f"`{r.alias}__{r.namespace}.{r.field}`"), al[r.alias].types.get(f"{r.namespace}.{r.field}", "string")

    def _edge_rows(self, s: Step, part: EdgePart, rev: bool, need, al: _Alias, own: str, other: str, only_loops_once: bool) -> DataFrame:
        """__own, __other (keys) and the needed fields of one edge part, its filters applied."""
        df = part.df
        types = dict(df.dtypes)
        for k, v in s.props.items():
            if k not in types:
                return df.select(F.col(part.src).alias("__own"), F.col(part.dst).alias("__other")).limit(0)
            df = df.filter(V.compare(F.col(k), types[k], "=", v))
        if rev and only_loops_once and part.source == part.target:
            df = df.filter(F.col(part.src) != F.col(part.dst))
        a, b = (part.dst, part.src) if rev else (part.src, part.dst)
        cols = [F.col(a).alias("__own"), F.col(b).alias("__other"), part.id_column().alias(f"{s.alias}__id")]
        for name, ns in need:
            if name == "edge_id":
                c, kind = part.id_column(), "string"
            elif name == "label":
                c, kind = F.lit(part.label), "string"
            elif name in ("from_node_id", "to_node_id"):
                c, kind = (node_id(part.source, F.col(part.src)) if name == "from_node_id" else node_id(part.target, F.col(part.dst))), "string"
            elif name in types:
                c, kind = F.col(f"`{name}`"), types[name]
            else:
                c, kind = F.lit(None).cast("string"), "string"
            al.types[f"{ns}.{name}"] = kind
            cols.append(c.alias(f"{s.alias}__{ns}.{name}"))
        return df.select(*cols).filter(F.col("__own").isNotNull() & F.col("__other").isNotNull())

    def hop(self, df, previous, s: Step, al, need, where, q, done, track, carried=None) -> DataFrame:
        """One edge: rows join the edge on the near key, then the far nodes on theirs."""
        out = []
        for part, rev in self._sides(s):
            near, far = (part.target, part.source) if rev else (part.source, part.target)
            if al[previous.alias].label not in (None, near) or al[s.target.alias].label not in (None, far):
                continue
            own_al, far_al = al[s.alias], al[s.target.alias]
            label = far_al.label
            e = self._edge_rows(s, part, rev, need[s.alias], own_al, near, far, s.direction == "both")
            held = "dst" if not rev else "src"
            filters = s.target.props or s.target.ids is not None or where is not None or len(s.target.labels) > 1
            key = col(previous.alias, "k") if al[previous.alias].label else col(previous.alias, "k")
            own = F.col("__own") if al[previous.alias].label else node_id(near, F.col("__own"))
            t = self.table(far if label is not None else None)
            far_key = F.col("__other") if label is not None else node_id(far, F.col("__other"))
            if carried is not None:
                nodes = self.scan(s.target, _Alias("node", far, far_al.types), need[s.target.alias], where)
                fk = f"{previous.alias}__" + f"__fk.{carried}"
                got = df.join(nodes, F.col(f"`{fk}`") == far_key_of(s.target.alias)).drop(fk)
            elif not filters and not need[s.target.alias] and (self.graph.trusted or part.held_by == held):
                got = df.join(e, key == own).withColumn(f"{s.target.alias}__k", far_key).drop("__own", "__other")
            elif part.held_by == held and t.df is part.df and not s.props:
                # the far node's own row has the edge: one join
                nodes = self.scan(s.target, _Alias("node", far, far_al.types), [*need[s.target.alias], (part.dst if rev else part.src, "__fk")], where)
                own_key = F.col(f"`{s.target.alias}__" + f"__fk.{part.dst if rev else part.src}`")
                got = df.join(nodes, key == (own_key if al[previous.alias].label else node_id(near, own_key))).drop(f"{s.target.alias}__" + f"__fk.{part.dst if rev else part.src}")
                if need[s.alias] or track or q.mode == "edges":
                    got = got.join(e.select(F.col("__other").alias("__held"), *[c for c in e.columns if c not in ("__own", "__other")]), far_key_of(s.target.alias) == F.col("__held")).drop("__held")
            else:
                nodes = self.scan(s.target, _Alias("node", far if label is not None else None, far_al.types), need[s.target.alias], where)
                got = df.join(e, key == own).drop("__own")
                got = got.join(nodes, far_key == far_key_of(s.target.alias)).drop("__other")
            same = [d for d in done if q.mode == "walk" and (al[d].label in (None, far) or label is None)]
            for d in same:
                got = got.filter(self._gid(al, d) != self._gid(al, s.target.alias)) if None in (al[d].label, label) else got.filter(col(d, "k") != col(s.target.alias, "k"))
            if track:
                here = self._gid(al, s.target.alias) if label is not None else col(s.target.alias, "k")
                if q.mode == "walk" and q.path:
                    got = got.filter(~F.array_contains("__nodes", here))
                got = got.withColumn("__nodes", F.concat("__nodes", F.array(here))).withColumn("__edges", F.concat("__edges", F.array(F.col(f"`{s.alias}__id`"))))
            drop = [f"{s.alias}__id"] if f"{s.alias}__id" in got.columns else []
            out.append(got.drop(*drop))
        if not out:
            raise BindingProblem(f"no {s.labels[0]} edge joins these labels")
        return reduce(lambda a, b: a.unionByName(b), out)

    def walk(self, df, previous, s: Step, al, need, where, q, done) -> DataFrame:
        """Depths of a bounded walk: unrolled joins, visited ids in an array; the target's label
        and filters are met where a depth ends. Where the edges stay within one label the
        joins are on its native keys, else on whole-graph ids."""
        label = al[previous.alias].label
        native = label is not None and not q.path and al[s.target.alias].label == label and all(p.source == p.target == label for p, _ in self._sides(s))
        whole = lambda x: node_id(label, x) if native else x
        edges = []
        for part, rev in self._sides(s):
            e = self._edge_rows(s, part, rev, [], _Alias("edge"), part.source, part.target, s.direction == "both")
            a, b = (part.target, part.source) if rev else (part.source, part.target)
            own, other = (F.col("__own"), F.col("__other")) if native else (node_id(a, F.col("__own")), node_id(b, F.col("__other")))
            edges.append(e.select(own.alias("__a"), other.alias("__b"), F.col(f"`{s.alias}__id`").alias("__e")))
        e = reduce(lambda a, b: a.unionByName(b), edges)
        carried = df.columns
        seen = F.col("__nodes") if q.path else F.array(*([col(d, "k") for d in done if al[d].label == label] if native else [self._gid(al, d) for d in done]))
        at = df.withColumn("__at", col(previous.alias, "k") if native else self._gid(al, previous.alias)).withColumn("__seen", seen)
        found = []
        for depth in range(1, s.max_depth + 1):
            at = at.join(e, F.col("__at") == F.col("__a")).drop("__a")
            if q.mode == "walk":
                at = at.filter(~F.array_contains("__seen", F.col("__b")))
            at = at.withColumn("__seen", F.concat("__seen", F.array("__b"))).withColumn("__at", F.col("__b"))
            at = at.withColumn("__nodes", F.concat("__nodes", F.array(whole(F.col("__b"))))).withColumn("__edges", F.concat("__edges", F.array("__e"))).drop("__b", "__e")
            if depth >= max(1, s.min_depth):
                found.append(at)
        rows = reduce(lambda a, b: a.unionByName(b), found)
        target = al[s.target.alias]
        nodes = self.scan(s.target, target, need[s.target.alias], where)
        gid = self._gid(al, s.target.alias)
        plain = target.label is not None and not (s.target.props or s.target.ids is not None or where is not None or len(s.target.labels) > 1 or need[s.target.alias])
        if native:
            rows = rows.withColumn(f"{s.target.alias}__k", F.col("__at")) if plain and self.graph.trusted else rows.join(nodes, F.col("__at") == far_key_of(s.target.alias))
        elif plain and self.graph.trusted:
            kind = self.table(target.label).columns()[self.table(target.label).key]
            rows = rows.filter(F.startswith("__at", F.lit(f"{target.label}:"))).withColumn(f"{s.target.alias}__k", F.substring(F.col("__at"), len(target.label) + 2, 1 << 30).cast(kind))
        else:
            rows = rows.join(nodes.withColumn("__gid", gid), F.col("__at") == F.col("__gid")).drop("__gid")
        return rows.select(*[f"`{c}`" for c in carried], *[f"`{c}`" for c in rows.columns if c.startswith(f"{s.target.alias}__")])

    # shaping ---------------------------------------------------------------------------
    def run(self, q: Query) -> Result:
        al = self.bind(q)
        if q.mode == "collect":
            return Result(self.collect(q, al))
        if q.graph and q.order and len(q.steps) == 1 and not q.path:
            return self.subtrees(q, al)
        if self.strict_order and q.order and (len(q.order) > 1 or q.order[0][0].alias != q.start.alias or not self._index(al[q.start.alias].label, q.order[0][0].field)):
            raise AccessPathMissing(f"no ordered index serves {q.order[0][0].name}", f"declare an ordered index on {q.order[0][0].field}")
        df = self.match(q, al)
        keys = [f"`{p.alias}__k`" for p in q.patterns()]
        if self.index_semantics and len(q.order) == 1 and q.order[0][0].alias == q.start.alias and self._index(al[q.start.alias].label, q.order[0][0].field):
            df = df.filter(self.resolve(al, q.order[0][0])[0].isNotNull())
        out = Result(self.shape(q, al, df, keys), explain=self.explain(q, al))
        if q.graph:
            page = df if q.offset is None and q.limit is None and not q.order else self._page(q, al, df, keys)
            out.nodes = page.select(F.explode("__nodes").alias("node_id")).distinct()
            out.edges = page.select(F.explode("__edges").alias("edge_id")).distinct()
        return out

    def _index(self, label, name):
        return next((i for i in self.graph.indexes if i.target == "node" and i.label == label and i.field == name and i.ordered), None)

    def _page(self, q, al, df, keys) -> DataFrame:
        df = df.orderBy(*self._order(q, al, keys))
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df

    def _order(self, q, al, keys) -> list[Column]:
        out = []
        for r, down in q.order:
            c, kind = self.resolve(al, r)
            out.append(V.order_keys(c, kind, down))
        desc = self.index_semantics and len(q.order) == 1 and q.order[0][1]
        return [*out, *[F.col(k).desc() if desc else F.col(k) for k in keys]]

    def output(self, al, item: Item) -> Column:
        w = item.what
        if isinstance(w, Ref):
            return self.resolve(al, w)[0]
        if al[w].kind == "path":
            return F.struct(F.col("__nodes").alias("nodes"), F.col("__edges").alias("edges"))
        if al[w].kind == "node":
            t = self.table(al[w].label)
            return F.struct(self._gid(al, w).alias("node_id"), *[F.col(f"`{w}__properties.{c}`").alias(c) for c in t.columns() if c != "__id"])
        return F.struct(*[F.col(f"`{w}__properties.{c}`").alias(c) for c in [*PSEUDO_EDGE, *self.edge_columns(al[w].label)]])

    def edge_columns(self, label: str) -> list[str]:
        """The property columns of a label's edges."""
        every = [c for p in self.graph.parts(label) for c in (p.props or [c for c in p.df.columns if c not in (p.src, p.dst)])]
        return [c for c in dict.fromkeys(every) if c not in PSEUDO_EDGE]

    def shape(self, q: Query, al, df: DataFrame, keys: list[str]) -> DataFrame:
        if any(isinstance(i.what, Aggregate) for i in q.items):
            out = self.grouped(q, al, df, keys)
        elif q.distinct:
            out = self.distinct(q, al, df, keys)
        else:
            items = [self.output(al, i).alias(i.output) for i in q.items]
            if q.order or q.offset is not None or q.limit is not None:
                return self._page(q, al, df, keys).select(*items)
            return df.select(*items)
        names = [i.output for i in q.items]
        marks = [c for c in out.columns if c.startswith("__o")]
        if q.order:
            out = out.orderBy(*[F.col(c).desc_nulls_last() if c.endswith("d") else F.col(c).asc_nulls_first() for c in marks], *[f"`{n}`" for n in names if not isinstance(dict(zip(names, q.items))[n].what, str)])
        elif q.offset is not None or q.limit is not None:
            out = out.orderBy(*[f"`{n}`" for n in names])
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.select(*[f"`{n}`" for n in names])

    def _marks(self, q, al) -> list[tuple[str, Column]]:
        """Sort keys as plain columns: (name ending in a or d, column)."""
        out = []
        for n, (r, down) in enumerate(q.order):
            c, kind = self.resolve(al, r)
            if kind == "string":
                out.append((f"__o{n}{'d' if down else 'a'}", F.coalesce(c, F.lit(V.MISSING))))
            elif kind == "boolean":
                out.append((f"__o{n}{'d' if down else 'a'}", c))
            else:  # missing after numbers
                out += [(f"__o{n}0{'d' if down else 'a'}", c.isNull()), (f"__o{n}1{'d' if down else 'a'}", c)]
        return out

    def distinct(self, q, al, df, keys) -> DataFrame:
        """Rows distinct over the output; of equal rows the first (by start ids) lends its
        unprojected sort fields."""
        items = [self.output(al, i).alias(i.output) for i in q.items]
        names = [i.output for i in q.items]
        marks = [(n, c) for n, c in self._marks(q, al)]
        if not marks:
            return df.select(*items).dropDuplicates(names)
        rows = df.select(*items, F.struct(*[F.col(k) for k in keys]).alias("__first"), F.struct(*[c.alias(n) for n, c in marks]).alias("__m"))
        one = rows.groupBy(*[f"`{n}`" for n in names]).agg(F.min_by("__m", "__first").alias("__m"))
        return one.select(*[f"`{n}`" for n in names], *[F.col(f"__m.{n}").alias(n) for n, _ in marks])

    def grouped(self, q, al, df, keys) -> DataFrame:
        by, aggs = [], []
        for i in q.items:
            w = i.what
            if not isinstance(w, Aggregate):
                by.append(self.output(al, i).alias(i.output))
                continue
            if w.arg is None:
                c = F.count(F.lit(1))
            elif isinstance(w.arg, str):
                c = F.count(F.lit(1)) if al[w.arg].kind != "node" else F.count(col(w.arg, "k"))
            else:
                v, kind = self.resolve(al, w.arg)
                if w.fn in ("sum", "avg") and not V.is_number(kind) and self._known(al, w.arg):
                    raise BindingProblem(f"{w.fn} needs numbers, {w.arg.name} is {kind}")
                c = {
                    "count": lambda: F.count(v),
                    "sum": lambda: F.coalesce(F.sum(v.cast("double")), F.lit(0.0)),
                    "avg": lambda: F.avg(v.cast("double")),
                    "min": lambda: F.min(v),
                    "max": lambda: F.max(v),
                }[w.fn]()
            aggs.append(c.alias(i.output))
        # a group sorts by its first row's fields
        first = F.struct(*[F.col(k) for k in keys])
        marks = self._marks(q, al)
        aggs += [F.min_by(c, first).alias(n) for n, c in marks]
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)

    def _known(self, al, ref: Ref) -> bool:
        """Whether a field is a column: what isn't is missing everywhere, not of a wrong type."""
        if al[ref.alias].kind == "edge":
            return ref.field in [*PSEUDO_EDGE, *self.edge_columns(al[ref.alias].label)]
        t = self.table(al[ref.alias].label)
        want = " ".join(ref.field.split()).lower()
        return any(" ".join(c.split()).lower() == want for c in t.columns()) or ref.field in PSEUDO_NODE

    def _by_alias(self, q: Query) -> dict[str, Predicate | None]:
        """The filter of each node, where every predicate speaks of one alias."""
        own: dict[str, list[Predicate]] = {}
        for p in conjuncts(q.where):
            names = {p.alias} if isinstance(p, Similar) else {r.alias for r in refs_of(p)}
            if len(names) != 1:
                raise Unsupported("a predicate over several aliases has no place where targets are gathered")
            own.setdefault(names.pop(), []).append(p)
        return {a: all_of(ps) for a, ps in own.items()}

    def subtrees(self, q: Query, al) -> Result:
        """RETURN GRAPH in an order over one segment: a row for each ordered root, with its
        tree as ``graph``: members (depth, ord, node, parent), by depth, order and id. Only
        children by outgoing ``contains`` have a parent; else all members are flat."""
        s, own = q.steps[0], self._by_alias(q)
        start = q.start.alias
        if any(r.alias != start for r, _ in q.order):
            raise Unsupported("trees are ordered by fields of their roots")
        one = Query(q.start, where=own.get(start), items=[Item(start)], order=q.order, offset=q.offset, limit=q.limit)
        df = self.match(one, {start: al[start]})
        keys = [f"`{start}__k`"]
        ordered = self._page(one, al, df, keys)
        roots = ordered.select(self._gid(al, start).alias("root"))
        e = hierarchy.edge_frame(self.graph, s.labels[0], filters=lambda p: [V.compare(F.col(k), dict(p.df.dtypes).get(k, "string"), "=", v) if k in p.df.columns else F.lit(False) for k, v in s.props.items()])
        if s.direction == "both":
            e = e.unionByName(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "ord"))
        flat = hierarchy.subtree(roots, e, s.min_depth, s.max_depth, "in" if s.direction == "in" else "out")
        t = s.target
        if al[t.alias].label or t.props or t.labels or own.get(t.alias) is not None:
            hit = self.scan(t, al[t.alias], [], own.get(t.alias)).select(self._gid(al, t.alias).alias("node"))
            flat = flat.filter("depth = 0").unionByName(flat.filter("depth > 0").join(hit, "node", "left_semi").select(*flat.columns))
        shaped = flat if s.direction == "out" and s.labels[0] == "contains" else flat.withColumn("parent", F.lit(None).cast("string"))
        rows = ordered.select("*", self._gid(al, start).alias("__root")).join(hierarchy.trees(shaped), F.col("__root") == F.col("root"), "left")
        empty = F.array().cast(shaped.select(F.array(F.struct("depth", F.coalesce("ord", F.lit(0.0)).alias("ord"), "node", "parent")).alias("m")).schema["m"].dataType)
        rows = rows.orderBy(*self._order(one, al, keys)).select(self.output(al, Item(start)).alias(start), F.coalesce("members", empty).alias("graph"))
        return Result(rows, flat.select(F.col("node").alias("node_id")).distinct(), flat.filter("edge_id IS NOT NULL").select("edge_id").distinct(), self.explain(q, al))

    def collect(self, q: Query, al) -> DataFrame:
        """One row per root: each step's targets gathered, as far as they pass their filters;
        roots without any stay."""
        own = self._by_alias(q)
        root = self.match(Query(q.start, where=own.get(q.start.alias), items=[], order=[]), {q.start.alias: al[q.start.alias]}, [i.what for i in q.items if isinstance(i.what, Ref) and i.what.alias == q.start.alias])
        rows, reach = root, root.select(col(q.start.alias, "k").alias("__root"), self._gid(al, q.start.alias).alias("__at"))
        for s in q.steps:
            edges = []
            for part, rev in self._sides(s):
                e = self._edge_rows(s, part, rev, [], _Alias("edge"), part.source, part.target, s.direction == "both")
                a, b = (part.target, part.source) if rev else (part.source, part.target)
                edges.append(e.select(node_id(a, F.col("__own")).alias("__a"), node_id(b, F.col("__other")).alias("__b")))
            e = reduce(lambda a, b: a.unionByName(b), edges)
            at, found = reach.withColumn("__seen", F.array("__at")), []
            for depth in range(1, s.max_depth + 1):
                at = at.join(e, F.col("__at") == F.col("__a")).filter(~F.array_contains("__seen", F.col("__b")))
                at = at.select("__root", F.col("__b").alias("__at"), F.concat("__seen", F.array("__b")).alias("__seen"))
                if depth >= max(1, s.min_depth):
                    found.append(at)
            got = reduce(lambda a, b: a.unionByName(b), found).select("__root", "__at").distinct()
            t = self.scan(s.target, al[s.target.alias], [], own.get(s.target.alias))
            reach = got.join(t.select(self._gid(al, s.target.alias).alias("__gid")), F.col("__at") == F.col("__gid"), "left_semi")
            lists = reach.groupBy("__root").agg(F.sort_array(F.collect_list("__at")).alias(f"{s.target.alias}__targets"))
            rows = rows.join(lists, col(q.start.alias, "k") == F.col("__root"), "left").drop("__root")
            rows = rows.withColumn(f"{s.target.alias}__targets", F.coalesce(f"{s.target.alias}__targets", F.array().cast("array<string>")))
        cols = [self.resolve(al, i.what)[0].alias(i.output) for i in q.items if isinstance(i.what, Ref)] or [self._gid(al, q.start.alias).alias(q.start.alias)]
        return rows.select(*cols, *[F.col(f"{s.target.alias}__targets").alias(s.target.alias) for s in q.steps])

    # explain ---------------------------------------------------------------------------
    def explain(self, q: Query, al) -> dict:
        """The plan in words: access, pushed and residual predicates, limits."""
        start = q.start.alias
        pushed = [p for p in conjuncts(q.where) if {r.alias for r in refs_of(p)} <= {start}]
        kinds = [type(p).__name__ for p in conjuncts(q.where)]
        if q.path or any(s.quantified for s in q.steps):
            access = "path_expand"
        elif q.start.ids is not None:
            access = "adjacency" if q.steps else "id_lookup"
        elif "Similar" in kinds:
            access = "semantic_candidates"
        elif q.start.props or any(isinstance(p, Compare) and p.op == "=" for p in pushed):
            access = "equality_scan"
        elif "HasTag" in kinds:
            access = "tag_scan"
        elif pushed:
            access = "predicate_scan"
        elif q.order:
            access = "ordered_scan"
        else:
            access = "label_scan" if al[start].label else "full_scan"
        return {
            "access": access,
            "start": {"alias": start, "label": al[start].label},
            "steps": [{"label": s.labels[0], "direction": s.direction, "depth": [s.min_depth, s.max_depth]} for s in q.steps],
            "pushed": [repr(p) for p in pushed],
            "residual": [repr(p) for p in conjuncts(q.where) if p not in pushed],
            "indexes": [i.name for i in self.graph.indexes if i.label == al[start].label and i.field in {r.field for p in pushed for r in refs_of(p)} | {r.field for r, _ in q.order}],
            "distinct": q.distinct,
            "order": [(r.name, "desc" if d else "asc") for r, d in q.order],
            "offset": q.offset,
            "limit": q.limit,
        }


def far_key_of(alias: str) -> Column:
    return col(alias, "k")


def _has_similar(p) -> bool:
    return isinstance(p, Similar) or (isinstance(p, (And, Or)) and any(_has_similar(i) for i in p.items))
