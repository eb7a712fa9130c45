"""Violations of a schema as rows (type, id, field, rule); each rule is an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import Document, EdgeType, FieldSpec, NodeType

_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _mistyped(c: Column, f: FieldSpec, kind: str) -> Column | None:
    if f.repeated:
        if not kind.startswith("array"):
            return F.lit(True)
        inner = kind[6:-1]
        bad = _mistyped(F.col("x"), FieldSpec(f.name, f.kind, values=f.values), inner)
        return None if bad is None else F.exists(c, lambda x: _mistyped(x, FieldSpec(f.name, f.kind, values=f.values), inner))
    text, whole = kind == "string", kind in ("tinyint", "smallint", "int", "bigint")
    number = whole or kind in ("float", "double") or kind.startswith("decimal")
    if f.kind == "date":
        return ~F.rlike(c, F.lit(_DAY)) if text else (None if kind == "date" else F.lit(True))
    if f.kind == "enum":
        return ~c.isin(f.values) if text else F.lit(True)
    if f.kind == "int" and number and not whole:
        return c != F.floor(c)
    fits = {"string": text, "datetime": text or kind.startswith("timestamp"), "int": whole, "float": number, "bool": kind == "boolean", "json": True}
    return None if fits.get(f.kind, kind.startswith(("struct", "map", "variant"))) else F.lit(True)


def of_fields(df: DataFrame, t: NodeType, key: str, mode: str = "strict") -> DataFrame:
    """Missing, mistyped and unknown fields of a type's rows, in one pass."""
    types = dict(df.dtypes)
    rules = []
    add = lambda cond, name, rule: rules.append(F.when(cond, F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"))))
    for f in t.properties:
        if f.name not in types:
            if f.required:
                add(F.lit(True), f.name, "missing")
            continue
        c = F.col(f"`{f.name}`")
        if f.required:
            add(c.isNull(), f.name, "missing")
        bad = _mistyped(c, f, types[f.name])
        if bad is not None:
            add(c.isNotNull() & bad, f.name, "mistyped")
    known = {f.name for f in t.properties} | {key, "labels", "record_type"}
    for name in types:
        if name not in known:
            add(F.col(f"`{name}`").isNotNull(), name, "unknown")
    found = F.array_compact(F.array(*rules)) if rules and mode != "permissive" else F.array().cast("array<struct<field:string,rule:string>>")
    return df.select(F.lit(t.name).alias("type"), F.col(key).cast("string").alias("id"), F.explode(found).alias("v")).select("type", "id", "v.field", "v.rule")


def of_labels(nodes: DataFrame, doc: Document, key: str = "id", labels: str = "labels") -> DataFrame:
    """Nodes with labels that no type has."""
    known = sorted({x for t in doc.nodes for x in t.labels})
    odd = F.array_except(labels, F.array(*[F.lit(x) for x in known]).cast("array<string>"))
    return nodes.select(F.lit(None).cast("string").alias("type"), F.col(key).cast("string").alias("id"), F.explode(odd).alias("field")).withColumn("rule", F.lit("unknown label"))


def of_ends(edges: DataFrame, ends: DataFrame, t: EdgeType, key: str = "edge_id") -> DataFrame:
    """Edges (edge_id, src, dst) whose ends (id, label) a type doesn't allow, or that don't
    exist."""
    out = None
    for side, allowed, rule in (("src", t.source, "from"), ("dst", t.target, "to")):
        e = edges.join(ends.select(F.col("id").alias(side), F.col("label").alias("__l")), side, "left")
        bad = e.filter(F.col("__l").isNull() | ~F.col("__l").isin(allowed)) if allowed else e.filter(F.col("__l").isNull())
        bad = bad.select(F.lit(t.name).alias("type"), F.col(key).cast("string").alias("id"), F.lit(side).alias("field"), F.lit(rule).alias("rule"))
        out = bad if out is None else out.unionByName(bad)
    return out


def of_unique(df: DataFrame, t: NodeType, name: str, key: str) -> DataFrame:
    """Rows that share a value that an index says is unique."""
    again = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")
    hit = df.join(again.select(name, "first"), name).filter(F.col(key) != F.col("first"))
    return hit.select(F.lit(t.name).alias("type"), F.col(key).cast("string").alias("id"), F.lit(name).alias("field"), F.lit("unique").alias("rule"))
