"""Catalogs of tags and properties, finding by them, logs and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def tag_catalog(nodes: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n): nodes per tag, most frequent first."""
    one = nodes.select(F.explode(V.normal_tags(F.col(tags))).alias("tag"))
    return one.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def property_catalog(nodes: DataFrame, skip: list[str] = ()) -> DataFrame:
    """(property, n): nodes that have a property, most frequent first. One pass: a count a
    column, then the counts as rows."""
    cols = [c for c in nodes.columns if c not in skip]
    row = nodes.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").alias("n")) for c in cols])).alias("x")).select("x.property", "x.n").filter("n > 0").orderBy(F.desc("n"), "property")


def find_by_tags(nodes: DataFrame, wanted: list[str], every: bool = False, tags: str = "tags") -> DataFrame:
    return nodes.filter((V.tags_all if every else V.tags_any)(F.col(tags), wanted))


def find_by_property(nodes: DataFrame, name: str, value=None) -> DataFrame:
    """Nodes with a property; with a value, that value."""
    c, kind = F.col(f"`{name}`"), dict(nodes.dtypes)[name]
    return nodes.filter(c.isNotNull() if value is None else V.compare(c, kind, "=", value))


def activity(log: DataFrame, severities=None, categories=None, sources=None, actors=None, since=None, until=None) -> DataFrame:
    """Entries that pass every filter given."""
    for name, wanted in (("severity", severities), ("category", categories), ("source", sources), ("actor", actors)):
        if wanted:
            log = log.filter(F.col(name).isin(list(wanted)))
    if since is not None:
        log = log.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        log = log.filter(F.col("ts") < F.lit(until))
    return log


def activity_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))


def usage(log: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """Sums of amounts per group, for budgets."""
    return log.groupBy(*by).agg(*[F.sum(a).alias(a) for a in amounts], F.count(F.lit(1)).alias("n"))


def index_diff(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(name, change): added, removed or changed between two lists of declared indexes."""
    body = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*body).alias("__a")), new.select(key, F.struct(*body).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def ready_steps(steps: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """Steps of a workflow that are not done and whose needs (step, needs) all are."""
    unmet = needs.join(done.select(F.col("step").alias("needs")), "needs", "left_anti").select("step")
    return steps.join(unmet, "step", "left_anti").join(done, "step", "left_anti")


def per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key: a bounded correlated read."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)


def fan_out(rows: DataFrame, values, name: str = "item") -> DataFrame:
    """One row per item of a list; a scalar gives one, a missing list none."""
    kind = rows.select(values.alias("x")).schema["x"].dataType.simpleString()
    return rows.withColumn(name, F.explode(values)) if kind.startswith("array") else rows.withColumn(name, values).filter(F.col(name).isNotNull())


def shape_problem(col, shape: dict):
    """What keeps a JSON text from a shape (type, and required fields, which are there and
    not null), null where nothing does. A type that isn't known asks for nothing."""
    value = F.try_parse_json(col)
    kind = F.schema_of_variant(value)
    # The types of a shape, as a variant names them.
    starts = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"]}
    found = F.when(value.isNull(), "not JSON")
    if shape.get("type") in starts:
        fits = F.lit(False)
        for s in starts[shape["type"]]:
            fits = fits | F.startswith(kind, F.lit(s))
        found = found.when(~fits, f"not of type {shape['type']}")
    if "required" in shape:
        found = found.when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
    for name in shape.get("required", []):
        there = F.try_variant_get(value, F.lit("$['" + name.replace("'", "\\'") + "']"), "variant")
        found = found.when(there.isNull() | F.is_variant_null(there), f"without {name}")
    return found


def json_path(col, path: str):
    """A dotted path in a JSON column."""
    return F.get_json_object(col, "$." + path)
