"""The change stream: typed changes in order of revision, filtered, replayed, joined.

Every function takes a batch or a streaming DataFrame of change rows (SCHEMA) unless it
says otherwise; the batch forms are the streams' twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "revision bigint, commit_id string, space_id string, domain_id string, committed_at timestamp, type string, node_id string, edge_id string, "
    "labels array<string>, changed_fields array<string>, affected_node_ids array<string>, affected_edge_ids array<string>, origin string"
)
# The kinds of change and other names they go by.
TYPES = ["node.created", "node.updated", "node.deleted", "edge.created", "edge.updated", "edge.deleted", "revision.advanced"]
ALIASES = {"created": "node.created", "updated": "node.updated", "deleted": "node.deleted", "node.create": "node.created", "node.update": "node.updated", "node.delete": "node.deleted", "edge.create": "edge.created", "edge.update": "edge.updated", "edge.delete": "edge.deleted"}
RETAIN_EVENTS, RETAIN_HOURS = 10_000, 24


def source(spark, path: str, **options) -> DataFrame:
    """A stream of change files."""
    return spark.readStream.schema(SCHEMA).options(**options).parquet(path)


def normal_type(col: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = F.lower(F.trim(col))
    return F.coalesce(names[plain], plain)


def normalise(changes: DataFrame) -> DataFrame:
    """Settled type names; affected ids without repeats and with the change's own; created,
    updated and deleted sets."""
    empty = F.array().cast("array<string>")
    kind = normal_type(F.col("type"))
    nodes = F.array_compact(F.array_distinct(F.concat(F.array("node_id"), F.coalesce("affected_node_ids", empty))))
    edges = F.array_compact(F.array_distinct(F.concat(F.array("edge_id"), F.coalesce("affected_edge_ids", empty))))
    out = changes.withColumns({"type": kind, "affected_node_ids": nodes, "affected_edge_ids": edges})
    own = lambda verb: F.when(F.endswith("type", F.lit(verb)), F.array_compact(F.array(F.coalesce("node_id", "edge_id")))).otherwise(empty)
    return out.withColumns({"created": own(".created"), "updated": own(".updated"), "deleted": own(".deleted")})


def matching(changes: DataFrame, spaces=None, domains=None, node_ids=None, edge_ids=None, types=None, labels=None, fields=None) -> DataFrame:
    """Changes that pass every dimension given; within one any value will do."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    overlap = lambda col, xs: F.coalesce(F.arrays_overlap(col, lits(xs)), F.lit(False))
    if spaces:
        changes = changes.filter(F.col("space_id").isin(list(spaces)))
    if domains:
        changes = changes.filter(F.col("domain_id").isin(list(domains)))
    if node_ids:
        changes = changes.filter(F.col("node_id").isin(list(node_ids)) | overlap("affected_node_ids", node_ids))
    if edge_ids:
        changes = changes.filter(F.col("edge_id").isin(list(edge_ids)) | overlap("affected_edge_ids", edge_ids))
    if types:
        changes = changes.filter(F.col("type").isin([ALIASES.get(t, t) for t in types]))
    if labels:
        changes = changes.filter(overlap("labels", labels))
    if fields:
        changes = changes.filter(overlap("changed_fields", fields))
    return changes


def projected(changes: DataFrame, revision: bool = False, origin: bool = False, fields: bool = False) -> DataFrame:
    """What a subscriber asked for; the rest is left out."""
    cols = ["type", "node_id", "edge_id", "domain_id"]
    cols += ["revision", "commit_id", "committed_at"] if revision else []
    cols += ["origin"] if origin else []
    cols += ["labels", "changed_fields"] if fields else []
    return changes.select(*cols)


def replay(changes: DataFrame, after: int) -> DataFrame:
    """Batch: what came after a revision, in order, each revision's change once."""
    return changes.filter(F.col("revision") > after).dropDuplicates(["revision", "type", "node_id", "edge_id"]).orderBy("revision")


def gap(changes: DataFrame, after: int) -> DataFrame:
    """Batch: one row (first_revision, gap): whether history after a revision was compacted."""
    return changes.agg(F.min("revision").alias("first_revision")).withColumn("gap", F.coalesce(F.col("first_revision") - 1 > F.lit(after), F.lit(False)))


def retained(changes: DataFrame, now=None, events: int = RETAIN_EVENTS, hours: int = RETAIN_HOURS) -> DataFrame:
    """Batch: the newest ``events`` revisions of each domain no older than ``hours`` before
    the newest commit (or ``now``). The cut is a revision per domain, so rows need no sort:
    the n-th largest revision comes from a two-level count over revision ranges."""
    newest = F.lit(now).cast("timestamp") if now is not None else F.col("__now")
    limits = changes.groupBy("domain_id").agg(F.max("committed_at").alias("__now"), F.max("revision").alias("__top"))
    young = changes.join(limits, "domain_id").filter(F.col("committed_at") >= newest - F.expr(f"INTERVAL {hours} HOURS"))
    near = young.withColumn("__block", F.floor((F.col("__top") - F.col("revision")) / 4096))
    blocks = near.groupBy("domain_id", "__block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("domain_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    open_blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("__before") < events)
    inside = Window.partitionBy("domain_id", "__block").orderBy(F.desc("revision"))
    kept = near.join(open_blocks.drop("n"), ["domain_id", "__block"]).withColumn("__n", F.row_number().over(inside) + F.col("__before"))
    return kept.filter(F.col("__n") <= events).select(*changes.columns)


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream: each change once although sent again, within a bound on lateness."""
    return stream.withWatermark("committed_at", late).dropDuplicatesWithinWatermark(["revision", "type", "node_id", "edge_id"])


def deliver(stream: DataFrame, handle, checkpoint: str, available_now: bool = True):
    """At-least-once delivery: ``handle(batch in order of revision, epoch)``; the checkpoint
    remembers what was delivered, a failed batch comes again."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: handle(df.orderBy("revision"), epoch))
    return (w.trigger(availableNow=True) if available_now else w).start()


def triggered(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes × runnable automations: (change columns, rule_id). Only node.created and
    node.updated fire; all labels of a rule are needed; an automation's own writes don't
    fire it, nor does what came before its binding (rules: rule_id, labels, bound_at)."""
    fire = changes.filter(F.col("type").isin("node.created", "node.updated"))
    r = rules.select("rule_id", F.col("labels").alias("__need"), "bound_at")
    fits = (F.size(F.array_except("__need", F.coalesce("labels", F.array().cast("array<string>")))) == 0) & (F.col("committed_at") >= F.col("bound_at"))
    own = F.coalesce(F.col("origin") == F.concat(F.lit("automation:"), F.col("rule_id")), F.lit(False))
    # a rule's first needed label is the join key; rules without labels take every change
    keyed = r.withColumn("__key", F.coalesce(F.try_element_at("__need", F.lit(1)), F.lit("*")))
    each = fire.withColumn("__key", F.explode(F.concat(F.array_distinct(F.coalesce("labels", F.array().cast("array<string>"))), F.array(F.lit("*")))))
    return each.join(F.broadcast(keyed) if rules.limit(10_001).count() <= 10_000 else keyed, "__key").filter(fits & ~own).drop("__key", "__need")


def invocation_id(*cols: Column) -> Column:
    """The same change and automation always give the same id."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def dirty_targets(changes: DataFrame) -> DataFrame:
    """(target, action): created, updated, deleted and touched nodes; a refresh overrides a
    delete of the same target."""
    own = changes.select(F.col("node_id").alias("target"), F.when(F.col("type") == "node.deleted", 0).otherwise(1).alias("p"))
    ends = changes.select(F.explode("affected_node_ids").alias("target"), F.when((F.col("type") == "node.deleted") & (F.col("target") == F.col("node_id")), 0).otherwise(1).alias("p"))
    both = own.unionByName(ends).filter("target IS NOT NULL")
    return both.groupBy("target").agg(F.max("p").alias("p")).select("target", F.when(F.col("p") == 1, "refresh").otherwise("delete").alias("action"))


def rule_matches(changes: DataFrame, kinds: list[str], labels: list[str]) -> DataFrame:
    """Changes of listed kinds; a creation needs any of the labels, the rest bypass them."""
    some = F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])), F.lit(False)) if labels else F.lit(True)
    return changes.filter(F.col("type").isin(kinds) & ((F.col("type") != "node.created") | some))
