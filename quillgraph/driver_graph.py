"""The property graph over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import Graph, Index


_SCHEMAS: dict[tuple, object] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is looked up once a session, its files at every call."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = f"{sf_dir}/{name}.parquet"
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with a key of all their columns (order and line number repeat)."""
    li = read(spark, sf_dir, "lineitem")
    return li.withColumn("l_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns])))


def build(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages", "conversations", "labels")}
    li = lineitems(spark, sf_dir)
    # derived columns for what the tables lack: missing values and tags
    ev = t["events"].withColumns(
        {
            "amount": F.when(F.col("event_type") != "error", F.col("value")),
            "tags": F.array(F.concat(F.lit("#"), F.col("event_type")), F.concat(F.lit(" User "), (F.col("user_id") % 3).cast("string"))),
        }
    )
    turns = t["conversations"].withColumn("turn_id", F.concat_ws("/", "conv_id", "turn"))
    g = Graph(trusted=False)
    g.add_node("Region", t["region"], "r_regionkey").add_node("Nation", t["nation"], "n_nationkey").add_node("Customer", t["customer"], "c_custkey")
    g.add_node("Supplier", t["supplier"], "s_suppkey").add_node("Part", t["part"], "p_partkey").add_node("Orders", t["orders"], "o_orderkey")
    g.add_node("LineItem", li, "l_id").add_node("Event", ev, "event_id").add_node("Document", t["documents"], "doc_id", content="text")
    g.add_node("Vector", t["embeddings"], "vec_id").add_node("Page", t["pages"], "page_id", content="html").add_node("Turn", turns, "turn_id", content="text")
    g.add_node("User", t["events"].select("user_id").distinct(), "user_id")
    g.add_edge("IN_REGION", "Nation", "Region", t["nation"], "n_nationkey", "n_regionkey", held_by="src")
    g.add_edge("IN_NATION", "Customer", "Nation", t["customer"], "c_custkey", "c_nationkey", held_by="src")
    g.add_edge("IN_NATION", "Supplier", "Nation", t["supplier"], "s_suppkey", "s_nationkey", held_by="src")
    g.add_edge("PLACED", "Customer", "Orders", t["orders"], "o_custkey", "o_orderkey", held_by="dst")
    g.add_edge("contains", "Orders", "LineItem", li, "l_orderkey", "l_id", order="l_linenumber", held_by="dst", edge_id=F.col("l_id"))
    g.add_edge("contains", "Region", "Nation", t["nation"], "n_regionkey", "n_nationkey", order="n_nationkey", held_by="dst")
    g.add_edge("contains", "Nation", "Customer", t["customer"], "c_nationkey", "c_custkey", order="c_custkey", held_by="dst")
    g.add_edge("OF_PART", "LineItem", "Part", li, "l_id", "l_partkey", held_by="src")
    g.add_edge("SUPPLIED_BY", "LineItem", "Supplier", li, "l_id", "l_suppkey", held_by="src")
    g.add_edge("DID", "User", "Event", ev, "user_id", "event_id", held_by="dst")
    nxt = turns.withColumn("next_turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    nxt = nxt.filter(F.col("next_turn") == F.col("turn") + 1).select(F.col("turn_id").alias("src"), F.concat_ws("/", "conv_id", "next_turn").alias("dst"))
    g.add_edge("NEXT", "Turn", "Turn", nxt, "src", "dst")
    g.indexes += [Index("orders_by_price", "node", "Orders", "o_totalprice", ordered=True), Index("events_by_amount", "node", "Event", "amount", ordered=True)]
    return g
