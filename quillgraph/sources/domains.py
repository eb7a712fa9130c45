"""Domains in and out: export, import with modes, archives, blobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import places
from ..catalog import Graph
from ..errors import Conflict


def export_domain(graph: Graph, path: str, domain: str = "default", blobs: DataFrame | None = None) -> dict:
    """Writes nodes and edges of a graph below a folder, and a manifest of what is there."""
    spark = next(iter(graph.nodes.values())).df.sparkSession
    manifest = {"domain": domain, "revision": graph.revision, "nodes": {}, "edges": {}}
    if blobs is not None:
        blobs.write.mode("overwrite").parquet(f"{path}/blobs")
    for label, t in graph.nodes.items():
        t.df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
        manifest["nodes"][label] = {"key": t.key, "content": t.content, "labels": t.labels}
    for label, parts in graph.edges.items():
        manifest["edges"][label] = []
        for n, p in enumerate(parts):
            e = p.df.select(F.col(p.src).alias("src"), F.col(p.dst).alias("dst"), p.id_column().alias("edge_id"), *[F.col(x) for x in p.props], (F.col(p.order) if p.order else F.lit(None).cast("int")).alias("ord"))
            e.filter("src IS NOT NULL AND dst IS NOT NULL").write.mode("overwrite").parquet(f"{path}/edges/{label}/{n}")
            manifest["edges"][label].append({"source": p.source, "target": p.target, "props": p.props})
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_domain(spark: SparkSession, path: str) -> Graph:
    """A graph from an export."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    g = Graph(revision=m["revision"])
    for label, t in m["nodes"].items():
        g.add_node(label, spark.read.parquet(f"{path}/nodes/{label}"), t["key"], content=t["content"], labels=t["labels"])
    for label, parts in m["edges"].items():
        for n, p in enumerate(parts):
            g.add_edge(label, p["source"], p["target"], spark.read.parquet(f"{path}/edges/{label}/{n}"), "src", "dst", edge_id=F.col("edge_id"), order="ord", props=p["props"])
    return g


def export_space(graphs: dict[str, Graph], path: str, space: str = "default") -> dict:
    """Every domain of a space below one folder, and a manifest of the space."""
    spark = next(iter(next(iter(graphs.values())).nodes.values())).df.sparkSession
    manifest = {"space": space, "domains": {name: export_domain(g, f"{path}/domain={name}", name)["revision"] for name, g in graphs.items()}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_space(spark: SparkSession, path: str) -> dict[str, Graph]:
    """Every domain that a space's manifest names."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: import_domain(spark, f"{path}/domain={name}") for name in m["domains"]}


def put_blobs(contents: DataFrame, path: str, column: str = "content") -> DataFrame:
    """Stores contents under their SHA-256, each once; those that are there already stay.
    (blob_id, length) of all that were given."""
    spark = contents.sparkSession
    rows = contents.select(F.col(column).cast("binary").alias("content")).filter("content IS NOT NULL").withColumn("blob_id", F.sha2("content", 256))
    given = rows.select("blob_id", F.octet_length("content").alias("length")).distinct()
    if places.exists(spark, path):
        rows = rows.join(spark.read.schema("blob_id string").parquet(path), "blob_id", "left_anti")
    rows.groupBy("blob_id").agg(F.first("content").alias("content")).write.mode("append").parquet(path)
    return given


def get_blobs(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(blob_id, content) of ids (column blob_id)."""
    return spark.read.schema("blob_id string, content binary").parquet(path).join(ids.select("blob_id").distinct(), "blob_id", "left_semi")


def merge_rows(base: DataFrame, incoming: DataFrame, key: str, mode: str = "upsert", preserve_ids: bool = True, dry_run: bool = False):
    """Rows after an import. create: a key that is there already is a Conflict; upsert: it is
    replaced; replace: only the incoming rows stay. dry_run gives (created, updated,
    deleted) counts and changes nothing."""
    if not preserve_ids:
        incoming = incoming.withColumn(key, F.concat(F.lit("imported-"), F.sha2(F.to_json(F.struct(*incoming.columns)), 256)) if dict(incoming.dtypes)[key] == "string" else -F.abs(F.xxhash64(*incoming.columns)))
    same = incoming.select(key).join(base.select(key), key, "left_semi")
    if dry_run:
        n, m, again = base.count(), incoming.count(), same.count()
        return {"create": {"created": m, "updated": 0, "deleted": 0, "conflicts": again}, "upsert": {"created": m - again, "updated": again, "deleted": 0}, "replace": {"created": m - again, "updated": again, "deleted": n - again}}[mode]
    if mode == "replace":
        return incoming
    if mode == "create" and not same.isEmpty():
        raise Conflict("a key is there already")
    return base.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(blob_id, path, length, content) of files: addressed by their content's SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.sha2("content", 256).alias("blob_id"), "path", "length", "content")


def slice_source(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Rows held in memory as a source."""
    return spark.createDataFrame(rows, schema)
