"""The corpus pipeline: documents that toxicity rejects go, one document of each group of
near copies stays, passages that repeat are cut, the rest is packed into sequences.

Every stage works on all that the stage before kept. Rows whose doc_id is null can't be
told apart by it: the near-copy stage keeps them, and later passages that they share with
others are cut. Of rows that repeat a doc_id it keeps one (the largest hash of the text, so
a choice that any run repeats). Null and empty texts are neither toxic nor copies: they stay,
and are packed as their end id alone. Texts of any length are read whole. All but the last
stage return the columns of their input, whatever further columns it has and however those
are named; n_chars follows the text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import chunk_dedup, ngram_join, packing, toxicity
from quillgraph.llm._shared import Scratch, sifted, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with the columns they came with."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select("r.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of the 5-gram Jaccard join at 0.8, its smallest doc_id."""
    joined = ngram_join.join(docs).filter("doc_id IS NOT NULL")
    ids = joined.groupBy("doc_id").agg(F.min("component_id").alias("group"), F.count(F.lit(1)).alias("rows"))
    odd = ids.filter("group <> doc_id OR rows > 1")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("doc_id").cast("long").alias("k"))
    # Only rows whose doc_id may be odd are shuffled; a null doc_id is none.
    rows = sifted(rows, "k", F.col("doc_id"), odd)
    asked = rows.filter("maybe").join(odd, F.col("k") == F.col("doc_id"), "left").filter("group IS NULL OR group = k")
    kept = rows.filter("NOT maybe").select("r").unionByName(asked.filter("rows IS NULL OR rows = 1").select("r"))
    if not odd.filter("group = doc_id").isEmpty():  # then rows = 1 for none of these
        w = Window.partitionBy("k").orderBy(F.desc(F.xxhash64("r.text")))
        kept = kept.unionByName(asked.filter("rows > 1").withColumn("n", F.row_number().over(w)).filter("n = 1").select("r"))
    return kept.select("r.*")


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents that were
    nothing but such passages go."""
    cut = chunk_dedup.dedup(docs)
    left = cut.filter((F.size("spans") == 0) | (F.length(F.trim("r.text")) > 0))
    cols = [F.length("r.text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"r.{c}").alias(c) for c in docs.columns]
    return left.select(*cols)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", near_copies_stage), ("substring_dedup", passages_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "pipeline") as s:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            made = s.write(stage(spark, docs, sf_dir), name)
            s.drop(docs)
            docs = made
        return s.keep(docs)


#: Three of the stages hash or train; tests hold the pipeline against brute force instead.
ORACLE_SQL = None
