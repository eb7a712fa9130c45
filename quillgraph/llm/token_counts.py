"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer.

Documents are encoded whole; only (length, count) pairs leave a task, so the shuffle
holds at most one row per task and distinct length. Suffix sums over the histogram give,
for every context limit, how many documents exceed it, the tokens left after truncation
and the quantile. Null and empty texts count as length 0; an empty table gives no rows.
Repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import Scratch, small_batches


def _lengths(batches):
    counts: dict[int, int] = {}
    for b in batches:
        for text in b.column(0).to_pylist():
            n = len(byte_bpe.encode(text or ""))
            counts[n] = counts.get(n, 0) + 1
    yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(counts), pa.int64()), "docs": pa.array(list(counts.values()), pa.int64())})


def histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) over all documents."""
    small_batches(docs.sparkSession)
    part = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths, "n_tokens long, docs long")
    counts = part.groupBy("n_tokens").agg(F.sum("docs").alias("n_docs"))
    scratch = Scratch(docs.sparkSession, "token-counts")  # else each reader would encode anew
    return scratch.keep(scratch.write(counts, "histogram"))


#: Lengths per block of the two-level suffix sum.
BLOCK = 1024


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length L: documents and tokens at least that long, totals truncated at
    L, and the share of documents of at most L tokens (the quantile that L is).

    Sums run within blocks of BLOCK lengths; the blocks' own totals, one row per block of
    lengths, are summed first, so no task orders all lengths.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("above_tokens"),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("above_docs") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("above_tokens") + F.sum(tokens).over(inside)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    below = F.col("all_docs") - F.col("docs_at_least")
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        ((below + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        F.col("all_tokens").alias("total_tokens"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens that stay when every document is cut at any context limit: one row."""
    nxt = sums.filter(F.col("n_tokens") > limit).agg(
        F.max("docs_at_least").alias("over"), F.max("tokens_at_least").alias("tokens_over")
    )
    return sums.agg(F.max("total_tokens").alias("total_tokens")).crossJoin(nxt).select(
        F.lit(limit).alias("context_limit"),
        "total_tokens",
        F.coalesce("over", F.lit(0)).alias("docs_over"),
        (F.col("total_tokens") - F.coalesce("tokens_over", F.lit(0)) + F.coalesce("over", F.lit(0)) * limit).alias("truncated_total"),
    )


def length_at_quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents stay within: one row."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
