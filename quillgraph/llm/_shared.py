"""What the operators share: the shared folder, written intermediate tables, batches."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..places import delete, shared_folder

#: Bytes per Arrow batch: texts may be long, so a bound on rows alone doesn't bound memory.
BATCH_BYTES = 4 << 20


#: Bits of the filter that tells rows that may be among some ids from all others: 64 to a
#: row of the table that is broadcast.
SIFT_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch for the session; a stricter setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
    if not size or int(size[1]) << (10 * " kmgt".index(size[2] or " ")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def sifted(df: DataFrame, key: str, ids: Column, of: DataFrame) -> DataFrame:
    """Adds maybe: false where a row's ``key`` is surely none of the ids (longs) of a frame.

    Others may pass for one of them, the more the fuller the filter: a join decides. The
    filter has SIFT_BITS bits whatever the tables' size, and so is broadcast."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(SIFT_BITS))
    bits = of.select(place(ids).alias("__p")).groupBy(F.shiftright("__p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(__p & 63 AS INT))")).alias("__bits"))
    both = df.withColumn("__p", place(F.col(key))).join(F.broadcast(bits), F.shiftright("__p", 6) == F.col("__word"), "left")
    return both.withColumn("maybe", F.coalesce(F.expr("(shiftrightunsigned(__bits, CAST(__p & 63 AS INT)) & 1) = 1"), F.lit(False))).drop("__p", "__word", "__bits")


#: Kept tables of this process: results that callers still read.
_kept: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Delete the tables behind all results returned so far; how many there were. Frames that
    read them, and what is yet to be computed from those, can't be used any more."""
    n = len(_kept)
    while _kept:
        delete(spark, _kept.pop())
    return n


class Scratch:
    """Tables written to the shared folder; all go when the block ends but those kept.

    A written table cuts the lineage: losing an executor later costs at most a reread.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.paths, self.made = spark, {}, 0
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}-{name}-{self.made}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = True
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path and self.paths.pop(path, None):
            delete(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Exempt a written table from the clean-up; its files stay for its readers, until
        ``clean_up``."""
        if self.paths.pop(df._scratch_path, None):
            _kept.append(df._scratch_path)
        return df

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        for path in list(self.paths):
            delete(self.spark, path)
        self.paths.clear()
