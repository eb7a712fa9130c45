"""Where written tables go: a folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own in local mode;
    on a cluster an error, as executors could not see it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))  # driver and executors are one process
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write where the cluster says, or else to a folder of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stamp(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """Each file with its length and time: another stamp, another content."""
    out = []
    for f in sorted(files):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        st = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((f, st.getLen(), st.getModificationTime()))
    return out
