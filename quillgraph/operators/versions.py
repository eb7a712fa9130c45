"""Versions of rows: as-of reads, latest per key, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _payload(df: DataFrame, keys: list[str]):
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def latest(versions: DataFrame, keys: list[str], revision: str = "revision", tombstone: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """The newest version of each key (a partial maximum, no sort); a tombstone hides it."""
    order = F.struct(revision, *(tie or []))
    out = versions.groupBy(*keys).agg(F.max_by(_payload(versions, keys), order).alias("__v")).select(*keys, "__v.*")
    return out.filter(~F.col(tombstone)) if tombstone else out


def as_of(versions: DataFrame, keys: list[str], at, revision: str = "revision", tombstone: str | None = None) -> DataFrame:
    """Rows as they were at a revision."""
    return latest(versions.filter(F.col(revision) <= F.lit(at)), keys, revision, tombstone)


def journal_after(journal: DataFrame, revision: int) -> DataFrame:
    """Entries after a revision, in order."""
    return journal.filter(F.col("revision") > revision).orderBy("revision")


def compact(journal: DataFrame, fences: DataFrame, scope: str = "scope") -> DataFrame:
    """A journal without entries below its scope's lowest fence (scope, fence); the fence's
    own entry stays, as do scopes without a fence."""
    low = fences.groupBy(scope).agg(F.min("fence").alias("__fence"))
    return journal.join(low, scope, "left").filter(F.col("__fence").isNull() | (F.col("revision") >= F.col("__fence"))).drop("__fence")


def journal_days(nodes: DataFrame, day: str, low: int, high: int) -> DataFrame:
    """Nodes whose integer day lies in a range."""
    return nodes.filter(F.col(day).between(low, high))
