"""Debounce, schedules, dirty work and retries: batch twins and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Conflict


def debounce(rows: DataFrame, key: str, at: str, gap: str, order: str) -> DataFrame:
    """Batch: bursts of a key whose rows follow each other within ``gap``; the newest row of
    a burst stays, the others are coalesced into it. (key, burst_start, fires_at, n, kept)"""
    w = Window.partitionBy(key).orderBy(at, order)
    step = rows.withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) > F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1)))
    burst = step.withColumn("__burst", F.sum("__new").over(w))
    out = burst.groupBy(key, "__burst").agg(F.min(at).alias("burst_start"), F.max(at).alias("__last"), F.count(F.lit(1)).alias("n"), F.max_by(order, F.struct(at, order)).alias("kept"))
    return out.select(key, "burst_start", (F.col("__last") + F.expr(f"INTERVAL {gap}")).alias("fires_at"), "n", "kept")


def debounce_stream(stream: DataFrame, key: str, at: str, gap: str, order: str, late: str = "0 seconds") -> DataFrame:
    """Stream twin: a session per key; it leaves once the watermark passes its gap."""
    s = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    out = s.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(at, order)).alias("x"))
    return out.select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("fires_at"), "n", F.col(f"x.{order}").alias("kept"))


def schedule(rows: DataFrame, at: str, every: str, *aggs, by: list[str] = ()) -> DataFrame:
    """Ticks aligned to an interval (batch or stream): (by, tick, aggregates)."""
    return rows.groupBy(*by, F.window(at, every).alias("w")).agg(*aggs).withColumn("tick", F.col("w.start")).drop("w")


def dirty_work(changes: DataFrame, target: str, revision: str, at: str, cooldown: str, checkpoint: int = -1) -> DataFrame:
    """(target, revision, run_at): per target the newest change after a consumer's
    checkpoint, runnable once the cooldown after it is over."""
    new = changes.filter(F.col(revision) > checkpoint)
    return new.groupBy(target).agg(F.max(revision).alias("revision"), (F.max(at) + F.expr(f"INTERVAL {cooldown}")).alias("run_at"))


def consumers_work(changes: DataFrame, target: str, revision: str, at: str, cooldown: str, checkpoints: dict[str, int]) -> DataFrame:
    """(consumer, target, revision, run_at): ``dirty_work`` of every consumer from its own
    checkpoint, by one aggregation: a target is dirty to those who haven't seen its newest change."""
    newest = changes.groupBy(target).agg(F.max(revision).alias("revision"), F.max_by(at, revision).alias("__at"))
    each = F.array(*[F.struct(F.lit(c).alias("consumer"), F.lit(r).cast("long").alias("seen")) for c, r in sorted(checkpoints.items())])
    due = newest.withColumn("__c", F.explode(each)).filter(F.col("revision") > F.col("__c.seen"))
    return due.select("__c.consumer", target, "revision", (F.col("__at") + F.expr(f"INTERVAL {cooldown}")).alias("run_at"))


def advanced(checkpoints: dict[str, int], done: dict[str, int]) -> dict[str, int]:
    """Checkpoints after some work: they only go forward."""
    return {c: max(r, done.get(c, r)) for c, r in checkpoints.items()}


def backoff(attempt: int, base: float = 1.0, most: float = 300.0) -> float:
    """Seconds before a retry: doubling, bounded."""
    return min(most, base * 2 ** max(0, attempt - 1))


def bootstrap(snapshot: DataFrame, changes: DataFrame, revision: int, apply):
    """A snapshot at a revision and the changes after it, in order and once; a gap between
    them is an error."""
    from .changes import gap, replay

    if gap(changes, revision).first()["gap"]:
        raise ValueError("history between the snapshot and the changes is missing")
    return apply(snapshot, replay(changes, revision))


@dataclass(frozen=True)
class SourcePage:
    """Changes of a scope after a revision, up to ``end``; whether more follow."""

    scope: str
    after: int
    end: int
    rows: DataFrame
    more: bool


def pages_of(changes: DataFrame, scope: str, revision: str = "revision", compacted: int | None = None):
    """Reads pages of changes, ordered by revision, by one distributed top-k each. A revision
    is never split: one larger than a page is a page of its own. History up to ``compacted``
    is gone: pages begin after it."""

    def read(of: str, after: int, size: int) -> SourcePage:
        after = after if compacted is None else max(after, compacted)
        new = changes.filter(F.col(revision) > after).orderBy(revision).limit(size + 1)
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.max(revision).alias("last")).first()
        if seen["n"] <= size:
            return SourcePage(scope, after, seen["last"] if seen["n"] else after, new, False)
        rows = new.filter(F.col(revision) < seen["last"])
        end = rows.agg(F.max(revision)).first()[0]
        if end is None:
            rows, end = changes.filter(F.col(revision) == seen["last"]), seen["last"]
        return SourcePage(scope, after, end, rows, True)

    return read


def paged_replay(read, scope: str, boundary: int, size: int, apply) -> int:
    """Applies every page after a snapshot's boundary once and in order; returns the revision
    reached. Pages of another scope, a gap between pages, or no progress are an error; an
    error of ``apply`` leaves the later pages undone."""
    if size <= 0:
        raise ValueError("a page has at least one change")
    after = boundary
    while True:
        page = read(scope, after, size)
        if page.scope != scope:
            raise Conflict(f"a page of {page.scope} within {scope}")
        if page.after != after:
            raise Conflict(f"a page from {page.after}, {after} was asked for")
        if page.end < after or (page.more and page.end == after):
            raise Conflict(f"no progress beyond {after}")
        apply(page)
        after = page.end
        if not page.more:
            return after
