"""Ways to hand changes to a subscriber: lossless with retries, lossy with gap signals, and a
watch that beats while nothing changes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
BACKOFF_MOST, HEARTBEAT_SECONDS = 0.25, 30
GAP, HEARTBEAT = "gap", "heartbeat"


def retried(handle, tries: int = 8, first: float = 0.005, most: float = BACKOFF_MOST, sleep=time.sleep):
    """A handler that is tried again after a failure, waiting twice as long each time up to
    ``most`` seconds; the last failure is raised, and the batch comes again."""

    def run(df, epoch):
        wait = first
        for n in range(tries):
            try:
                return handle(df, epoch)
            except Exception:  # noqa: BLE001
                if n + 1 == tries:
                    raise
                sleep(wait)
                wait = min(most, 2 * wait)

    return run


def lossless(stream: DataFrame, handle, checkpoint: str, available_now: bool = True, **options):
    """Every change in order of revision, at least once."""
    go = retried(handle, **options)
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: go(df.orderBy("revision"), epoch))
    return (w.trigger(availableNow=True) if available_now else w).start()


def bounded(changes: DataFrame, capacity: int) -> DataFrame:
    """The oldest ``capacity`` changes of a batch, as a subscriber's buffer takes them; where
    others were dropped, a row of type gap with the first revision that is missing."""
    kept = changes.orderBy("revision").limit(capacity)
    last = kept.agg(F.max("revision").alias("last"))
    dropped = changes.crossJoin(F.broadcast(last)).filter(F.col("revision") > F.col("last")).agg(F.min("revision").alias("revision")).filter("revision IS NOT NULL")  # one row
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields if f.name not in ("revision", "type")]
    return kept.unionByName(dropped.select("revision", F.lit(GAP).alias("type"), *blank))


def lossy(stream: DataFrame, handle, checkpoint: str, capacity: int, available_now: bool = True):
    """At most ``capacity`` changes a batch; a failure of the handler drops its batch, and the
    next one begins with a gap."""
    missed: list[int] = []

    def run(df, epoch):
        rows = bounded(df, capacity)
        if missed:
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in ("revision", "type")]
            rows = df.sparkSession.range(1).select(F.lit(min(missed)).cast("long").alias("revision"), F.lit(GAP).alias("type"), *blank).unionByName(rows)
        try:
            handle(rows.orderBy("revision"), epoch)
            missed.clear()
        except Exception:  # noqa: BLE001
            first = df.agg(F.min("revision")).first()[0]
            missed.extend([first] if first is not None else [])

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (w.trigger(availableNow=True) if available_now else w).start()


def heartbeats(changes: DataFrame, time_col: str, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Batch: (tick): the beats between the first and the last change, that is the ends of
    spans of ``seconds`` in which nothing changed."""
    kind = dict(changes.dtypes)[time_col]
    changes = changes.select(F.col(time_col).cast("timestamp").alias(time_col))
    span = changes.agg(F.date_trunc("second", F.min(time_col)).alias("lo"), F.max(time_col).alias("hi"))
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    ticks = span.filter("hi IS NOT NULL").select(F.posexplode(F.sequence(F.col("lo") + step, F.greatest("hi", F.col("lo") + step), step)).alias("n", "tick"))
    lo = span.select("lo")
    busy = changes.crossJoin(F.broadcast(lo)).select(F.floor((F.col(time_col).cast("double") - F.col("lo").cast("double")) / seconds).cast("int").alias("n")).distinct()  # one row
    return ticks.join(busy, "n", "left_anti").select(F.col("tick").cast(kind).alias("tick"))


def watch(spark: SparkSession, stream: DataFrame, handle, checkpoint: str, seconds: int = HEARTBEAT_SECONDS, available_now: bool = False):
    """Changes as they come, and a row of type heartbeat every ``seconds`` in between."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != "type"]
    both = stream.unionByName(beat.select(F.lit(HEARTBEAT).alias("type"), *blank))
    w = both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: handle(df, epoch))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()
