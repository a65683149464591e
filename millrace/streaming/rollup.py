"""Request metrics by minute and endpoint, in batch and as streams; the same expressions serve both."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import plain_path

#: Seconds of a bucket, buckets of the series, alert limits, slow requests, endpoints listed.
BUCKET, SERIES, ERROR_RATE, MEAN_MS, SLOW_MS, SLOW_LISTED, ENDPOINTS = 60, 60, 0.05, 10_000, 3_000, 20, 20


def _totals(is_error: Column, duration: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.sum(is_error.cast("int")), F.lit(0)).cast("long").alias("errors"), F.sum(duration).alias("total_ms")]


def by_minute(events: DataFrame, time: str, is_error: Column, duration: Column, watermark: str | None = None) -> DataFrame:
    """(minute, n, errors, total_ms) of buckets with events. A stream closes buckets by ``watermark``."""
    events = events.withColumn("__time", F.col(time).cast("timestamp"))
    if watermark:
        events = events.withWatermark("__time", watermark)
    out = events.groupBy(F.window("__time", f"{BUCKET} seconds").alias("w")).agg(*_totals(is_error, duration))
    return out.select(F.col("w.start").alias("minute"), "n", "errors", "total_ms")


def series(minutes: DataFrame, end, buckets: int = SERIES) -> DataFrame:
    """The last ``buckets`` minutes up to ``end``, those without events at zero."""
    spark = minutes.sparkSession
    last = F.date_trunc("minute", F.lit(end).cast("timestamp"))
    frame = spark.range(buckets).select((last - F.make_interval(mins=(F.lit(buckets - 1) - F.col("id")).cast("int"))).alias("minute"))
    filled = frame.join(minutes, "minute", "left")
    return filled.select("minute", *[F.coalesce(c, F.lit(0).cast(minutes.schema[c].dataType)).alias(c) for c in ("n", "errors", "total_ms")])


def filled(minutes: DataFrame) -> DataFrame:
    """Every minute between the first and the last, those without events at zero."""
    ends = minutes.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).where("a is not null")
    frame = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {BUCKET} seconds"))).alias("minute"))
    return frame.join(minutes, "minute", "left").select("minute", *[F.coalesce(c, F.lit(0).cast(minutes.schema[c].dataType)).alias(c) for c in ("n", "errors", "total_ms")])


def alerts(minutes: DataFrame) -> DataFrame:
    """(minute, kind, value) of minutes above the error rate or the mean duration allowed."""
    rate, mean = F.col("errors") / F.col("n"), F.col("total_ms") / F.col("n")
    kinds = F.array_compact(F.array(F.when(rate > ERROR_RATE, F.struct(F.lit("error_rate").alias("kind"), rate.alias("value"))), F.when(mean > MEAN_MS, F.struct(F.lit("mean_ms").alias("kind"), mean.alias("value")))))
    return minutes.where("n > 0").select("minute", F.explode(kinds).alias("x")).select("minute", "x.*")


def endpoints(events: DataFrame, path: Column, is_error: Column, duration: Column, top: int = ENDPOINTS) -> DataFrame:
    """The most used endpoints: (path, n, errors, error_rate, avg_ms, max_ms)."""
    out = events.groupBy(plain_path(path).alias("path")).agg(*_totals(is_error, duration), F.max(duration).alias("max_ms"))
    out = out.select("path", "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"), (F.col("total_ms") / F.col("n")).alias("avg_ms"), "max_ms")
    return out.orderBy(F.desc("n"), "path").limit(top)


def slow(events: DataFrame, time: str, duration: str, key: str, above: float = SLOW_MS, n: int = SLOW_LISTED) -> DataFrame:
    """The newest slow requests."""
    return events.where(F.col(duration) > above).orderBy(F.desc(time), key).limit(n)


def rate_limited(events: DataFrame, by: str, time: str, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """Events with ``recent``, how many the same caller had within the seconds before (its own included), and ``allowed``.

    A caller's events are dealt by slices of time, each with the slice before it, so that a busy caller's go to many tasks.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.withColumn("__at", at).withColumn("__slice", F.floor(F.col("__at") / width))
    rows = rows.withColumn("__in", F.explode(F.when(F.col("__at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("__slice"), F.col("__slice") + 1))))
    recent = Window.partitionBy(by, "__in").orderBy("__at").rangeBetween(-width + 1, 0)
    rows = rows.withColumn("recent", F.count("*").over(recent)).where(F.col("__in").eqNullSafe(F.col("__slice")))
    return rows.drop("__at", "__slice", "__in").withColumn("allowed", F.col("recent") <= limit)


class RateLimit:
    """Per caller, the times within the window before: the state of :func:`stream_rate_limited`.

    Once the watermark has passed a caller's last time by the window, a timer removes what is held of it.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * 1_000_000

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            batch = batch.sort_values(["at", "event"], kind="stable")
            recent = []
            for at in batch["at"].tolist():
                insort(held, at)
                recent.append(bisect_right(held, at) - bisect_right(held, at - self.width))
            yield pd.DataFrame({"caller": batch["caller"], "event": batch["event"], "recent": recent, "allowed": [n <= self.limit for n in recent]})
        held = held[bisect_right(held, held[-1] - self.width) :] if held else held
        ends = (held[-1] + self.width) // 1000 + 1 if held else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((held,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()


def stream_rate_limited(events: DataFrame, by: str, time: str, key: str, limit: int, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """(caller, event, recent, allowed) of a stream of events in order: as :func:`rate_limited`, with state for each caller.

    Events that come later than the watermark allows are left out, as the state they would need may be gone.
    """
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", watermark)
    rows = timed.select(F.col(by).cast("string").alias("caller"), F.col(key).cast("string").alias("event"), F.unix_micros("__time").alias("at"), "__time")
    return rows.groupBy("caller").applyInPandasWithState(
        RateLimit(limit, seconds), "caller string, event string, recent long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_alerts(events: DataFrame, time: str, is_error: Column, duration: Column, path: str, checkpoint: str, watermark: str = "10 minutes"):
    """A query that adds the alerts of each closed minute to the parquet table at ``path``, and ends when all is read.

    A batch that is tried again after a failure writes its own folder anew, so no alert comes twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        alerts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = by_minute(events, time, is_error, duration, watermark)
    return out.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps what each query last reported: its batch, rows read, and how it ended."""

    def __init__(self, on_batch=None):
        self.batches: dict[str, list[dict]] = {}
        self.ended: dict[str, str | None] = {}
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        self.batches[str(event.id)] = []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        beat = {"batch": p.batchId, "rows": p.numInputRows, "name": p.name}
        self.batches.setdefault(str(p.id), []).append(beat)
        if self.on_batch:
            self.on_batch(beat)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def stream_minutes(events: DataFrame, time: str, is_error: Column, duration: Column, name: str, checkpoint: str, watermark: str = "10 minutes"):
    """A query that keeps the minutes of what has arrived in the memory table ``name``, and ends when all is read."""
    out = by_minute(events, time, is_error, duration, watermark)
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_log(spark, folder: str, stream: bool = True) -> DataFrame:
    """JSON lines of model usage: ts, role, model, tokens in and out, cache hits, trace."""
    schema = "ts timestamp, role string, model string, `in` long, out long, cache_hit long, trace string"
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(folder)
