"""Structured Streaming: queues, windows, sessions and late events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

#: Files of one micro-batch, seconds between polls.
BATCH_FILES, POLL = 20, "3 seconds"


def queue(spark: SparkSession, path: str, schema: StructType | str, batch: int = BATCH_FILES, fmt: str = "parquet") -> DataFrame:
    """New files below ``path`` as a stream, ``batch`` at a time.

    The checkpoint remembers what was claimed, so a crash replays a batch
    instead of losing it and no row locks are needed.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).format(fmt).load(path)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Run ``handle`` on each micro-batch: on all that is there now, or every ``poll`` for good."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def idempotent_append(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own: a replayed batch replaces itself."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def append_unknown(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler that appends rows whose keys no earlier batch has.

    Each batch has a folder of its own and is compared with those of smaller
    numbers only, so a replayed batch writes the same rows again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if exists(spark, path):
            known = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(path)
            fresh = fresh.join(known.where(F.col("batch") < batch_id).select(*keys), keys, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def windowed(events: DataFrame, size: str, lateness: str, at: str = "ts", by: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and totals per window; events later than ``lateness`` are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, lateness).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def session_windows(events: DataFrame, gap: str, lateness: str, at: str = "ts", person: str = "user_id") -> DataFrame:
    out = events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), person).agg(F.count(F.lit(1)).alias("n"))
    return out.select(person, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], lateness: str, at: str = "ts") -> DataFrame:
    """The first event of each key; keys are forgotten after ``lateness``."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def split_late(events: DataFrame, now: str = "current_timestamp()", minutes: int = 30, at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(delivered, skipped): events more than ``minutes`` late are kept apart, not lost."""
    late = F.unix_timestamp(F.expr(now)) - F.unix_timestamp(at) > minutes * 60
    return events.where(~late), events.where(late)


SESSION = "user_id long, started_at timestamp, ends_at timestamp, finished_at timestamp, status string"


def timer_sessions(starts: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Sessions (user_id, ts, minutes) of which each person has one at a time.

    A new start ends the running session as replaced; otherwise an event-time
    timer ends it as finished when the watermark passes its end. State is one
    row per person.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        running = state.get if state.exists else None
        if state.hasTimedOut:
            start, end = running
            out.append((key[0], pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), pd.Timestamp(end, unit="us"), "finished"))
            state.remove()
            running = None
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for ts, minutes in zip(rows["ts"], rows["minutes"]):
                at = int(ts.value // 1000)
                if running:
                    start, end = running
                    done = min(at, end)
                    status = "replaced" if at < end else "finished"
                    out.append((key[0], *(pd.Timestamp(x, unit="us") for x in (start, end, done)), status))
                running = (at, at + int(minutes) * 60_000_000)
            state.update(running)
            state.setTimeoutTimestamp(max(running[1] // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "started_at", "ends_at", "finished_at", "status"])

    keyed = starts.withWatermark("ts", lateness).select("user_id", "ts", "minutes").groupBy("user_id")
    return keyed.applyInPandasWithState(step, SESSION, "started long, ends long", "append", GroupStateTimeout.EventTimeTimeout)
