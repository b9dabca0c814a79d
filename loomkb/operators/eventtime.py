"""Event-time operators that read alike in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_time(events: DataFrame, at: str = "ts") -> DataFrame:
    """Zone-less times as UTC timestamps, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, size: str, at: str = "ts", by: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, at: str = "ts", person: str = "user_id") -> DataFrame:
    out = events.groupBy(F.session_window(at, gap).alias("w"), person).agg(F.count(F.lit(1)).alias("n"))
    return out.select(person, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replace_sessions(starts: DataFrame, person: str, at: str, minutes: str, order: str) -> DataFrame:
    """Sessions of one person at a time: a new one ends the running one as replaced.

    Adds ends_at, finished_at and status (finished, or replaced where the next
    start comes before the end).
    """
    following = F.lead(at).over(Window.partitionBy(person).orderBy(at, order))
    due = (F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.col(minutes).cast("int"))).alias("ends_at")
    out = starts.select("*", due, following.alias("__next"))
    cut = F.col("__next").isNotNull() & (F.col("__next") < F.col("ends_at"))
    out = out.withColumn("status", F.when(cut, F.lit("replaced")).otherwise(F.lit("finished")))
    return out.withColumn("finished_at", F.when(cut, F.col("__next")).otherwise(F.col("ends_at"))).drop("__next")


def due(sessions_: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The sessions whose time is up, oldest first, with how late their notice is (over 90 seconds counts)."""
    late = (F.unix_timestamp(now) - F.unix_timestamp("ends_at")).alias("late_seconds")
    out = sessions_.where(F.col("ends_at") <= now).select("*", late).withColumn("is_late", F.col("late_seconds") > 90)
    return out.orderBy("ends_at").limit(limit)


def late_split(events: DataFrame, now: Column, minutes: int = 30, at: str = "ts") -> DataFrame:
    """Events up to ``now`` with delivered (at most ``minutes`` late) or skipped."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return events.where(F.col(at) <= now).withColumn("state", F.when(age <= minutes * 60, F.lit("delivered")).otherwise(F.lit("skipped")))


def claim_batch(queue: DataFrame, limit: int = 20, id_col: str = "id", status: str = "status") -> DataFrame:
    """The oldest queued rows, in id order."""
    return queue.where(F.col(status) == "queued").orderBy(id_col).limit(limit)


def read_after(notices: DataFrame, after: int, limit: int = 50, id_col: str = "id") -> DataFrame:
    return notices.where(F.col(id_col) > after).orderBy(id_col).limit(limit)


def expire(notices: DataFrame, now: Column, hours: int = 3, at: str = "created_at", read: str = "read_at") -> DataFrame:
    """Unread notices older than ``hours`` become read now."""
    old = F.col(at) < now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return notices.withColumn(read, F.when(F.col(read).isNull() & old, now).otherwise(F.col(read)))


def totals_today(sessions_: DataFrame, since: Column, now: Column, kind: str = "kind") -> DataFrame:
    """Seconds per kind since ``since``; running sessions count up to ``now``."""
    ended = F.least(F.coalesce("finished_at", now), now)
    inside = sessions_.where(F.col("started_at") >= since)
    return inside.groupBy(kind).agg(F.sum(F.unix_timestamp(ended) - F.unix_timestamp("started_at")).alias("seconds"))


def reading_stats(log: DataFrame, book: str = "book_id", at: str = "at", page: str = "page", total: int = 500) -> DataFrame:
    """Per book: last page, percent, pages left, and pages of the last seven days before the last entry."""
    w = Window.partitionBy(book)
    last_at = F.max(at).over(w)
    base = F.max(F.when(F.col(at) < F.col("last_at") - F.expr("INTERVAL 7 DAYS"), F.struct(at, page)))
    out = log.withColumn("last_at", last_at).groupBy(book).agg(F.max(F.struct(at, page)).alias("last"), base.alias("before"), F.count(F.lit(1)).alias("entries"))
    now = F.col("last")[page]
    week = now - F.coalesce(F.col("before")[page], F.lit(0))
    return out.select(book, now.alias("page"), F.round(100.0 * now / total, 1).alias("percent"), (F.lit(total) - now).alias("left"), week.alias("week"), "entries")
