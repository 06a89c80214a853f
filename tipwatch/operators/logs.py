"""Log event tables: selection, grouping per instance, retention, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HANG_SECONDS = 1200
RETENTION_DAYS = 7
STAMP = "yyyy-MM-dd HH:mm:ss"


def log_events(events: DataFrame, stream_prefix: str | None = None, start_ms: int | None = None) -> DataFrame:
    """Events by stream prefix and inclusive start; both reach the scan. Batch or stream."""
    kept = events
    if stream_prefix:
        kept = kept.filter(F.col("stream").startswith(stream_prefix))
    if start_ms is not None:
        kept = kept.filter(F.col("ts") >= F.timestamp_millis(F.lit(start_ms)))
    return kept


def head_log_events(events: DataFrame, stream: str, limit: int) -> DataFrame:
    return events.filter(F.col("stream") == stream).orderBy("ts", "seq").limit(limit)


def container_lines(events: DataFrame) -> DataFrame:
    """Rendered lines of a container's events ``(ts, seq, message)``; the source stands behind the stamp. An event without
    a message is an empty line, one without a time begins in 1970."""
    ts = F.coalesce("ts", F.timestamp_seconds(F.lit(0))).alias("ts")
    line = F.concat(F.lit("["), F.date_format(ts, STAMP), F.lit("] [CONTAINER] "), F.coalesce("message", F.lit("")))
    return events.select(ts, "seq", line.alias("line"))


def recent_streams(events: DataFrame, limit: int = 10) -> DataFrame:
    """The streams with the latest events, newest first."""
    last = events.groupBy("stream").agg(F.max("ts").alias("last_ts"))
    return last.orderBy(F.desc("last_ts"), "stream").limit(limit)


def instance_of(stream: Column) -> Column:
    parts = F.split(stream, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def channel_of(stream: Column) -> Column:
    """stdout or stderr; null for streams that are neither (the instance still counts, its lines do not)."""
    return F.when(stream.contains("/stdout"), "stdout").when(stream.contains("/stderr"), "stderr")


def group_streams(events: DataFrame) -> DataFrame:
    """Rendered lines tagged with instance and channel, one row per event."""
    line = F.concat(F.lit("["), F.date_format("ts", STAMP), F.lit("] "), F.coalesce("message", F.lit("")))
    return events.select(
        instance_of(F.col("stream")).alias("instance_id"), channel_of(F.col("stream")).alias("channel"), "ts", "seq", line.alias("line")
    )


def instance_counts(grouped: DataFrame) -> DataFrame:
    """Lines per instance and channel; every instance with any event is present."""
    return grouped.groupBy("instance_id").agg(
        F.count_if(F.col("channel") == "stdout").alias("stdout_lines"), F.count_if(F.col("channel") == "stderr").alias("stderr_lines")
    )


def retention_filter(events: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Events young enough for their log group's ``policies(log_group, retention_days)``, 7 days where it has none."""
    days = F.coalesce("retention_days", F.lit(RETENTION_DAYS))
    joined = events.join(policies, "log_group", "left")
    return joined.filter(F.col("ts") >= F.timestamp_add("DAY", -days, now)).drop("retention_days")


def silent_gaps(events: DataFrame, threshold_s: int = HANG_SECONDS) -> DataFrame:
    """Gaps of more than ``threshold_s`` between neighbouring events of a stream.

    Slots as wide as the threshold cannot hide such a gap inside, so only first and last event per slot matter. They
    combine map-side; the window then sees one row per slot, however many events a hot stream has.
    """
    micros = F.unix_micros("ts")
    width = threshold_s * 1_000_000
    slots = events.groupBy("stream", F.floor(micros / width).alias("slot")).agg(F.min(micros).alias("first_us"), F.max(micros).alias("last_us"))
    before = F.lag("last_us").over(Window.partitionBy("stream").orderBy("slot"))
    gaps = slots.withColumn("before_us", before).filter(F.col("first_us") - F.col("before_us") > width)
    return gaps.select(
        "stream", "before_us", F.col("first_us").alias("after_us"), ((F.col("first_us") - F.col("before_us")) / 1e6).alias("gap_s")
    )


def first_crash(messages: DataFrame) -> DataFrame:
    """The earliest crash line per run from ``(run, ts, seq, message)``; filtered before anything moves."""
    from tipwatch.functions.text import first_alert_text, is_crash

    hits = messages.filter(is_crash(F.col("message")))
    first = F.min(F.struct("ts", "seq", first_alert_text(F.col("message")).alias("message"))).alias("m")
    return hits.groupBy("run").agg(first).select("run", "m.*")
