"""The incremental forms of discovery, funnels, utterances and job states, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.streaming.job_states import read as read_states  # noqa: F401
from cuefold.streaming.job_states import upsert as upsert_states  # noqa: F401


def discovery(hits: DataFrame, delay: str = "72 hours") -> DataFrame:
    """A stream of hits (video_id, query_group, mode, ts, ...) with each request's hit on a video once; state is dropped with the watermark. `requests.resumable` has the rules of whole requests."""
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "query_group", "mode"])


def daily_funnel(events: DataFrame, delay: str = "72 hours", length: str = "1 day", slide: str | None = None) -> DataFrame:
    """(day_start, event_type, n, value): counts by day, or by a window that slides; rows later than the delay are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("day_start"), "event_type", "n", "value")


def late_rows(events: DataFrame, now, hours: float = 72) -> DataFrame:
    """The rows that the funnel drops, with the reason."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    return events.where(age > hours).withColumn("reason", F.lit("outside_age_window"))


def utterances(rows: DataFrame, keys: list[str], pause: float, delay: str = "1 hour") -> DataFrame:
    """(keys, first, last, n) of rows (keys, ts, seconds): a new utterance begins where the pause since the end of the one before exceeds `pause` seconds."""
    text = F.concat(F.round((F.col("seconds") + pause) * 1000).cast("bigint").cast("string"), F.lit(" milliseconds"))
    streamed = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    out = streamed.groupBy(*keys, F.session_window("ts", text).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.drop("w")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives its rows."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

