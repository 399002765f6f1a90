"""Structured Streaming feeds: live alerts, windows, sessions, replay guards, timed refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def since(events: DataFrame, started, back: str = "5 minutes") -> DataFrame:
    """What was created after a feed's start, less the time that a new listener looks back."""
    return events.where(F.col("created_at") > F.lit(started).cast("timestamp") - F.expr(f"INTERVAL {back}"))


def live_alerts(alerts: DataFrame, people: DataFrame, worst: int = 2, access: list[str] = ()) -> DataFrame:
    """A stream of alerts joined to the providers' table; each row once, whatever the timing."""
    out = alerts.where(F.col("severity") <= worst).join(people.select("npi", "name", "state"), "npi")
    return out.where(F.col("state").isin(list(access))) if access else out


def send_batches(stream: DataFrame, send: Callable[[DataFrame, int], None], heartbeat: Callable[[int], None], checkpoint: str, limit: int = 15) -> StreamingQuery:
    """Each batch's worst and latest alerts, or a heartbeat if there is none, until the source is read."""

    def batch(df: DataFrame, number: int) -> None:
        top = df.orderBy("severity", F.desc("created_at"), "flag_id").limit(limit)
        if top.isEmpty():
            heartbeat(number)
        else:
            send(top, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts per window; with a watermark on a stream."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    out = rows.groupBy(F.window("created_at", width).alias("w"), "flag_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "flag_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("created_at", gap).alias("w"), "npi").agg(F.count("*").alias("n"))
    return out.select("npi", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Replays within the watermark go; single-use tickets."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What has come in since the last run, applied once: the timed list refresh and the nightly sweep."""
    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
