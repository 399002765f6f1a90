"""Alerts delivered once: an outbox that knows each batch, and a look-back for rows that were committed late.

A batch is first written to the outbox, then sent, then marked as sent. A batch that comes again (Spark repeats the last
one after a failure) isn't chosen anew: a marked one is left alone, and one that was written but not marked is sent again as
it is, with the same number, so its receiver can tell. Rows that another batch has in the outbox aren't sent again, so a
poll may look back past its start as far as it likes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Send = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Outbox:
    """Sent batches under `path`, a folder that driver and executors share; rows are told by `key`."""

    path: str
    key: str = "flag_id"
    stamp: str = "created_at"

    def _there(self, spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def is_sent(self, spark: SparkSession, number: int) -> bool:
        return self._there(spark, f"sent/{number}/_SUCCESS")

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """All rows of the outbox, with their batch; none if nothing has been written."""
        if not self._there(spark, "rows"):
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/batch=*").withColumn("batch", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("int"))

    def deliver(self, rows: DataFrame, number: int, send: Send, heartbeat: Callable[[int], None] | None = None, limit: int | None = None, order: list | None = None) -> bool:
        """Sends what of these rows no other batch has; False if this batch had been sent before.

        limit and order are the feature's own, for feeds that give the worst alerts only; what a batch leaves out isn't
        in the outbox and may be sent by a later one. A batch without new rows calls `heartbeat`.
        """
        spark = rows.sparkSession
        if self.is_sent(spark, number):
            return False
        own = f"{self.path}/rows/batch={number}"
        if not self._there(spark, f"rows/batch={number}/_SUCCESS"):
            known = self.rows(spark, rows.schema).where(F.col("batch") != number)
            # rows that could be known were stamped no earlier than the oldest of these
            oldest = rows.agg(F.min(self.stamp).alias("t")).first()["t"]
            if oldest is not None:
                known = known.where(F.col(self.stamp) >= F.lit(oldest))
            fresh = rows.join(known.select(self.key).distinct(), self.key, "left_anti").dropDuplicates([self.key])
            if limit is not None:
                fresh = fresh.orderBy(*(order or [self.stamp]), self.key).limit(limit)
            fresh.select(*rows.columns).write.mode("overwrite").parquet(own)
        batch = spark.read.schema(rows.schema).parquet(own)
        if heartbeat is not None and batch.isEmpty():
            heartbeat(number)
        else:
            send(batch, number)
        spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{self.path}/sent/{number}")
        return True

    def poll(self, alerts: DataFrame, number: int, since, send: Send, back: str = "5 minutes", **more) -> bool:
        """One poll of a table: what was stamped after `since` less the look-back, and hasn't been sent yet."""
        recent = alerts.where(F.col(self.stamp) > F.lit(since).cast("timestamp") - F.expr(f"INTERVAL {back}"))
        return self.deliver(recent, number, send, **more)

    def follow(self, stream: DataFrame, send: Send, checkpoint: str, **more) -> StreamingQuery:
        """Each batch of a stream, until its source is read."""
        return stream.writeStream.foreachBatch(lambda df, n: self.deliver(df, n, send, **more)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
