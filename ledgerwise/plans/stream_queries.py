"""Queries over streams: each reads its source to the end in micro-batches, and is held against SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.staging import new_path
from ..streaming import feeds
from .registry import ALERTS, PEOPLE, fixtures, query


def _events(spark, d: str, path: str | None = None) -> DataFrame:
    """The alerts as a stream; a pattern, since a stream's path can't be a single file."""
    return fixtures.alerts(feeds.event_stream(spark, path or f"{d}/events*.parquet", fixtures.table(spark, d, "events").schema))


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read, with the number of its batch; a batch that is run again replaces itself."""
    out = new_path(stream.sparkSession, "stream")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    feeds.refresh(stream, batch, new_path(stream.sparkSession, "progress"), mode).awaitTermination()
    return stream.sparkSession.read.schema(StructType(list(stream.schema)).add("batch", IntegerType())).parquet(out)


@query(f"WITH {ALERTS}, {PEOPLE} SELECT flag_id, npi, severity, name, state FROM alerts JOIN people USING (npi) WHERE severity <= 2 AND state IN ('NATION_1', 'NATION_2', 'NATION_3')")
def streamed_alerts(spark, d):
    out = feeds.live_alerts(_events(spark, d), fixtures.people(spark, d), access=["NATION_1", "NATION_2", "NATION_3"])
    return _drained(out.select("flag_id", "npi", "severity", "name", "state")).drop("batch")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS start, event_type AS flag_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    found = _drained(feeds.tumbling(_events(spark, d), "1 day", late="60 days"), "update")
    # a window that later batches add to is given again
    last = F.row_number().over(Window.partitionBy("start", "flag_type").orderBy(F.desc("batch")))
    found = found.withColumn("last", last).where("last = 1")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "flag_type", "n", F.round("total", 2).alias("total"))


@query(f"WITH {ALERTS} SELECT flag_id, npi, flag_type FROM alerts")
def streamed_replays(spark, d):
    events, path = fixtures.table(spark, d, "events"), new_path(spark, "replayed")
    events.unionByName(events).write.parquet(path)  # every event comes twice
    return _drained(feeds.once(_events(spark, d, path), ["flag_id"], "60 days").select("flag_id", "npi", "flag_type")).drop("batch")


@query("""WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS npi, o_orderdate AS opened FROM orders), e AS (SELECT user_id AS npi, count(*) AS news FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT case_id, npi, coalesce(news, 0) AS news FROM c LEFT JOIN e USING (npi) WHERE opened >= DATE '1998-01-01'""")
def streamed_sweep(spark, d):
    """The nightly sweep: each batch's news is counted by provider, and the open cases are joined with the counts of all batches."""
    news = _events(spark, d).where("flag_type = 'error'").select("flag_id", "npi")
    counts = _drained(news).groupBy("npi").agg(F.count("*").alias("news"))
    cases = fixtures.table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")).select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("npi"))
    return cases.join(counts, "npi", "left").select("case_id", "npi", F.coalesce("news", F.lit(0)).cast("long").alias("news"))
