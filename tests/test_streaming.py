"""Streams over files: alerts, heartbeat, windows, replays."""

from pyspark.sql import functions as F

from ledgerwise.plans import fixtures
from ledgerwise.streaming import feeds

SF = "/root/testdata/sf0.001"


def stream(spark, path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    return fixtures.alerts(feeds.event_stream(spark, path, events.schema))


def write(spark, path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(path)


def test_live_alerts_and_heartbeat(spark, tmp_path):
    write(spark, str(tmp_path / "in"))
    people = fixtures.people(spark, SF)
    sent, beats = [], []
    q = feeds.send_batches(feeds.live_alerts(stream(spark, str(tmp_path / "in")), people), lambda df, n: sent.append(df.collect()), beats.append, str(tmp_path / "c"))
    q.awaitTermination()
    assert sent and all(len(x) <= 15 and all(r.severity <= 2 for r in x) for x in sent)
    quiet = feeds.live_alerts(stream(spark, str(tmp_path / "in")), people, worst=0)
    feeds.send_batches(quiet, lambda df, n: sent.append(None), beats.append, str(tmp_path / "c2")).awaitTermination()
    assert beats and None not in sent


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    write(spark, str(tmp_path / "in"))
    batch = feeds.tumbling(fixtures.alerts(spark.read.parquet(f"{SF}/events.parquet")))
    q = feeds.tumbling(stream(spark, str(tmp_path / "in")), late="60 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.flag_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)


def test_replays_go(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events).repartition(2).write.parquet(str(tmp_path / "in"))
    got = []
    feeds.refresh(feeds.once(stream(spark, str(tmp_path / "in")), ["flag_id"], "60 days"), lambda df, n: got.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(got) == events.count()


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 04:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "npi long, t string").select("npi", F.col("t").cast("timestamp").alias("created_at"))
    assert sorted((r.npi, r.n) for r in feeds.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
