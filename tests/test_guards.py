"""Tickets, caches and deliveries, with replays, expiry, repeated batches and late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwise.streaming import delivery, feeds, guards

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, run):
    """What run(stream) gives for the batches, one file each, in order; also how many rows the state holds at the end."""
    path, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = feeds.event_stream(spark, path, spark.createDataFrame([], schema).schema)
    q = feeds.refresh(run(stream), lambda df, n: out.append([tuple(r) for r in df.collect()]), str(tmp_path / "progress"))
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return [r for rows in out for r in rows], held


def test_tickets(spark, tmp_path):
    schema = "ticket string, issued_at timestamp, use_id long, used_at timestamp"
    batches = [
        [("a", at(0), 1, at(5)), ("a", at(0), 2, at(4)), ("b", at(0), 3, at(31)), ("c", at(0), 4, at(30))],
        [("a", at(0), 5, at(20)), ("a", at(0), 6, at(40)), ("d", at(10), 7, at(12)), ("b", at(0), 8, at(32))],
        [("d", at(10), 9, at(39)), ("d", at(10), 10, at(41)), ("e", at(900), 11, at(901))],
        [("e", at(900), 12, at(902)), ("a", at(0), 13, at(890))],
    ]
    got, held = streamed(spark, tmp_path, batches, schema, lambda s: guards.tickets(s, 30, "60 seconds"))
    assert {r[0]: r[3] for r in got} == {
        1: "used", 2: "accepted", 3: "expired", 4: "accepted", 5: "used", 6: "expired", 7: "accepted", 8: "expired", 9: "used", 10: "expired", 11: "accepted", 12: "used", 13: "expired"}
    assert held[-1] == 1  # e alone; states of expired tickets have gone


def test_cache(spark, tmp_path):
    schema = "key long, ask_id long, at timestamp, kind string, value double"
    batches = [
        [(1, 1, at(0), "get", None), (1, 2, at(1), "set", 5.0), (1, 3, at(2), "get", None), (2, 4, at(3), "get", None)],
        [(1, 5, at(301), "get", None), (1, 6, at(302), "get", None), (2, 7, at(300), "set", 7.0), (3, 8, at(300), "set", 8.0), (3, 9, at(301), "delete", None)],
        [(2, 10, at(400), "set", 9.0), (2, 11, at(650), "get", None), (3, 12, at(310), "get", None), (2, 13, at(700), "get", None), (2, 14, at(701), "get", None)],
        [(4, 15, at(2000), "set", 1.0)], [(4, 16, at(2001), "get", None)],
    ]
    got, held = streamed(spark, tmp_path, batches, schema, lambda s: guards.cached(s, 300, "600 seconds"))
    assert {r[0]: r[2] for r in got} == {1: None, 3: 5.0, 4: None, 5: 5.0, 6: None, 11: 9.0, 12: None, 13: 9.0, 14: None, 16: 1.0}
    assert held[-1] == 1


SCHEMA = "flag_id long, created_at timestamp, severity int"


def alerts(spark, rows):
    return spark.createDataFrame([(i, at(t), i % 3) for i, t in rows], SCHEMA)


def test_a_repeated_batch_is_sent_once(spark, tmp_path):
    outbox, sent = delivery.Outbox(f"file://{tmp_path}/o"), []
    send = lambda df, n: sent.append((n, sorted(r["flag_id"] for r in df.collect())))
    one = alerts(spark, [(1, 0), (2, 10), (2, 10)])
    assert outbox.deliver(one, 0, send) and not outbox.deliver(one, 0, send)
    assert outbox.deliver(alerts(spark, [(2, 10), (3, 20)]), 1, send)
    assert sent == [(0, [1, 2]), (1, [3])]


def test_a_batch_that_failed_half_way_is_sent_as_it_was(spark, tmp_path):
    outbox, sent = delivery.Outbox(f"file://{tmp_path}/o"), []

    def broken(df, n):
        raise ConnectionError("receiver")

    send = lambda df, n: sent.append((n, sorted(r["flag_id"] for r in df.collect())))
    with pytest.raises(ConnectionError):
        outbox.deliver(alerts(spark, [(1, 0), (2, 10)]), 0, broken)
    # more rows have come in the meantime; the batch stays what it was
    assert outbox.deliver(alerts(spark, [(1, 0), (2, 10), (3, 5)]), 0, send)
    assert outbox.deliver(alerts(spark, [(1, 0), (2, 10), (3, 5)]), 1, send)
    assert sent == [(0, [1, 2]), (1, [3])]


def test_late_rows_and_heartbeats(spark, tmp_path):
    outbox, sent, beats = delivery.Outbox(f"file://{tmp_path}/o"), [], []
    send = lambda df, n: sent.append((n, sorted(r["flag_id"] for r in df.collect())))
    there = [(1, 0), (2, 100)]
    outbox.poll(alerts(spark, there), 0, at(-1), send, back="5 minutes")
    there += [(3, 90), (4, 400), (5, -250)]  # 3 and 5 are committed late
    outbox.poll(alerts(spark, there), 1, at(100), send, back="5 minutes")
    outbox.poll(alerts(spark, there), 2, at(500), send, back="5 minutes", heartbeat=beats.append)
    assert sent == [(0, [1, 2]), (1, [3, 4])] and beats == [2]
    outbox.poll(alerts(spark, there), 3, at(500), send, back="1 day", limit=1, order=["severity"])
    assert sent[-1] == (3, [5])


def test_a_stream_is_followed(spark, tmp_path):
    outbox, sent = delivery.Outbox(f"file://{tmp_path}/o"), []
    for k in range(3):
        alerts(spark, [(k * 10 + i, k * 100 + i) for i in range(5)] + [(0, 0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    outbox.follow(stream, lambda df, n: sent.extend(r["flag_id"] for r in df.collect()), str(tmp_path / "progress")).awaitTermination()
    assert sorted(sent) == sorted(k * 10 + i for k in range(3) for i in range(5))
    assert outbox.rows(spark, spark.createDataFrame([], SCHEMA).schema).where(F.col("batch") >= 0).count() == 15


def test_send_batches_of_worst_alerts(spark, tmp_path):
    """The feed of the worst and latest alerts, in the order of the feature."""
    alerts(spark, [(i, i) for i in range(40)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, sent = feeds.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), []
    feeds.send_batches(stream, lambda df, n: sent.extend(r["flag_id"] for r in df.collect()), lambda n: None, str(tmp_path / "progress"), limit=15).awaitTermination()
    want = sorted(range(40), key=lambda i: (i % 3, -i))[:15]
    assert sorted(sent) == sorted(want)


def test_many_keys_are_a_few_states(spark, tmp_path):
    """Thousands of tickets and keys in three batches: the verdicts of a walk over the rows, and no more states than buckets."""
    schema = "ticket string, issued_at timestamp, use_id long, used_at timestamp"
    batches = [[(f"t{(i * 7 + b) % 900}", at(((i * 7 + b) % 900) // 9), b * 2000 + i, at(b * 40 + (i * 13) % 60)) for i in range(2000)] for b in range(3)]
    got, held = streamed(spark, tmp_path / "t", batches, schema, lambda s: guards.tickets(s, 30, "1 hour", buckets=8))
    want, taken = {}, set()
    for rows in batches:
        for ticket, issued, use, used in sorted(rows, key=lambda r: (r[3], r[2])):
            ok = used <= issued + timedelta(seconds=30)
            want[use] = "expired" if not ok else "used" if ticket in taken else "accepted"
            taken |= {ticket} if ok else set()
    assert {r[0]: r[3] for r in got} == want and {r[0]: r[2] for r in got} == {r[2]: r[3] for rows in batches for r in rows}
    assert set(want.values()) == {"expired", "used", "accepted"} and 0 < max(held) <= 8

    schema = "key long, ask_id long, at timestamp, kind string, value double"
    kinds = ["get", "set", "get", "delete", "get"]
    batches = [[(None if i % 701 == 0 else 2**60 + i % 701, b * 2000 + i, at(b * 50 + (i * 11) % 70), kinds[i % 5], float(i)) for i in range(2000)] for b in range(3)]
    got, held = streamed(spark, tmp_path / "c", batches, schema, lambda s: guards.cached(s, 20, "1 hour", buckets=8))
    want, kept = {}, {}
    for rows in batches:
        for key, ask, now, kind, value in sorted(rows, key=lambda r: (r[2], r[1])):
            if kind == "get":
                value, until = kept.get(key, (None, now))
                want[ask] = (key, value if now <= until else None)
            elif kind == "set":
                kept[key] = (value, now + timedelta(seconds=20))
            else:
                kept.pop(key, None)
    assert {r[0]: r[1:] for r in got} == want and 0 < max(held) <= 8
    assert any(v is not None for _, v in want.values())
