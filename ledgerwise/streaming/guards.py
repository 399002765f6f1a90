"""State with expiry: single-use tickets and a cache of values that grow old.

Keys are dealt to a fixed number of buckets by their hash, and a bucket's state is one row in Spark's state store, so a
batch costs a call for each bucket and not for each key. What a bucket holds of a key goes once the watermark has passed its
expiry, so what is kept is bounded by the keys of one time to live, not by all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A bucket's rows of one batch and its live keys are in a task's memory at once.
BUCKETS = 512


def _keep(state: GroupState, held: list[tuple]) -> None:
    """Keeps the rows (.., expiry in microseconds) whose expiry the watermark hasn't passed, as columns, until the last one has."""
    live = [row for row in held if row[-1] > state.getCurrentWatermarkMs() * 1000]
    if live:
        state.update(tuple(map(list, zip(*live, strict=True))))
        state.setTimeoutTimestamp(-(-max(row[-1] for row in live) // 1000))
    elif state.exists:
        state.remove()


def _held(state: GroupState) -> Iterator[tuple]:
    return zip(*state.get, strict=True) if state.exists else iter(())


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _bucket(*columns: str, buckets: int):
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("bucket")


def tickets(uses: DataFrame, ttl: float = 30, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """uses(ticket string, issued_at, use_id long, used_at) as a stream -> (use_id, ticket, used_at, verdict).

    verdict: `accepted` for a ticket's first use up to `ttl` seconds after it was issued, `used` for others until
    then, `expired` afterwards. First is by batch, then by time, ties by use_id. Uses later than the watermark are
    dropped by Spark; those of a ticket whose state has gone come after its expiry and are refused as expired.
    """
    life = round(ttl * 1_000_000)

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, verdicts = _in_order(frames, ["used", "use_id"]), []
        taken = {(ticket, issued): until for ticket, issued, until in _held(state)}
        for ticket, issued, used in zip(rows["ticket"], rows["issued"], rows["used"], strict=True):
            until = issued + life
            verdicts.append("expired" if used > until else "used" if (ticket, issued) in taken else "accepted")
            if used <= until:
                taken[ticket, issued] = until
        _keep(state, [(ticket, int(issued), int(until)) for (ticket, issued), until in taken.items()])
        yield rows.assign(verdict=verdicts)[["use_id", "ticket", "used", "verdict"]]

    rows = uses.withWatermark("used_at", late).select(
        _bucket("ticket", "issued_at", buckets=buckets), "ticket", F.unix_micros(F.col("issued_at").cast("timestamp")).alias("issued"), "use_id", "used_at", F.unix_micros(F.col("used_at").cast("timestamp")).alias("used"))
    found = rows.groupBy("bucket").applyInPandasWithState(
        judge, "use_id long, ticket string, used long, verdict string", "tickets array<string>, issued array<long>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("use_id", "ticket", F.timestamp_micros("used").alias("used_at"), "verdict")


def cached(asks: DataFrame, ttl: float = 300, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """asks(key long, ask_id long, at, kind, value double) as a stream -> (ask_id, key, value) for each `get`.

    kind: `set` keeps the value for `ttl` seconds in place of the one before, `delete` forgets it, `get` gives it, or
    null where there is none or it is older. In order of time within a batch, ties by ask_id.
    """
    life = round(ttl * 1_000_000)

    def serve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {k: (value, until) for k, value, until in _held(state)}
        rows, found = _in_order(frames, ["moment", "ask_id"]), []
        for k, ask_id, now, kind, value in zip(rows["key"], rows["ask_id"], rows["moment"], rows["kind"], rows["value"], strict=True):
            if kind == "set":
                held[k] = (float(value), int(now) + life)
            elif kind == "delete":
                held.pop(k, None)
            else:
                value, until = held.get(k, (None, now))
                found.append((ask_id, k, value if now <= until else None))
        _keep(state, [(k, *row) for k, row in held.items()])
        if found:
            yield pd.DataFrame(found, columns=["ask_id", "key", "value"]).astype({"value": "float64"})

    # keys as text, since pandas has no whole numbers beside nulls
    rows = asks.withWatermark("at", late).select(_bucket("key", buckets=buckets), F.col("key").cast("string").alias("key"), "ask_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("moment"), "kind", "value")
    found = rows.groupBy("bucket").applyInPandasWithState(
        serve, "ask_id long, key string, value double", "keys array<string>, held array<double>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("ask_id", F.col("key").cast("long").alias("key"), "value")


def expires(start: str, seconds: float):
    """When what began at `start` is too old."""
    return F.col(start) + F.make_dt_interval(secs=F.lit(float(seconds)))
