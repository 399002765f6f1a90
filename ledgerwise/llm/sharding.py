"""Balanced label propagation: documents drift to the shards of what they link to, within quotas.

Native DataFrame code only. Every document begins in a shard of its own, by a hash of its id. In each round
the nodes that come before all their neighbours (by an order drawn anew) ask for the shard most neighbours
are in; no two of them are linked, so a move never cuts more links than it mends. A shard takes what its
quota leaves room for, and what others that leave it make room for. Rounds are joins on small rows
(id, label); texts are never shuffled.

While documents drift, a shard may hold (1 + slack) times its share. A last, exact step orders them by
(label, cluster, id) and cuts the order into equal parts, so that counts differ by one at most whatever
the links are, and only what lies at the parts' ends is torn apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

#: Cells of the distributed prefix sum: the table of bucket totals has shards * BUCKETS rows.
BUCKETS = 256
#: Rows of one cluster that a task numbers, about; there are SALTS parts at least.
PART_ROWS, SALTS = 1 << 19, 64
#: Bits of a draw, and the degree from which on nodes aren't told apart by it.
DRAW_BITS, MOST_DEGREE = 40, 1 << 20


def shares(moves: list[tuple[int, int, int]], load: dict[int, int], quota: float) -> dict[int, float]:
    """moves (from, to, n) -> the part of its askers that each shard takes, from counts of shards alone.

    A shard may fill up to its quota; those who leave it make room, as far as others take them. Shares only
    fall from 1, until none does.
    """
    asked: dict[int, int] = {}
    for _, to, n in moves:
        asked[to] = asked.get(to, 0) + n
    part = dict.fromkeys(asked, 1.0)
    for _ in range(100):
        gone: dict[int, float] = {}
        for at, to, n in moves:
            gone[at] = gone.get(at, 0.0) + n * part[to]
        now = {to: min(part[to], max(0.0, (quota - load.get(to, 0) + gone.get(to, 0.0)) / n)) for to, n in asked.items()}
        if all(part[to] - now[to] < 1e-6 for to in now):
            return now
        part = now
    return part


def propagate(nodes: DataFrame, links: DataFrame, shards: int = 16, rounds: int = 4, slack: float = 1.0) -> DataFrame:
    """nodes(id[, start]), links(src, dst) -> (id, cluster, label), one row per distinct id.

    cluster is the smallest id among a node and its neighbours. Labels begin at `start`, a shard, or where that
    is null or not there at a hash of the id. In even rounds nodes with few links come before their
    neighbours, ties by a hash of id and round; in odd ones the hash decides alone. Askers want the
    label most of their neighbours have, ties to the smaller label; which of them a shard takes is drawn
    by a hash. A null id is a node without links; links to unknown ids and self links are ignored;
    repeated links count once; no nodes give no rows.
    """
    start = F.min("start") if "start" in nodes.columns else F.lit(None).cast("int")
    ids = nodes.groupBy("id").agg(start.alias("start"))
    both = links.select("src", "dst").where("src <> dst").distinct()
    both = written(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    near = both.groupBy("src").agg(F.min("dst").alias("near"), F.count("*").alias("degree"))
    label = F.coalesce("start", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    state = ids.join(near, ids.id == near.src, "left").select("id", F.least(F.col("id"), F.coalesce("near", "id")).alias("cluster"), F.coalesce("degree", F.lit(0)).alias("degree"), label.alias("label"))
    state = written(state, "labels")
    quota = -(-state.count() // shards) * (1 + slack)
    for turn in range(rounds):
        drawn = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 64 - DRAW_BITS)
        few = F.lit(MOST_DEGREE) - F.least("degree", F.lit(MOST_DEGREE))
        first = (F.shiftleft(few, DRAW_BITS) + drawn if turn % 2 == 0 else drawn).alias("first")
        around = both.join(state.select(F.col("id").alias("dst"), "label", first), "dst")
        votes = around.groupBy("src", "label").agg(F.count("*").alias("votes"), F.max("first").alias("rival"))
        want = votes.groupBy("src").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("want"), F.max("rival").alias("rival"))
        asked = state.select("id", "cluster", "degree", "label", first).join(want, state.id == want.src, "left")
        goes = (F.col("first") > F.col("rival")) & (F.col("want") != F.col("label"))
        asked = written(asked.select("id", "cluster", "degree", "label", F.when(goes, F.col("want")).alias("want")), "asked")
        # a row for each pair of shards
        counts = asked.groupBy("label", "want").count().collect()
        load: dict[int, int] = {}
        for r in counts:
            load[r["label"]] = load.get(r["label"], 0) + r["count"]
        moves = [(r["label"], r["want"], r["count"]) for r in counts if r["want"] is not None]
        taken = shares(moves, load, quota)
        share = F.coalesce(F.get(F.array(*(F.lit(float(taken.get(s, 0.0))) for s in range(shards))), F.col("want")), F.lit(0.0))
        draw = F.pmod(F.xxhash64("id", F.lit(turn), F.lit("quota")), F.lit(1 << 20)) / float(1 << 20)
        after = written(asked.withColumn("label", F.when(draw < share, F.col("want")).otherwise(F.col("label"))).drop("want"), "labels")
        dropped(state, asked)
        state = after
        if not moves:
            break
    dropped(both)
    return state.select("id", "cluster", "label")


def cut_evenly(rows: DataFrame, total: int, shards: int = 16) -> DataFrame:
    """rows(id, uid, cluster, label, ...) -> with shard and slot: positions in (label, cluster, id) order, cut into equal parts.

    uid tells all rows apart, those of one id or of a null one, too. Positions come from a two-level prefix sum:
    counts of (label, cluster, salt) cells, summed within hash buckets, and bucket totals (shards * BUCKETS
    rows). The salt, drawn from uid, splits a hot cluster into parts of about PART_ROWS rows.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(max(SALTS, total // PART_ROWS))).cast("int"))
    keys = ["label", "cluster", "salt"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(BUCKETS)).cast("int"))
    cells = written(cells, "cells")
    totals = cells.groupBy("label", "bucket").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("label", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("label", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inner = Window.partitionBy("label", "bucket").orderBy("cluster", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(totals, ["label", "bucket"])
    starts = starts.select(*(F.col(k).alias(f"c_{k}") for k in keys), (F.col("base") + F.col("inner")).alias("start"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("id", "uid")) - 1)
    same = [placed[k].eqNullSafe(starts[f"c_{k}"]) for k in keys]
    placed = placed.join(starts, same[0] & same[1] & same[2]).withColumn("position", F.col("start") + F.col("rank"))
    if not total:
        return placed.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    exact = F.expr(f"CAST(position * {shards} div {total} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards} - 1) div {shards}")
    return placed.withColumn("shard", exact).withColumn("slot", F.col("position") - first)


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), law `rows`.

    Links join equal texts (a null text is an empty one) in a star around the smallest id. A text with more rows
    than a shard has is several stars, dealt by a hash of the id, whose hubs begin in different shards; those that
    have gathered are laid end to end. Row counts of shards differ by one at most. Repeated rows and repeated or
    null ids each keep their own slot; an empty table gives an empty result; texts of any length count by their
    hashes; other columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_key"))
    rows = written(rows, "rows")
    total = rows.count()
    most = max(2, -(-total // shards))
    groups = rows.groupBy("text_key").agg(F.min("id").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = groups.withColumn("stars", F.when(F.col("n") > most, F.ceil(F.col("n") * 4 / (3 * most))).otherwise(1).cast("int"))  # leaves room for others
    groups = written(groups.select("text_key", "top", "stars"), "groups")  # Spark splits a hot text's partition only in a join of two exchanges
    stars = rows.where("id IS NOT NULL").join(groups, "text_key").select("id", "text_key", "top", "stars", F.pmod(F.xxhash64("id", F.lit("star")), F.col("stars")).cast("int").alias("star"))
    stars = written(stars, "stars")
    hubs = written(stars.groupBy("text_key", "star").agg(F.min("id").alias("hub"), F.min("top").alias("top"), F.min("stars").alias("stars")), "hubs")
    links = stars.select("id", "text_key", "star").join(hubs, ["text_key", "star"]).select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    # texts with more rows than a shard: shards of them at most, so there are no more than 7 / 3 * shards such stars
    large = written(hubs.where("stars > 1").withColumn("start", F.pmod(F.xxhash64("text_key") + F.col("star"), F.lit(shards)).cast("int")), "large")
    begin = large.groupBy(F.col("hub").alias("at")).agg(F.min("start").alias("start"))
    nodes = rows.select("id").join(F.broadcast(begin), F.col("id") == F.col("at"), "left").select("id", "start")
    state = propagate(nodes, links, shards, rounds)
    there = state.join(F.broadcast(large), state.id == large.hub).select("hub", "text_key", "top", state.label.alias("hub_label"))
    first = there.where("hub = top").select("text_key", F.col("hub_label").alias("home"))
    there = there.join(F.broadcast(first), "text_key").groupBy("hub").agg(F.min("hub_label").alias("hub_label"), F.min("home").alias("home"), F.min("top").alias("top"))
    laid = state.join(F.broadcast(there), (state.cluster == there.hub) & (state.label == there.hub_label), "left")
    state = laid.select(F.col("id").alias("node"), F.coalesce("top", "cluster").alias("cluster"), F.coalesce("home", "label").alias("label"))
    labelled = rows.select("id", "uid", "size", "text_crc32").join(state, rows.id.eqNullSafe(state.node)).drop("node")
    out = cut_evenly(labelled, total, shards)
    dropped(groups, stars, hubs)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
