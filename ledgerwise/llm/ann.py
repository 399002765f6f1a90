"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. A query walks the
pairs in the order of its summed distance to them, by the multi-sequence algorithm with a heap, until the
cells hold enough entries, and these are reranked by the exact distance. Centroids are fitted on a bounded
sample; every row is indexed. How many entries are enough is measured: the true neighbours of a bounded
sample of the queries are found by one scan of all entries, and the walk goes as far as it must to reach a
share of TARGET of them. With clusters that is a small part of the entries; vectors without structure need
more than half of them, whatever the index.

Entries are dealt to blocks by the first centroid, in parts of about BLOCK_ROWS, and a query is sent once to
each block it has a cell in, so a cell with a third of all rows is many tasks' work, and what is shuffled is
not a row for each candidate. A block is copied once for each QUERY_ROWS queries that walk into it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that the centroids are fitted on (those with the smallest hashes of their ids), and the most centroids of a half.
SAMPLE_ROWS, MOST_CENTROIDS = 20_000, 256
CELL_ROWS, BLOCK_ROWS, QUERY_ROWS = 50, 4096, 2048
#: Queries (with the smallest hashes of their ids) whose true neighbours are found by a scan, and the part of them that the walk must reach.
TRIAL_QUERIES, TARGET = 128, 0.96


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids, the same for the same rows; empty ones stay where they were."""
    centroids = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        n = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (i, j) with entries, by first[i] + second[j], until they hold `enough` entries or all are taken."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, found, held, total = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0, int(counts.sum())
    while heap and held < min(enough, total):
        _, p, q = heapq.heappop(heap)
        i, j = int(a[p]), int(b[q])
        if counts[i, j]:
            found.append((i, j))
            held += int(counts[i, j])
        for p2, q2 in ((p + 1, q), (p, q + 1)):
            if p2 < len(a) and q2 < len(b) and (p2, q2) not in pushed:
                pushed.add((p2, q2))
                heapq.heappush(heap, (first[a[p2]] + second[b[q2]], p2, q2))
    return found


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _index_task(known, dims: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = known.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1), dims)
                i, j = nearest(x[:, : dims // 2], one), nearest(x[:, dims // 2 :], two)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["vec_id", "vector", "i", "j"])

    return task


def _walk_task(known, dims: int, enough: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, counts = known.value
        for batch in batches:
            if not len(batch):
                continue
            row, firsts, seconds = [], [], []
            for n, x in enumerate(_matrix(batch.column(1), dims)):
                cells: dict[int, list[int]] = {}
                for i, j in walk(((one - x[: dims // 2]) ** 2).sum(axis=1), ((two - x[dims // 2 :]) ** 2).sum(axis=1), counts, enough):
                    cells.setdefault(i, []).append(j)
                row += [n] * len(cells)
                firsts += cells
                seconds += cells.values()
            taken = pa.array(row, pa.int64())
            yield pa.record_batch([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(firsts, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], ["query_id", "vector", "i", "js"])

    return task


def _trial_task(trial, dims: int, top: int):
    """(trial, score, vec_id, i, j): each trial query's nearest among the entries of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = trial.value
        best: list[np.ndarray] = [np.zeros((0, 4))] * len(names)
        for batch in batches:
            if len(batch):
                x, ids, i, j = _matrix(batch.column(1), dims), *(batch.column(c).to_numpy() for c in (0, 2, 3))
                for q, (name, vector) in enumerate(zip(names, asked, strict=True)):
                    score = ((x - vector) ** 2).sum(axis=1)
                    near = np.flatnonzero(ids != name)
                    near = near[np.argpartition(score[near], top - 1)[:top]] if len(near) > top else near
                    held = np.concatenate([best[q], np.column_stack([score[near], ids[near], i[near], j[near]])])
                    best[q] = held[np.argsort(held[:, 0], kind="stable")[:top]]
        found = np.concatenate(best) if best else np.zeros((0, 4))
        trial_of = np.repeat(np.arange(len(best)), [len(b) for b in best])
        yield pa.record_batch([pa.array(trial_of, pa.int32()), pa.array(found[:, 0]), *(pa.array(found[:, c].astype(np.int32)) for c in (2, 3))], ["trial", "score", "i", "j"])

    return task


def enough_entries(entries: DataFrame, asked: DataFrame, one: np.ndarray, two: np.ndarray, counts: np.ndarray, top: int, target: float) -> int:
    """Entries a query must rerank so that, of the true neighbours of TRIAL_QUERIES queries, a share of target is among them."""
    dims = one.shape[1] + two.shape[1]
    sample = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIAL_QUERIES).collect()
    if not sample:
        return 1
    x = np.array([r["vector"] for r in sample], np.float64)
    trial = asked.sparkSession.sparkContext.broadcast(([r["query_id"] for r in sample], x))
    near = entries.mapInArrow(_trial_task(trial, dims, top), "trial int, score double, i int, j int")
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("score", "i", "j"))
    near = near.withColumn("n", rank).where(F.col("n") <= top).collect()  # top rows for each trial query
    needs = []
    for q in range(len(x)):
        cells = walk(((one - x[q, : dims // 2]) ** 2).sum(axis=1), ((two - x[q, dims // 2 :]) ** 2).sum(axis=1), counts, int(counts.sum()))
        reach = dict(zip(cells, np.cumsum([counts[c] for c in cells]).tolist(), strict=True))
        needs += [reach[r["i"], r["j"]] for r in near if r["trial"] == q]
    return int(np.quantile(needs, target, method="higher")) if needs else 1


def _rerank(dims: int, top: int, cells: int):
    def block(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(entries) and len(queries):
            x, ids, j = _matrix(entries["vector"], dims), entries["vec_id"].to_numpy(), entries["j"].to_numpy()
            for query, vector, js in zip(queries["query_id"].to_pylist(), _matrix(queries["vector"], dims), queries["js"].to_pylist(), strict=True):
                open_ = np.zeros(cells, bool)
                open_[js] = True
                mine = np.flatnonzero(open_[j] & (ids != query))
                score = np.sqrt(((x[mine] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[mine], score))[:top]
                for have, more in zip(out, ([query] * len(best), ids[mine][best], score[best]), strict=True):
                    have.extend(more)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return block


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    double = vector.cast("array<double>")
    bad = F.exists(double, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(double, lambda v: v != 0), F.lit(False))


def search(table: DataFrame, queries: DataFrame, top: int = 10, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """table, queries -> (query_id, rank, vec_id, score): each query's `top` nearest of table by Euclidean distance.

    A query reranks as many entries as a trial (see enough_entries) needed for a recall of `target`, and at least
    `top` of them. Rows of the query's own id are no candidates. Ties go to the smaller id. Unusable vectors
    (null, zero, with null or non-finite components), null ids and vectors of another length than most have
    take no part; a query with fewer candidates than `top` gets all of them; no vectors give no rows.
    Repeated rows are candidates as often; other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]
    rows = rows.where(F.size("vector") == dims)
    sample = rows.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    x = np.array([r[0] for r in sample], np.float64)
    k = int(min(MOST_CENTROIDS, max(2, 2 ** round(np.log2(max(1.0, total / CELL_ROWS)) / 2)), len(x)))
    one, two = kmeans(x[:, : dims // 2], k), kmeans(x[:, dims // 2 :], k)
    kind = rows.schema["vector"].dataType.simpleString()
    codes = spark.sparkContext.broadcast((one, two))
    entries = written(rows.mapInArrow(_index_task(codes, dims), f"vec_id long, vector {kind}, i int, j int"), "entries")
    counts = np.zeros((len(one), len(two)), np.int64)
    for i, j, n in entries.groupBy("i", "j").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        counts[i, j] = n

    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == dims))
    enough = max(2 * top, enough_entries(entries, asked, one, two, counts, top, target))
    index = spark.sparkContext.broadcast((one, two, counts))
    probes = written(asked.mapInArrow(_walk_task(index, dims, enough), f"query_id long, vector {kind}, i int, js array<int>"), "probes")
    walked = {r["i"]: r["count"] for r in probes.groupBy("i").count().collect()}  # at most MOST_CENTROIDS rows
    each = lambda sizes, most: F.get(F.array(*(F.lit(-(-int(n) // most)) for n in sizes)), F.col("i"))
    salt, part = each(counts.sum(axis=1), BLOCK_ROWS), each([walked.get(i, 0) for i in range(len(one))], QUERY_ROWS)
    probes = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), part).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1)))
    spread = entries.where(part > 0).withColumn("salt", F.pmod(F.xxhash64("vec_id"), salt).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), part - 1)))
    near = spread.groupBy("i", "salt", "part").cogroup(probes.groupBy("i", "salt", "part")).applyInArrow(_rerank(dims, top, len(two)), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
