"""Shapley values of a fitted ensemble of trees: what each feature adds to a row's margin.

A tree's value for a set of known features is the mean over its leaves, where a known feature follows its cut and an unknown
one goes both ways, by the training weight of either side. Of one leaf this is a product over the features on its path
of 1 or 0 (do the row's value and the cuts agree?) for known ones and a part of the weight for unknown ones. So its Shapley
values depend only on which features agree: they are tabled for all patterns of a path, and a row looks its pattern up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import new_path


@dataclass(frozen=True)
class Leaves:
    """A tree's leaves: value (times the tree's weight); of each feature on a path its number, bounds (low, high] and weight's part."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    part: np.ndarray

    @property
    def base(self) -> float:
        return float((self.value * self.part.prod(axis=1)).sum())


def leaves_of(nodes: list[dict], weight: float = 1.0) -> Leaves:
    """nodes: rows by id with left, right (-1 for leaves), feature, threshold (left if not above it), value and cover."""
    found, waiting = [], [(0, {})]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        if node["left"] < 0:
            found.append((node["value"] * weight, path))
            continue
        for child, below in ((node["left"], True), (node["right"], False)):
            low, high, part = path.get(node["feature"], (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, node["threshold"])) if below else (max(low, node["threshold"]), high)
            waiting.append((child, path | {node["feature"]: (low, high, part * nodes[child]["cover"] / node["cover"])}))
    width = max(1, *(len(path) for _, path in found))
    out = [np.array([v for v, _ in found]), np.zeros((len(found), width), int), np.full((len(found), width), -np.inf), np.full((len(found), width), np.inf), np.ones((len(found), width))]
    for i, (_, path) in enumerate(found):  # shorter paths are filled with features that agree with everything, which changes nothing
        for j, (f, (low, high, part)) in enumerate(path.items()):
            out[1][i, j], out[2][i, j], out[3][i, j], out[4][i, j] = f, low, high, part
    return Leaves(*out)


def _table(leaves: Leaves) -> np.ndarray:
    """(leaves, patterns, places): Shapley values of each place of a path for each pattern of agreeing places."""
    n, m = leaves.part.shape
    agrees = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)  # (patterns, places)
    out = np.empty((n, 1 << m, m))
    share = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    for i in range(m):
        known = np.zeros((n, 1 << m, m))  # by number of known ones among the others: the sum of their products
        known[:, :, 0] = 1
        for j in range(m):
            if j != i:
                more = np.concatenate([np.zeros((n, 1 << m, 1)), known[:, :, :-1] * agrees[None, :, j, None]], axis=2)
                known = known * leaves.part[:, None, j, None] + more
        out[:, :, i] = leaves.value[:, None] * (agrees[None, :, i] - leaves.part[:, None, i]) * (known @ share)
    return out


def values_of(trees: list[Leaves], x: np.ndarray) -> np.ndarray:
    """(rows, features) -> Shapley values of the same shape; each row's sum is its margin less the trees' bases."""
    out = np.zeros_like(x, dtype=float)
    for leaves in trees:
        n, m = leaves.part.shape
        table, rows = _table(leaves), np.arange(len(x))
        for leaf in range(n):
            mine = x[:, leaves.feature[leaf]]
            pattern = ((mine > leaves.low[leaf]) & (mine <= leaves.high[leaf])) @ (1 << np.arange(m))
            found = table[leaf][pattern]
            for j in range(m):
                if leaves.part[leaf, j] < 1 or np.isfinite(leaves.low[leaf, j]) or np.isfinite(leaves.high[leaf, j]):
                    out[rows, leaves.feature[leaf, j]] += found[:, j]
    return out


def trees_of(model, spark) -> list[Leaves]:
    """The trees of a fitted tree ensemble of Spark ML, as it saves them; a row for each node, bounded by rounds and depth."""
    path = new_path(spark, "model")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    cover = F.col("n.rawCount").cast("double")
    rows = saved.select("treeID", F.col("nodeData").alias("n")).select(
        "treeID", "n.id", F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("n.prediction").alias("value"), cover.alias("cover")).orderBy("treeID", "id").collect()
    trees: dict[int, list[dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r.asDict())
    return [leaves_of(nodes, weight) for nodes, weight in zip((trees[t] for t in sorted(trees)), model.treeWeights, strict=True)]


def attributions(rows: DataFrame, trees: list[Leaves], columns: list[str], features: str = "x", key: str = "npi", n: int = 3) -> DataFrame:
    """rows(key, features array<double> in the order of columns) -> (key, base, margin, top, values).

    values: feature -> Shapley value; with the base they sum to the margin. top: the n largest by size, ties by name. The
    trees are broadcast; rows are judged in Arrow batches, without a shuffle.
    """
    spark = rows.sparkSession
    known, base = spark.sparkContext.broadcast(trees), float(sum(t.base for t in trees))
    width = len(columns)

    @F.pandas_udf("array<double>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.stack(part.to_numpy()).astype(float) if len(part) else np.zeros((0, width))
            yield pd.Series(list(values_of(known.value, x)))

    found = rows.select(key, judged(features).alias("_v"))
    each = F.transform(F.arrays_zip(F.array(*map(F.lit, columns)).alias("name"), F.col("_v").alias("v")), lambda p: F.struct((-F.abs(p["v"])).alias("s"), p["name"].alias("name"), p["v"].alias("v")))
    best = F.array_sort(each)
    return found.select(
        key, F.lit(base).alias("base"), (F.aggregate("_v", F.lit(0.0), lambda a, b: a + b) + base).alias("margin"),
        F.transform(F.slice(best, 1, n), lambda p: p["name"]).alias("top"), F.map_from_entries(F.transform(best, lambda p: F.struct(p["name"], p["v"]))).alias("values"))
