"""Model scores: isolation forest, boosted trees, reconstruction error, attributions.

Spark ML has no isolation forest. The forest is built here: each tree is grown in a task of its own from a sample of
all rows, and all trees are walked level by level inside a pandas UDF. Reconstruction error comes from principal
components here, and from a fitted net in autoencoder.py. Attributions here are the change of the fitted model's
score with a feature at its median; Shapley values are in shapley.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles
from .scoring import class_balance, ordinal_rank


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """features: median and interquartile range at 0 and 1; columns without spread become 0."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep").transform(df)
    return RobustScaler(inputCol="_raw", outputCol="features", withCentering=True).fit(vectors).transform(vectors).drop("_raw")


def robust(df: DataFrame, columns: list[str], out: str = "x") -> DataFrame:
    """df with `out`: the columns as an array, less their medians, in interquartile ranges; 0 for nulls and for columns without spread.

    The quantiles are exact: of counted ranges, so a column of any length fits.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("e")).select("e.*")
    found = percentiles(long, ["i"], "v", [0.25, 0.5, 0.75]).collect()  # a row for each column
    of = {r["i"]: r["p"] for r in found}
    parts = []
    for i, c in enumerate(columns):
        low, middle, high = of.get(i, (0.0, 0.0, 0.0))
        parts.append(F.coalesce((F.col(c).cast("double") - middle) / (high - low), F.lit(0.0)) if high > low else F.lit(0.0))
    return df.withColumn(out, F.array(*parts))


def grow(x: np.ndarray, features: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[list, list, list, list]:
    """A tree of random cuts as arrays (feature, cut, left child, path length of a leaf); the right child follows the left one."""
    feature, cut, child, length = [-1], [0.0], [0], [0.0]
    waiting = [(0, x, 0)]
    while waiting:
        node, rows, at = waiting.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_ = [f for f in features if high[f] > low[f]]
        if at == depth or len(rows) <= 1 or not open_:
            length[node] = at + _c(len(rows))
            continue
        f = int(rng.choice(open_))
        feature[node], cut[node], child[node] = f, float(rng.uniform(low[f], high[f])), len(feature)
        left = rows[:, f] < cut[node]
        for side in (left, ~left):
            waiting.append((len(feature), rows[side], at + 1))
            for have, empty in zip((feature, cut, child, length), (-1, 0.0, 0, 0.0), strict=True):
                have.append(empty)
    return feature, cut, child, length


def _c(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _lengths(tree: tuple, x: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, child, length = tree
    node = np.zeros(len(x), int)
    for _ in range(depth):
        f = feature[node]
        right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[node]
        node = np.where(f >= 0, child[node] + right, node)
    return length[node]


def isolation_scores(df: DataFrame, columns: list[str], key: str = "npi", trees: int = 100, seed: int = 42, tree_rows: int = 256, features: float = 0.8, contamination: float = 0.02) -> DataFrame:
    """df with isolation (0 to 1, larger is odder), isolation_rank (rank / n, ties by key) and is_outlier (the oddest part).

    The trees * tree_rows rows with the smallest hashes of their key, a bound given by these two parameters, are dealt to the
    trees, so each tree has a sample of all rows without replacement (fewer, if there are fewer). Each tree cuts a part
    `features` of the columns, drawn for it. Cuts are uniform between a feature's least and largest value, so scaling
    the columns changes nothing. Nulls count as 0.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    pool = df.select(F.xxhash64(key, F.lit(seed)).alias("h"), F.col(key).alias("k"), *x).orderBy("h", "k").limit(trees * tree_rows)
    total = df.count()
    held = min(total, trees * tree_rows)
    rows = min(tree_rows, held)
    depth = int(np.ceil(np.log2(max(2, rows))))
    dealt = max(1, held // max(1, rows))  # as many trees as the rows are enough for; the others take the samples again with other cuts
    n = F.row_number().over(Window.orderBy("h", "k"))  # of the pool only
    pool = pool.withColumn("n", n).withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: t % dealt == F.col("n") % dealt)))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = part.sort_values("n")[[f"x{i}" for i in range(len(columns))]].to_numpy(float)[:rows]
        some = rng.choice(len(columns), max(1, round(features * len(columns))), replace=False)
        return pd.DataFrame([[tree, *grow(data, some, rng, depth)]], columns=["tree", "feature", "cut", "child", "length"])

    grown = pool.groupBy("tree").applyInPandas(one, "tree int, feature array<int>, cut array<double>, child array<int>, length array<double>").orderBy("tree").collect()  # 2 * tree_rows nodes for each tree at most
    forest = [tuple(np.array(t[c]) for c in ("feature", "cut", "child", "length")) for t in grown]
    known = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in parts:
            data = np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols])
            mean = np.mean([_lengths(t, data, depth) for t in known.value], axis=0) if known.value else np.zeros(len(data))
            yield pd.Series(2 ** (-mean / max(_c(rows), 1e-9)))

    out = df.withColumn("isolation", F.round(score(*(F.col(c).cast("double") for c in columns)), 10))
    out = ordinal_rank(out, ["isolation", key], "_r").withColumn("isolation_rank", F.col("_r") / total)
    return out.withColumn("is_outlier", F.col("isolation_rank") > 1 - contamination).drop("_r")


def boosted_model(df: DataFrame, columns: list[str], rounds: int = 400, depth: int = 6, step: float = 0.05, seed: int = 42, features: float = 0.8, train: Column | None = None):
    """(df(label, weight) with scaled features, the fitted trees); the weight carries the class balance.

    Each tree sees eight tenths of the rows, each of its cuts a part `features` of the columns. train: the rows to fit on (all
    by default); scaling and balance are of these, so rows that are held out teach nothing.
    """
    fit_on = df if train is None else df.where(train)
    scale = class_balance(fit_on).first()[0]
    vectors = lambda x: VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep").transform(x)
    scaler = RobustScaler(inputCol="_raw", outputCol="features", withCentering=True).fit(vectors(fit_on))
    rows = scaler.transform(vectors(df)).drop("_raw").withColumn("_w", F.col("weight") * F.when(F.col("label") == 1, scale).otherwise(1.0))
    trees = GBTClassifier(labelCol="label", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy=str(features), seed=seed)
    return rows, trees.fit(rows if train is None else rows.where(train))


def boosted_scores(df: DataFrame, columns: list[str], rounds: int = 400, depth: int = 6, step: float = 0.05, seed: int = 42, features: float = 0.8, train: Column | None = None) -> DataFrame:
    """df(label, weight) with boosted: the probability of label 1, by a model of the rows that `train` names (all by default)."""
    rows, model = boosted_model(df, columns, rounds, depth, step, seed, features, train)
    return model.transform(rows).withColumn("boosted", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "_w", "features")


def attributions(rows: DataFrame, model, columns: list[str], key: str = "npi", n: int = 3) -> DataFrame:
    """rows(features, scaled to a median of 0), a fitted classifier -> (key, score, top, values): what each feature does to a row's score.

    values: feature -> the score less what the fitted model gives with that feature alone at its median; top: the n
    largest by size, ties by name. A model pass for each feature, within one stage and without a shuffle.
    """
    def scored(df: DataFrame, features: str, out: str) -> DataFrame:
        other = model.copy().setFeaturesCol(features).setProbabilityCol(f"_p{out}").setRawPredictionCol("").setPredictionCol(f"_q{out}")
        return other.transform(df).withColumn(out, vector_to_array(f"_p{out}")[1]).drop(f"_p{out}", f"_q{out}")

    def at_median(i: int):
        return array_to_vector(F.transform("_x", lambda v, j: F.when(j == i, 0.0).otherwise(v)))

    out = scored(rows.select(key, "features", vector_to_array("features").alias("_x")), "features", "score")
    for i in range(len(columns)):
        out = out.withColumn(f"_f{i}", at_median(i))
        out = scored(out, f"_f{i}", f"_s{i}").drop(f"_f{i}")
    parts = [F.struct((-F.abs(F.col("score") - F.col(f"_s{i}"))).alias("s"), F.lit(c).alias("name"), (F.col("score") - F.col(f"_s{i}")).alias("v")) for i, c in enumerate(columns)]
    best = F.array_sort(F.array(*parts))
    values = F.map_from_entries(F.transform(best, lambda x: F.struct(x["name"], x["v"])))
    return out.select(key, "score", F.transform(F.slice(best, 1, n), lambda x: x["name"]).alias("top"), values.alias("values"))


def reconstruction_errors(df: DataFrame, columns: list[str], k: int = 4) -> DataFrame:
    """df with error: mean squared error of the first k components, as a part of the largest one."""
    rows = scaled(df, columns)
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="_p").fit(rows)
    axes = model.pc.toArray()
    x = vector_to_array("features")
    parts = [sum((F.get(x, F.lit(i)) * float(axes[i, j]) for i in range(len(columns))), F.lit(0.0)) for j in range(axes.shape[1])]
    rows = rows.withColumn("_c", F.array(*parts))
    back = [F.pow(F.get(x, F.lit(i)) - sum((F.get("_c", F.lit(j)) * float(axes[i, j]) for j in range(axes.shape[1])), F.lit(0.0)), 2) for i in range(len(columns))]
    rows = rows.withColumn("error", sum(back, F.lit(0.0)) / len(columns)).drop("_c", "features")
    top = rows.agg(F.max("error").alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("error", F.coalesce(F.try_divide("error", "_top"), F.lit(0.0))).drop("_top")  # one row


def top_drivers(df: DataFrame, weights: dict[str, float], key: str = "npi", n: int = 3) -> DataFrame:
    """(key, top, values): for a linear score, weight x (value - median) of each feature, which is exact; the n largest by size."""
    middle = df.agg(*(F.median(c).alias(f"_{c}") for c in weights))
    wide = df.crossJoin(F.broadcast(middle))  # one row
    parts = F.array(*(F.struct((-F.abs((F.col(c) - F.col(f"_{c}")) * w)).alias("s"), F.lit(c).alias("name"), ((F.col(c) - F.col(f"_{c}")) * w).alias("v")) for c, w in weights.items()))
    best = F.slice(F.array_sort(parts), 1, n)
    return wide.select(key, F.transform(best, lambda x: x["name"]).alias("top"), F.map_from_entries(F.transform(best, lambda x: F.struct(x["name"], x["v"]))).alias("values"))
