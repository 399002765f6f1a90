"""Models by value: Shapley values against all subsets, the autoencoder against numpy, boosted scores and components recomputed."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerwise.catalogue import QUERIES
from ledgerwise.operators import autoencoder, models, shapley

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n) > 0).astype(int)
    return x, label, spark.createDataFrame([(i, *map(float, x[i]), int(label[i]), 1.0) for i in range(n)], "npi long, a double, b double, c double, d double, label int, weight double")


@pytest.fixture(scope="module")
def fitted(spark):
    _, _, df = table(spark)
    rows, model = models.boosted_model(df, COLUMNS, rounds=6, depth=3)
    trees = shapley.trees_of(model, spark)
    found = rows.select("npi", vector_to_array("features").alias("x")).orderBy("npi").collect()
    return df, rows, model, trees, np.array([r["x"] for r in found])


def expected(trees, row, known):
    """A tree's mean over its leaves, where unknown features go both ways by weight."""
    total = 0.0
    for t in trees:
        for value, fs, lows, highs, parts in zip(t.value, t.feature, t.low, t.high, t.part, strict=True):
            w = value
            for f, lo, hi, part in zip(fs, lows, highs, parts, strict=True):
                w *= float(lo < row[f] <= hi) if f in known else part
            total += w
    return total


def test_shapley_values_equal_all_subsets(fitted):
    _, _, _, trees, x = fitted
    got, n = shapley.values_of(trees, x[:25]), 4
    for row, values in zip(x[:25], got, strict=True):
        for f in range(n):
            others = [i for i in range(n) if i != f]
            want = sum(
                factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (expected(trees, row, {*s, f}) - expected(trees, row, set(s)))
                for k in range(n) for s in combinations(others, k))
            assert abs(values[f] - want) < 1e-9


def test_shapley_sums_are_the_models_margins(spark, fitted):
    df, rows, model, trees, x = fitted
    got = {r["npi"]: r for r in shapley.attributions(rows.select("npi", vector_to_array("features").alias("x")), trees, COLUMNS).collect()}
    raw = {r["npi"]: r["m"] for r in model.transform(rows).select("npi", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    scores = {r["npi"]: r["boosted"] for r in models.boosted_scores(df, COLUMNS, rounds=6, depth=3).collect()}
    assert set(got) == set(raw)
    for npi, r in got.items():
        assert abs(r["margin"] - raw[npi] / 2) < 1e-9 or abs(r["margin"] - raw[npi]) < 1e-9
        assert abs(r["margin"] - r["base"] - sum(r["values"].values())) < 1e-9
        assert r["top"] == sorted(r["values"], key=lambda k: (-abs(r["values"][k]), k))[:3]
        # the boosted score is the trees' own, walked here
        assert abs(scores[npi] - 1 / (1 + np.exp(-2 * expected(trees, x[npi], {0, 1, 2, 3})))) < 1e-9


def test_boosted_scores_tell_labels(spark):
    _, label, df = table(spark, 600, seed=2)
    got = [r["boosted"] for r in models.boosted_scores(df, COLUMNS, rounds=10, depth=3).orderBy("npi").collect()]
    assert np.mean((np.array(got) > 0.5) == label) > 0.8


def test_median_attributions(spark, fitted):
    df, rows, model, trees, x = fitted
    got = {r["npi"]: r for r in models.attributions(rows, model, COLUMNS).collect()}
    p = lambda row: 1 / (1 + np.exp(-2 * expected(trees, row, {0, 1, 2, 3})))
    for npi in range(20):
        for i, c in enumerate(COLUMNS):
            other = x[npi].copy()
            other[i] = 0.0
            assert abs(got[npi]["values"][c] - (p(x[npi]) - p(other))) < 1e-9


def test_component_errors_equal_numpy(spark):
    x, _, df = table(spark, 300, seed=3)
    rows = models.scaled(df, COLUMNS).select("npi", vector_to_array("features").alias("x")).orderBy("npi").collect()
    z = np.array([r["x"] for r in rows])
    axes = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    want = ((z - z @ axes @ axes.T) ** 2).mean(axis=1)
    got = np.array([r["error"] for r in models.reconstruction_errors(df, COLUMNS, 2).orderBy("npi").collect()])
    np.testing.assert_allclose(got, want / want.max(), rtol=1e-6)


def test_gradient_is_the_losses_slope():
    rng = np.random.default_rng(4)
    net, x = autoencoder.Net.drawn(3, (5, 2, 5), 1), rng.normal(size=(7, 3))
    gradient, _ = net.gradient(x)
    for i in rng.choice(len(net.flat), 25, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (autoencoder.Net(net.shapes, up).gradient(x)[1] - autoencoder.Net(net.shapes, down).gradient(x)[1]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5


def test_autoencoder_equals_one_partition_and_its_loss_falls(spark):
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(200, 2))
    x = hidden @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "npi long, x array<double>")
    net = autoencoder.fit(df.repartition(4), layers=(8, 2, 8), rounds=12, step=0.02)
    alone, adam = autoencoder.Net.drawn(6, (8, 2, 8), 42), autoencoder.Adam(len(net.flat), 0.02)
    losses = []
    for _ in range(12):
        g, loss = alone.gradient(x)
        losses.append(loss / len(x))
        alone.flat = adam(alone.flat, g / len(x))
    np.testing.assert_allclose(net.losses, losses, rtol=1e-9)
    np.testing.assert_allclose(net.flat, alone.flat, rtol=1e-6, atol=1e-9)
    assert losses[-1] < losses[0] * 0.8
    got = [r["error"] for r in autoencoder.reconstruction_errors(df, net).orderBy("npi").collect()]
    np.testing.assert_allclose(got, alone.errors(x), rtol=1e-6)
    stopped = autoencoder.fit(df, layers=(8, 2, 8), rounds=30, step=0.0, patience=3)
    assert len(stopped.losses) == 4
    assert autoencoder.fit(df.limit(0), rounds=3).losses == []


def test_usual_rows(spark):
    df = spark.createDataFrame([(i, float(i) if i % 10 else None) for i in range(101)], "npi long, z double")
    got = {r["npi"] for r in autoencoder.usual(df, "z").collect()}
    z = np.array([i if i % 10 else 0 for i in range(101)])
    assert got == set(np.flatnonzero(z <= np.percentile(z, 90)))


def test_isolation_scores_equal_a_walk_of_the_trees(spark):
    """The same trees, grown again from the same samples and walked row by row; scores don't depend on how rows are dealt."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    x[:4] += 9
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "npi long, a double, b double, c double")
    run = lambda rows: {r["npi"]: r["isolation"] for r in models.isolation_scores(rows, ["a", "b", "c"], trees=12, tree_rows=64, seed=5).collect()}
    got = run(df.repartition(1))
    assert got == run(df.repartition(5))
    pool = [(r["h"], r["npi"]) for r in df.select(F.xxhash64("npi", F.lit(5)).alias("h"), "npi").orderBy("h", "npi").collect()]
    rows, depth, dealt = 64, 6, 300 // 64
    lengths = np.zeros((12, 300))
    for tree in range(12):
        sample = [npi for n, (_, npi) in enumerate(pool, 1) if n % dealt == tree % dealt][:rows]
        g = np.random.default_rng([5, tree])
        some = g.choice(3, 2, replace=False)
        feature, cut, child, length = models.grow(x[sample], some, g, depth)
        for i, row in enumerate(x):
            node = 0
            while feature[node] >= 0:
                node = child[node] + int(row[feature[node]] >= cut[node])
            lengths[tree, i] = length[node]
    want = 2 ** (-lengths.mean(axis=0) / models._c(rows))
    np.testing.assert_allclose([got[i] for i in range(300)], want, atol=1e-9)
    assert {i for i in sorted(got, key=got.get)[-4:]} == {0, 1, 2, 3}


def test_robust_scaling(spark):
    rows = [(i, float(i), 5.0, None if i % 2 else float(i * i)) for i in range(41)]
    got = {r["npi"]: r["x"] for r in models.robust(spark.createDataFrame(rows, "npi long, a double, b double, c double"), ["a", "b", "c"]).collect()}
    c = np.array([i * i for i in range(0, 41, 2)], float)
    q = np.percentile(c, [25, 50, 75])
    for i, a, _, v in rows:
        np.testing.assert_allclose(got[i], [(a - 20) / 20, 0.0, 0.0 if v is None else (v - q[1]) / (q[2] - q[0])])


def test_held_out_rows_teach_nothing(spark):
    _, _, df = table(spark, 300, seed=7)
    train = F.col("npi") < 200
    flipped = df.withColumn("label", F.when(train, F.col("label")).otherwise(1 - F.col("label")))
    a, b = ({r["npi"]: r["boosted"] for r in models.boosted_scores(x, COLUMNS, rounds=4, depth=3, train=train).collect()} for x in (df, flipped))
    assert a == b and len(a) == 300


def test_gbt_score_is_of_all_four_hundred_trees(spark, monkeypatch):
    """The query's fit has as many trees, as deep, and as small a step as the survey's M-09, and each score is the walk of all of them."""
    fits, fit = [], models.boosted_model
    monkeypatch.setattr(models, "boosted_model", lambda *a, **k: fits.append(fit(*a, **k)) or fits[-1])
    got = {r["npi"]: r["boosted"] for r in QUERIES["gbt_score"](spark, "/root/testdata/sf0.001").collect()}
    [(rows, model)] = fits
    assert (model.getNumTrees, model.getMaxDepth(), model.getStepSize()) == (400, 6, 0.05)
    trees = shapley.trees_of(model, spark)
    for r in rows.select("npi", vector_to_array("features").alias("x")).orderBy("npi").limit(20).collect():
        assert abs(got[r["npi"]] - 1 / (1 + np.exp(-2 * expected(trees, r["x"], {0, 1, 2, 3})))) < 1e-9
