"""Ranks and exact metrics over so many rows that ranges are sampled and partitions merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import scoring

N = 400_000


@pytest.mark.parametrize("wide", [False, True])
def test_each_rank_once(spark, wide):
    rows = spark.range(N).withColumn("score", F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003)
    if wide:
        rows = rows.withColumn("more", F.concat(*(F.sha2(F.concat("id", F.lit(i)).cast("string"), 256) for i in range(4))))
    out = scoring.ordinal_rank(rows, ["score", "id"])
    got = out.agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(got) == (N, 1, N, N)
    pair = out.select("rank", "score", "id").orderBy("rank").limit(1000).collect()
    assert [(r.score, r.id) for r in pair] == sorted((r.score, r.id) for r in pair)
    assert scoring.top_tail_stretch(rows, "score", "id").count() == N


def test_auc_and_average_precision_of_many_scores(spark):
    rows = spark.range(N).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(300_007)) / 300_007).alias("score"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("more"))
    rows = rows.withColumn("label", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) < 1000 * F.col("score")).cast("int"))
    x = rows.select("score", "label").toPandas()
    score, label = x.score.to_numpy(), x.label.to_numpy()
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    steps = np.diff(tp, prepend=0)
    ap = (steps * tp / n).sum() / y.sum()
    fp = n - tp
    auc = (np.diff(fp, prepend=0) * (tp - steps / 2)).sum() / (y.sum() * (len(y) - y.sum()))
    assert scoring.roc_auc(rows).first()[0] == pytest.approx(auc, abs=1e-9)
    assert scoring.average_precision(rows).first()[0] == pytest.approx(ap, abs=1e-9)


def test_no_rows_and_no_positives(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert scoring.roc_auc(none).first()[0] is None
    assert scoring.average_precision(none).first()[0] is None
    assert scoring.roc_auc(spark.createDataFrame([(0.5, 0), (None, 1)], "score double, label int")).first()[0] is None
