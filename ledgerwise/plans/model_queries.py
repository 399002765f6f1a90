"""Queries of fitted models that no SQL can say: Shapley values of boosted trees, errors of an autoencoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import autoencoder, models, shapley
from ..sources.staging import written
from .registry import SCORED, query, scored
from .serving_queries import MODEL


def labelled(spark, d):
    """Providers with the model's features, and whether they are excluded as the label."""
    p = scored(spark, d).select("npi", "pv", *(F.col(c).cast("double").alias(c) for c in MODEL), F.col("excluded").cast("int").alias("label"), F.lit(1.0).alias("weight"))
    return written(p, "labelled")


_SCALED = ", ".join(f"round((CAST({c} AS DOUBLE) - m_{c}[2]) / (m_{c}[3] - m_{c}[1]), 6) AS {c}" for c in MODEL)


@query(f"""WITH {SCORED}, q AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS m_{c}" for c in MODEL)} FROM scored) SELECT npi, {_SCALED} FROM scored, q""")
def robust_scaled(spark, d):
    p = models.robust(scored(spark, d).select("npi", *MODEL), MODEL)
    return p.select("npi", *(F.round(F.get("x", F.lit(i)), 6).alias(c) for i, c in enumerate(MODEL)))


@query(None)
def shapley_values(spark, d):
    """Each provider's margin by twenty boosted trees of depth four, and what each feature adds to it."""
    rows, model = models.boosted_model(labelled(spark, d), MODEL, rounds=20, depth=4)
    from pyspark.ml.functions import vector_to_array

    found = shapley.attributions(rows.select("npi", vector_to_array("features").alias("x")), shapley.trees_of(model, spark), MODEL)
    return found.select("npi", "base", "margin", "top", "values")


@query(None)
def autoencoder_errors(spark, d):
    """The net is fitted on providers up to the 90th percentile of payment against peers; all are judged."""
    p = models.robust(labelled(spark, d), MODEL)
    net = autoencoder.fit(autoencoder.usual(p, "pv"), layers=(16, 4, 16), rounds=15)
    return autoencoder.reconstruction_errors(p.select("npi", "x"), net).select("npi", "error")
