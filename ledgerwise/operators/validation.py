"""Validation of scores: labels with a fallback, recall, leads, quality of the distribution, importance of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_divide

#: Reasons for exclusion that billing data can show. Fixed values.
BILLING_REASONS = ("1128a1", "1128a3", "1128b7", "1128b8", "1128b9", "1156")


def validation_labels(people: DataFrame, holdout: DataFrame | None, exclusions: DataFrame) -> DataFrame:
    """people with label and label_source: the temporal holdout where there is one, else all exclusions."""
    known = (exclusions if holdout is None else holdout).select("npi").where("npi IS NOT NULL").distinct().withColumn("_known", F.lit(1))
    source = "all_exclusions_fallback" if holdout is None else "temporal_holdout"
    return people.join(known, "npi", "left").withColumn("label", F.coalesce("_known", F.lit(0))).withColumn("label_source", F.lit(source)).drop("_known")


def recall_report(scored: DataFrame, cuts: tuple[int, ...] = (50, 70, 80)) -> DataFrame:
    """scored(risk_score, label, excluded) -> one row: caught and recall of the positives at each cut, new leads, group means."""
    pos, score, free = F.col("label") == 1, F.col("risk_score"), ~F.coalesce("excluded", F.lit(False))
    out = [F.count("*").alias("rows"), F.count_if(pos).alias("holdout")]
    for cut in cuts:
        out += [F.count_if((score >= cut) & pos).alias(f"caught_{cut}"), F.round(F.count_if((score >= cut) & pos) / F.greatest(F.count_if(pos), F.lit(1)), 4).alias(f"recall_{cut}")]
    out += [F.count_if((score >= 70) & free).alias("new_leads_70"), F.count_if((score >= 80) & free).alias("new_leads_80"), F.count_if((score >= 50) & (score < 70) & free).alias("new_leads_50_69")]
    out += [F.round(F.avg(F.when(pos, score)), 2).alias("holdout_mean"), F.round(F.avg(F.when(~pos, score)), 2).alias("other_mean")]
    return scored.agg(*out)


def billing_recall(scored: DataFrame, exclusions: DataFrame, cut: float = 70.0, reasons: tuple[str, ...] = BILLING_REASONS) -> DataFrame:
    """One row: recall among the positives whose earliest exclusion has a billing reason, and how many have another one.

    exclusions(npi, excldate, excltype); of equal dates the smaller reason counts.
    """
    first = exclusions.where("npi IS NOT NULL").groupBy("npi").agg(F.min_by(F.lower(F.trim("excltype")), F.struct(F.col("excldate").isNull().alias("none"), "excldate", "excltype")).alias("reason"))
    own = scored.where("label = 1").join(first, "npi", "left")
    billing = F.coalesce(F.col("reason").isin(*reasons), F.lit(False))
    caught = F.count_if(billing & (F.col("risk_score") >= cut))
    return own.agg(F.count_if(billing).alias("billing"), F.count_if(~billing).alias("other"), caught.alias("caught"), F.round(caught / F.greatest(F.count_if(billing), F.lit(1)), 4).alias("recall"))


def score_quality(scored: DataFrame, top: int = 100, spread: float = 5.0) -> DataFrame:
    """One row: rows, mean and deviation of the scores, whether they spread, and how many of the top ones aren't excluded."""
    free = ~F.coalesce("excluded", F.lit(False))
    best = scored.orderBy(F.desc_nulls_last("risk_score"), "npi").limit(top).agg(F.count_if(free).alias("top_not_excluded"))
    out = scored.agg(F.count("*").alias("rows"), F.avg("risk_score").alias("mean"), F.stddev_samp("risk_score").alias("deviation"), F.count_if((F.col("risk_score") >= 70) & free).alias("high_not_excluded"))
    return out.withColumn("spreads", F.coalesce(F.col("deviation") >= spread, F.lit(False))).crossJoin(F.broadcast(best))  # one row each


def whole_quantile(df: DataFrame, column: str, at: float) -> DataFrame:
    """One row: the exact quantile of a column with linear interpolation. Counts of equal values are formed in each task first."""
    return df.agg(F.percentile(column, at).alias("quantile"))


def global_importance(attributed: DataFrame, values: str = "values") -> DataFrame:
    """attributed(values map of feature to contribution) -> (feature, importance): the mean size of each one's contribution."""
    return attributed.select(F.explode(values).alias("feature", "value")).groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
