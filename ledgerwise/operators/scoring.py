"""Ranks, composite scores, tiers, labels and exact validation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..sources.staging import written


def ordinal_rank(df: DataFrame, order: list[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """Positions from 1 in the order of the columns, which must tell all rows apart; no task holds all rows.

    Rows are range-partitioned and written with the number of their partition, so that counting them and numbering
    them see the same partitions. The counts (a row for each partition) give each partition's first number, and their sum,
    as column `total` if asked for.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = [F.sum("count").over(Window.partitionBy()).alias(total)] if total else []
    counts = counts.select("_part", before.alias("_before"), *every)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(counts), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def composite(boosted: Column, isolation: Column, error: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    return boosted * weights[0] + isolation * weights[1] + error * weights[2]


def top_tail_stretch(df: DataFrame, score: str, key: str, cut: float = 0.95, power: float = 0.6, least: int = 100) -> DataFrame:
    """Scores ranked in the top part are spread from the cut's score up to 1; fewer than `least` rows stay."""
    ranked = ordinal_rank(df, [score, key], "_rank", total="_n")
    floor = ranked.where(F.col("_rank") == F.floor(F.lit(cut) * (F.col("_n") - 1)) + 1).select(F.col(score).alias("_c0"))
    ranked = ranked.crossJoin(F.broadcast(floor))  # one row, none of an empty table
    r = (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    spread = F.col("_c0") + (1 - F.col("_c0")) * F.pow((r - cut) / (1 - cut), power)
    return ranked.withColumn("stretched", F.when((F.col("_n") >= least) & (r >= cut), spread).otherwise(F.col(score))).drop("_rank", "_n", "_c0")


def volume_discount(score: Column, specialty: Column, ppb: Column, excluded: Column, specialties: list[str]) -> Column:
    """Specialties that bill by volume are scored down while a beneficiary costs about what peers' do."""
    factor = F.when(ppb < 2, 0.15).when(ppb < 5, 0.45).when(ppb < 15, 0.75).otherwise(1.0)
    return F.when(specialty.isin(specialties) & ~excluded, score * factor).otherwise(score)


def tier(score: Column) -> Column:
    return F.when(score >= 90, 1).when(score >= 70, 2).when(score >= 50, 3).otherwise(4)


def tier_from_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """The worst active severity, else the tier there was, else 4; and the number of active flags."""
    active = flags.where("is_active").groupBy("npi").agg(F.min("severity").alias("worst"), F.count("*").alias("flag_count"))
    return df.join(active, "npi", "left").select("npi", F.coalesce("worst", "risk_tier", F.lit(4)).alias("risk_tier"), F.coalesce("flag_count", F.lit(0)).alias("flag_count"))


def temporal_split(exclusions: DataFrame, cut: str = "20230101") -> DataFrame:
    """exclusions(npi, excldate text) -> (npi, part): train before the cut, holdout from it on; undated ones go."""
    dated = exclusions.where(F.col("excldate").rlike(r"^\d{8}$"))
    return dated.groupBy("npi").agg(F.min("excldate").alias("d")).select("npi", F.when(F.col("d") < cut, "train").otherwise("holdout").alias("part"))


def labelled(panel: DataFrame, split: DataFrame, positive: DataFrame, cleared: DataFrame, ppb: float = 5.0, coding: float = 0.7, entropy: float = 0.4, volume: float = 5.0) -> DataFrame:
    """Panel rows without the holdout, with label, kind and weight; cleared beats investigator beats exclusion beats soft."""
    flag = lambda d, n: d.select("npi").distinct().withColumn(n, F.lit(True))
    hold = split.where("part = 'holdout'").select("npi")
    out = panel.join(hold, "npi", "left_anti").join(flag(split.where("part = 'train'"), "hard"), "npi", "left")
    out = out.join(flag(positive, "found"), "npi", "left").join(flag(cleared, "clear"), "npi", "left")
    soft = (F.col("ppb_vs_peer") >= ppb) | (F.col("level5_ratio") >= coding) | ((F.col("billing_entropy") <= entropy) & (F.col("payment_vs_peer") >= volume))
    kind = F.when(F.col("clear"), "cleared").when(F.col("found"), "investigator").when(F.col("hard"), "exclusion").when(soft, "soft").otherwise("none")
    weight = F.when(F.col("kind") == "cleared", 3.0).when(F.col("kind") == "investigator", 7.0).when(F.col("kind") == "exclusion", 5.0).when(F.col("kind") == "soft", 0.2).otherwise(1.0)
    out = out.withColumn("kind", kind).withColumn("weight", weight)
    return out.withColumn("label", F.col("kind").isin("investigator", "exclusion", "soft").cast("int")).drop("hard", "found", "clear")


def label_sets(outcomes: DataFrame, holdout: DataFrame, confirmed: tuple[str, ...] = ("substantiated", "referred_to_doj", "referred_to_state_ag"), cleared: tuple[str, ...] = ("unsubstantiated", "closed_no_action")) -> tuple[DataFrame, DataFrame]:
    """outcomes(npi, outcome) -> (positive, cleared) providers, once each, without the holdout; a cleared one isn't positive."""
    of = lambda names: outcomes.where(F.lower(F.trim("outcome")).isin(list(names))).select("npi").distinct().join(holdout.select("npi"), "npi", "left_anti")
    clear = of(cleared)
    return of(confirmed).join(clear, "npi", "left_anti"), clear


def class_balance(df: DataFrame) -> DataFrame:
    """Negatives for each positive."""
    return df.agg(safe_divide(F.count_if(F.col("label") == 0), F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("scale"))


def threshold_report(scored: DataFrame, thresholds: list[int] = range(30, 100, 5)) -> DataFrame:
    """scored(score, label) -> counts, precision, recall and F1 at each threshold, in one pass over the rows."""
    hits = scored.select("label", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "score")
    over, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    out = hits.groupBy("threshold").agg(F.count_if(over & pos).alias("tp"), F.count_if(over & ~pos).alias("fp"), F.count_if(~over & pos).alias("fn"), F.count_if(~over & ~pos).alias("tn"))
    p, r = safe_divide("tp", F.col("tp") + F.col("fp")), safe_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _by_score(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above) for each distinct score: sums over all larger scores.

    The ranged rows are written with their partition's number, as in ordinal_rank. Rows without a score take no part.
    """
    per = scored.where(F.col("score").isNotNull()).groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.coalesce(F.col("label") != 1, F.lit(True))).alias("neg"))
    ranged = written(per.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("p").over(ahead), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"))
    own = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c, base: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(base)
    return ranged.join(F.broadcast(sums), "_part").select("score", "pos", "neg", above("pos", "p").alias("pos_above"), above("neg", "n").alias("neg_above"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the curve: pairs ranked rightly, ties as halves."""
    t = _by_score(scored)
    wins = F.sum(F.col("neg").cast("double") * F.col("pos_above") + F.col("neg") * F.col("pos") * 0.5)
    return t.agg(safe_divide(wins, F.sum("pos").cast("double") * F.sum("neg"), None).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the step in recall times precision."""
    t = _by_score(scored)
    hits = F.col("pos_above") + F.col("pos")
    at = safe_divide(hits, hits + F.col("neg_above") + F.col("neg"))
    return t.agg(safe_divide(F.sum(at * F.col("pos")), F.sum("pos"), None).alias("average_precision"))
