"""Statistics of peer groups as aggregates that are joined back: a large group isn't one task's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MIN_PEERS, safe_divide


def beside(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """df with the other columns of stats, from its one row with the same values in `by`; a null is a value."""
    own = [f"_by_{c}" for c in by]
    right = stats.withColumnsRenamed(dict(zip(by, own, strict=True)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, own, strict=True)))
    return df.join(right, same, "left").drop(*own)


def with_medians(df: DataFrame, medians: dict[str, str], by: list[str]) -> DataFrame:
    """df with a column for each name: the median of medians[name] over the rows of the group."""
    return beside(df, df.groupBy(*by).agg(*(F.median(c).alias(n) for n, c in medians.items())), by)


def with_peer_medians(df: DataFrame, medians: dict[str, str], fine: list[str], coarse: list[str], least: int = MIN_PEERS) -> DataFrame:
    """As with_medians, over the fine group where it has `least` values, else over the coarse group."""
    near = df.groupBy(*fine).agg(*(F.when(F.count(c) >= least, F.median(c)).alias(f"_near_{n}") for n, c in medians.items()))
    far = df.groupBy(*coarse).agg(*(F.median(c).alias(f"_far_{n}") for n, c in medians.items()))
    out = beside(beside(df, near, fine), far, coarse)
    out = out.withColumns({n: F.coalesce(f"_near_{n}", f"_far_{n}") for n in medians})
    return out.drop(*(f"_{side}_{n}" for n in medians for side in ("near", "far")))


def with_z_score(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the sample z-score of a value within its group; 0 where the deviation is 0 or undefined."""
    out = beside(df, df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_deviation")), by)
    return out.withColumn(name, safe_divide(F.col(value) - F.col("_mean"), "_deviation", 0.0)).drop("_mean", "_deviation")
