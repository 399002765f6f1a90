"""Dashboard figures kept per state, brought up to date from changed rows, and the switch between them and live ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import Buckets
from ..sources.staging import dropped, written

COUNTS = ["providers", "excluded", "high_risk", "new_leads", "critical", "high", "medium", "low"]
#: Sums of money as decimals: adding and taking away give exactly what counting anew gives.
MONEY = "decimal(38,6)"
FIGURES = [*COUNTS, "total_payment"]


def partials(people: DataFrame) -> DataFrame:
    """people(state, excluded, risk_score, total_payment) -> figures per state; they add up, and changes can be taken away.

    A null state is a state of its own, '', which isn't among the states covered. A null score is in no class.
    """
    score, shut = F.col("risk_score"), F.coalesce("excluded", F.lit(False))
    which = {
        "providers": F.lit(True), "excluded": shut, "high_risk": score >= 70, "new_leads": (score >= 70) & ~shut, "critical": score >= 90,
        "high": (score >= 70) & (score < 90), "medium": (score >= 50) & (score < 70), "low": score < 50}
    sums = F.coalesce(F.sum(F.col("total_payment").cast(MONEY)), F.lit(0)).cast(MONEY)
    return people.groupBy(F.coalesce("state", F.lit("")).alias("state")).agg(*(F.count_if(c).alias(name) for name, c in which.items()), sums.alias("total_payment"))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("state").agg(*(F.sum(c).cast("long" if c in COUNTS else MONEY).alias(c) for c in FIGURES))


def snapshot_table(path: str, n: int = 8) -> Buckets:
    return Buckets(path, ("state",), n)


def take(snapshot: Buckets, people: DataFrame) -> None:
    """The snapshot of a whole table."""
    snapshot.create(partials(people))


def refresh(snapshot: Buckets, was: DataFrame, now: DataFrame) -> list[int]:
    """Adds changed rows: `was` as they were (none for new providers), `now` as they are (none for those that left).

    Only the changed rows and the figures of their states are read; gives the buckets that were rewritten.
    """
    less = partials(was).select("state", *((-F.col(c)).alias(c) for c in FIGURES))
    change = written(_added(less.unionByName(partials(now))), "change")
    after = _added(snapshot.lookup(change).select("state", *FIGURES).unionByName(change))
    after = written(after, "after")
    numbers = snapshot.replace(after, after.where("providers > 0"), ["state"])
    dropped(change, after)
    return numbers


def _stats(parts: DataFrame) -> DataFrame:
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long" if c in COUNTS else MONEY).alias(c) for c in FIGURES), F.count_if((F.col("state") != "") & (F.col("providers") > 0)).alias("states"))


def live(people: DataFrame, access: Sequence[str] = ()) -> DataFrame:
    """One row of figures, counted from the providers of the states that a user may see (all, if none is named)."""
    return _stats(partials(people.where(F.col("state").isin(list(access))) if access else people))


def dashboard(spark: SparkSession, snapshot: Buckets | None, people: DataFrame, cases: DataFrame | None = None, access: Sequence[str] = ()) -> DataFrame:
    """One row: from the snapshot for users without limits, if there is one, else live; and the open cases of those states."""
    out = live(people, access) if access or snapshot is None else _stats(snapshot.table(spark))
    if cases is None:
        return out
    cases = cases.where(F.col("state").isin(list(access))) if access else cases
    return out.crossJoin(F.broadcast(cases.agg(F.count_if(F.col("status") == "open").alias("open_cases"))))  # one row each
