"""Search, dashboards, maps, feeds, audit, deltas, briefs and public-record findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_divide

SORTS = {"risk_score", "total_payment", "total_services", "name", "npi"}


def allowed(df: DataFrame, access: list[str], column: str = "state") -> DataFrame:
    """Rows of the states a user may see; an empty list is no limit."""
    return df.where(F.col(column).isin(access)) if access else df


def default_state(access: list[str], asked: str | None) -> str | None:
    if asked and access and asked not in access:
        raise PermissionError(asked)
    return asked or (access[0] if access else None)


def search(people: DataFrame, text: str | None = None, state: str | None = None, specialty: str | None = None, excluded: bool | None = None, least: float | None = None, most: float | None = None, facilities: list[str] = (), access: list[str] = (), columns: tuple[str, ...] = ("name", "npi", "specialty", "state")) -> DataFrame:
    out = allowed(people, list(access))
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
        out = out.where(found)
    for condition, test in ((state, F.col("state") == state), (specialty, F.contains(F.lower("specialty"), F.lit((specialty or "").lower())))):
        if condition:
            out = out.where(test)
    if excluded is not None:
        out = out.where(F.col("excluded") == excluded)
    if least is not None:
        out = out.where(F.col("risk_score") >= least)
    if most is not None:
        out = out.where(F.col("risk_score") <= most)
    return out.where(~F.lower("specialty").isin([x.lower() for x in facilities])) if facilities else out


def page(df: DataFrame, sort: str = "risk_score", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page; nulls last when descending, first when ascending; ties by npi. The total is df.count()."""
    sort = sort if sort in SORTS else "risk_score"
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
    return df.orderBy(order, "npi").offset(offset).limit(limit)


def export(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The feature's own limit: the providers with most risk, with their number of flags."""
    return df.orderBy(F.desc_nulls_last("risk_score"), "npi").limit(most).withColumn("flag_count", F.size("flags")).drop("flags")


def dashboard(people: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    c = lambda least, most=1e9: F.count_if((F.col("risk_score") >= least) & (F.col("risk_score") < most))
    out = people.agg(
        F.count("*").alias("providers"), c(90).alias("critical"), c(70, 90).alias("high"), c(50, 70).alias("medium"), F.count_if("excluded").alias("excluded"), F.count_distinct("state").alias("states"),
        F.sum("total_payment").alias("total_payment"), F.sum(F.when(F.col("risk_score") >= 70, F.col("total_payment"))).alias("payment_at_risk"), F.avg("risk_score").alias("avg_risk"))
    return out if cases is None else out.crossJoin(F.broadcast(cases.agg(F.count_if(F.col("status") == "open").alias("open_cases"))))  # one row each


def state_map(people: DataFrame, flags: DataFrame) -> DataFrame:
    per = people.groupBy("state").agg(F.count("*").alias("providers"), F.count_if(F.col("risk_tier") <= 2).alias("high_risk"), F.count_if(F.col("risk_score") >= 70).alias("at_70"), F.avg("risk_score").alias("avg_risk"))
    over = flags.where("is_active").join(people.select("npi", "state"), "npi").groupBy("state").agg(F.sum("overpayment").alias("overpayment"))
    return per.join(over, "state", "left").withColumn("overpayment", F.coalesce("overpayment", F.lit(0.0)))


def top_leads(people: DataFrame, flags: DataFrame, limit: int = 15) -> DataFrame:
    """The best active flag of each provider that isn't excluded: worst severity, then most overpayment."""
    first = F.row_number().over(Window.partitionBy("npi").orderBy("severity", F.desc_nulls_last("overpayment"), "flag_type"))
    best = flags.where("is_active").withColumn("n", first).where("n = 1").drop("n")
    return best.join(people.where("NOT excluded").select("npi", "name", "state", "risk_score"), "npi").orderBy("severity", F.desc_nulls_last("overpayment"), "npi").limit(limit)


def alert_feed(alerts: DataFrame, people: DataFrame, since, worst: int = 2, access: list[str] = (), limit: int | None = None) -> DataFrame:
    out = alerts.where((F.col("created_at") > since) & (F.col("severity") <= worst)).join(people.select("npi", "name", "state"), "npi")
    out = allowed(out, list(access)).orderBy("severity", F.desc("created_at"), "flag_id")
    return out if limit is None else out.limit(limit)


def latest(df: DataFrame, by: list[str], order: list, name: str = "n", at: int = 1) -> DataFrame:
    """The at-th row of each key in an order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) == at).drop(name)


def audit_timeline(audit: DataFrame, users: DataFrame, user: str | None = None, action: str | None = None, target: str | None = None) -> DataFrame:
    for value, column in ((user, "user_id"), (action, "action"), (target, "target")):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    return audit.join(users, "user_id", "left").orderBy(F.desc("created_at"), "id")


def prior_access(audit: DataFrame) -> DataFrame:
    return audit.groupBy("target").agg(F.count("*").alias("times"), F.count_distinct("user_id").alias("users"))


def vintage(df: DataFrame, stamp: str) -> DataFrame:
    return df.agg(F.max(stamp).alias("latest"), F.count("*").alias("rows"), F.count_if(F.col(stamp).isNull()).alias("unstamped"))


def exclusion_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (npi) -> (npi, change): newly_excluded, reinstated or unchanged."""
    a, b = old.select("npi").distinct().withColumn("was", F.lit(True)), new.select("npi").distinct().withColumn("now", F.lit(True))
    both = a.join(b, "npi", "full_outer")
    return both.select("npi", F.when(F.col("was").isNull(), "newly_excluded").when(F.col("now").isNull(), "reinstated").otherwise("unchanged").alias("change"))


def apply_exclusions(people: DataFrame, delta: DataFrame, floor: float = 85.0) -> DataFrame:
    """Excluded: at least the floor and tier 2 at worst. Reinstated: the mark goes, the score stays."""
    out = people.join(delta, "npi", "left")
    on = F.coalesce(F.col("change").isin("newly_excluded", "unchanged"), F.lit(False))
    off = F.coalesce(F.col("change") == "reinstated", F.lit(False))
    return out.withColumns({"excluded": on | (F.col("excluded") & ~off), "risk_score": F.when(on, F.greatest("risk_score", F.lit(floor))).otherwise(F.col("risk_score")), "risk_tier": F.when(on, F.least("risk_tier", F.lit(2))).otherwise(F.col("risk_tier"))}).drop("change")


IDENTITY = ["source", "title", "url", "date"]


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of the latest run whose identity the run before didn't have."""
    key = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in IDENTITY]
    return current.select(*[c for c in current.columns if c not in IDENTITY], *key).join(previous.select(*key).distinct(), IDENTITY, "left_anti")


#: From worst to least. Fixed values.
SEVERITY = ["critical", "adverse", "warning", "info", "none"]


def severity_rank(c) -> Column:
    out = F.lit(0)
    for n, name in enumerate(reversed(SEVERITY), 1):
        out = F.when(c == name, n).otherwise(out)
    return out


def outcome_feedback(flags: DataFrame, outcomes: DataFrame, confirmed: list[str]) -> DataFrame:
    """A confirmed outcome makes the provider's active flags certain and reviewed."""
    sure = outcomes.where(F.col("outcome").isin(confirmed)).select("npi").distinct().withColumn("_sure", F.lit(True))
    on = F.coalesce("_sure", F.lit(False)) & F.col("is_active")
    return flags.join(sure, "npi", "left").withColumn("confidence", F.when(on, 1.0).otherwise(F.col("confidence"))).withColumn("reviewed", on).drop("_sure")


def priority(score: Column, excluded: Column, facility: Column) -> Column:
    base = F.when(excluded | (score >= 90), 1).when(score >= 75, 2).when(score >= 55, 3).otherwise(4)
    return F.least(base + facility.cast("int"), F.lit(4))


def scheme(types: Column, excluded: Column, rules: list[tuple[str, list[str]]], default: str = "general", every: bool = False) -> Column:
    """The first rule that shares a flag type (every: has all of its types)."""
    out = F.lit(default)
    for name, wanted in reversed(rules):
        have = F.array(*map(F.lit, wanted))
        out = F.when(F.size(F.array_except(have, types)) == 0 if every else F.arrays_overlap(types, have), name).otherwise(out)
    return F.when(excluded, "excluded billing").otherwise(out)


def network_suspects(edges: DataFrame, center: int, most: int = 8) -> DataFrame:
    """The strongest suspicious partners of a provider, once each; direction tells which way referrals go."""
    out = edges.where("is_suspicious").where((F.col("source") == center) | (F.col("target") == center))
    other = F.when(F.col("source") == center, F.col("target")).otherwise(F.col("source")).alias("npi")
    both = out.select(other, "shared", (F.col("source") == center).alias("outward"))
    per = both.groupBy("npi").agg(F.max("shared").alias("shared"), F.when(F.count_distinct("outward") == 2, "both").when(F.first("outward"), "out").otherwise("in").alias("direction"))
    return per.orderBy(F.desc("shared"), "npi").limit(most)


def model_confidence(excluded: Column, boosted: Column, score: Column) -> Column:
    return F.when(excluded, F.greatest(boosted, F.lit(0.97))).when(boosted > 0, boosted).otherwise(F.least(score / 100, F.lit(0.99)))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    known = right.select(key).distinct().withColumn("_k", F.lit(1))
    return left.join(known, key, "left").agg(F.count("*").alias("rows"), F.count("_k").alias("matched"), safe_divide(F.count("_k"), F.count("*")).alias("ratio"))
