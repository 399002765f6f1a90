"""What reviewers look at: a provider's lines, flags and cases, case lists, sweeps, roles, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .serving import allowed, severity_rank

#: The fifty states and the district. Fixed values.
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY").split()
#: What each role may do. Fixed values.
ROLES = {
    "admin": ["providers:read", "providers:export", "cases:read", "cases:write", "cases:assign", "cases:export", "users:read", "users:write", "audit:read", "data:ingest"],
    "analyst": ["providers:read", "providers:export", "cases:read", "cases:write", "cases:export"],
    "viewer": ["providers:read", "cases:read"],
}
#: Cases that are being worked on.
OPEN = ("open", "under_review")


def valid_states(df: DataFrame, column: str = "state", states: list[str] = STATES) -> DataFrame:
    return df.where(F.col(column).isin(list(states)))


def permitted(role: Column, permission: str) -> Column:
    """Whether a role has a permission; unknown and null roles have none."""
    return F.coalesce(role.isin([r for r, have in ROLES.items() if permission in have]), F.lit(False))


def rescored(people: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """people whose scored_at is now for the providers in keys(npi)."""
    touched = keys.select("npi").distinct().withColumn("_touched", F.lit(True))
    stamp = F.current_timestamp() if now is None else now
    old = F.col("scored_at") if "scored_at" in people.columns else F.lit(None).cast("timestamp")
    return people.join(touched, "npi", "left").withColumn("scored_at", F.when(F.col("_touched"), stamp).otherwise(old)).drop("_touched")


def provider_lines(lines: DataFrame, npi, year: int | None = None, limit: int = 100) -> DataFrame:
    """A provider's billing lines, the largest payments first; the limit is the page's own."""
    own = lines.where(F.col("npi") == npi)
    own = own if year is None else own.where(F.col("year") == year)
    return own.orderBy(F.desc_nulls_last("payment"), *(c for c in ("year", "code") if c in lines.columns)).limit(limit)


def provider_flags(flags: DataFrame, npi, active_only: bool = True, limit: int = 100) -> DataFrame:
    """A provider's flags: the worst first, then the latest; ties by type."""
    own = flags.where(F.col("npi") == npi)
    own = own.where("is_active") if active_only else own
    return own.orderBy("severity", F.desc_nulls_last("created_at"), "flag_type").limit(limit)


def flags_by_cost(flags: DataFrame, npi, limit: int = 100) -> DataFrame:
    """A provider's active flags: the worst first, then the dearest."""
    return flags.where((F.col("npi") == npi) & F.col("is_active")).orderBy("severity", F.desc_nulls_last("overpayment"), "flag_type").limit(limit)


def provider_detail(people: DataFrame, impact: DataFrame, npi, access: list[str] = ()) -> DataFrame:
    """One provider with expected payment, excess and ratio; no row outside of one's states."""
    return allowed(people.where(F.col("npi") == npi), list(access)).join(impact.where(F.col("npi") == npi), "npi", "left")


def active_cases(cases: DataFrame, users: DataFrame, npi) -> DataFrame:
    """A provider's cases that aren't closed, with who works on them and who opened them, the latest first."""
    name = lambda who: users.select(F.col("user_id").alias(who), F.col("name").alias(f"{who}_name"))
    own = cases.where((F.col("npi") == npi) & F.col("status").isin(*OPEN))
    own = own.join(name("assigned_to"), "assigned_to", "left").join(name("created_by"), "created_by", "left")
    return own.orderBy(F.desc("created_at"), "case_id").drop("assigned_to", "created_by")


def case_list(cases: DataFrame, access: list[str] = (), status: str | None = None, outcome: str | None = None, state: str | None = None, assigned_to=None) -> DataFrame:
    out = allowed(cases, list(access))
    for column, value in (("status", status), ("outcome", outcome), ("state", state.upper() if state else None), ("assigned_to", assigned_to)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def with_parts(cases: DataFrame, people: DataFrame, notes: DataFrame, documents: DataFrame) -> DataFrame:
    """cases with their provider, notes and documents: notes(case_id, at, text), documents(case_id, name), each as a sorted array."""
    listed = lambda df, name: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "case_id")))).alias(name))
    out = cases.join(people.select("npi", F.struct("npi", "name", "state").alias("provider")), "npi", "left")
    return out.join(listed(notes, "notes"), "case_id", "left").join(listed(documents, "documents"), "case_id", "left")


def record_outcomes(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """cases with the last of their outcomes(case_id, outcome, at; ties by outcome); with one, a case is closed unless it is referred."""
    last = outcomes.groupBy("case_id").agg(F.max(F.struct("at", "outcome")).alias("_last"))
    out = cases.drop("outcome", "resolved_at").join(last, "case_id", "left")
    status = F.when(F.col("_last").isNull() | F.col("status").isin("referred", "closed"), F.col("status")).otherwise("closed")
    return out.withColumns({"status": status, "outcome": F.col("_last.outcome"), "resolved_at": F.col("_last.at")}).drop("_last")


def sweep_order(cases: DataFrame, watched: tuple[str, ...] = OPEN, most: int = 500) -> DataFrame:
    """The cases that a sweep takes: those that have waited longest; the limit is the sweep's own."""
    return cases.where(F.col("status").isin(*watched)).orderBy(F.asc_nulls_last("updated_at"), "case_id").limit(most)


def map_order(states: DataFrame, by_share: bool = False) -> DataFrame:
    """The map's states: most providers at 70 or more first, or the largest share of them."""
    first = F.try_divide(F.col("at_70").cast("double"), F.col("providers")) if by_share else F.col("at_70")
    return states.orderBy(F.desc_nulls_last(first), "state")


def map_totals(states: DataFrame) -> DataFrame:
    return states.agg(*(F.sum(c).alias(c) for c in ("providers", "high_risk", "overpayment")))


def finding_order(findings: DataFrame) -> DataFrame:
    """Worst first, then by date, the earliest first; a missing date comes before all."""
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), F.coalesce("date", F.lit("")), "title")


#: Flag types and the scheme they tell, in the order in which they are tried. Fixed values.
SCHEMES = [
    ("excluded billing", ["leie_match", "billing_volume"]), ("deceased patients", ["deceased_patient"]), ("impossible hours", ["impossible_hours"]),
    ("referral ring with volume", ["hub_spoke", "referral_cluster", "billing_volume"]), ("referral ring", ["hub_spoke", "referral_cluster"]),
    ("upcoding with volume", ["upcoding", "billing_volume"]), ("upcoding", ["upcoding"]), ("volume", ["billing_volume"]),
]
NETWORK = ["hub_spoke", "referral_cluster"]


def scheme_of(types: Column, excluded: Column, drug_codes: Column, payment: Column, rules: list[tuple[str, list[str]]] = SCHEMES, codes: int = 3, dear: float = 300_000.0) -> Column:
    """Exclusion, then many drug codes at a high payment (with or without network flags), then the first rule that shares a flag type."""
    out = F.lit("several signals")
    for name, wanted in reversed(rules):
        out = F.when(F.arrays_overlap(types, F.array(*map(F.lit, wanted))), name).otherwise(out)
    ring = F.arrays_overlap(types, F.array(*map(F.lit, NETWORK)))
    drugs = (drug_codes >= codes) & (payment > dear)
    return F.when(excluded, "excluded provider").when(drugs & ring, "drug billing and referral ring").when(drugs, "drug inflation").otherwise(out)


def drug_codes(lines: DataFrame) -> DataFrame:
    """(npi, drug_codes): lines whose code begins with J."""
    return lines.groupBy("npi").agg(F.count_if(F.col("code").startswith("J")).alias("drug_codes"))


def suspect_reasons(shared: Column, excluded: Column, score: Column) -> Column:
    every = [
        F.when(shared > 150, F.concat(F.format_number(shared, 0), F.lit(" shared patients, extremely many"))).when(shared > 0, F.concat(F.format_number(shared, 0), F.lit(" shared patients"))),
        F.when(excluded, F.lit("excluded")), F.when(score >= 85, F.concat(F.lit("risk score "), F.format_number(F.round(score), 0), F.lit(" of 100"))).when(score >= 70, F.concat(F.lit("risk score "), F.format_number(F.round(score), 0)))]
    found = F.concat_ws("; ", *every)
    return F.when(found == "", "flagged by the network").otherwise(found)


def suspect_action(shared: Column, excluded: Column, score: Column, mutual: Column) -> Column:
    return (
        F.when(excluded, "subpoena referral and payment records").when(mutual & (shared > 50), "compare both practices' patient rosters")
        .when(score >= 80, "review as a partner in a scheme").otherwise("request referral documents"))
