"""Benchmarks and layered detectors over billing lines, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..sources.staging import written
from .peers import with_medians
from .quantiles import percentiles

FLAG = ["npi", "flag_type", "layer", "year", "severity", "confidence", "flag_value", "peer_value", "overpayment"]


def _percentiles(per: DataFrame, by: list[str], value: str, hot: int) -> DataFrame:
    """(by, peers, p50, p90, p99); see quantiles.percentiles for groups of more than `hot` rows."""
    p = percentiles(per, by, value, [0.5, 0.9, 0.99], hot=hot)
    return p.select(*by, F.col("n").alias("peers"), *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("p50", "p90", "p99"))))


def code_benchmarks(lines: DataFrame, least: int = 5, hot: int | None = None) -> DataFrame:
    """Per specialty, state and code: peers, median/p90/p99 payment per provider, services per beneficiary, charge.

    Without `hot`, a group's distinct values are in one task's memory; with it, groups of more providers than that are
    selected by counted ranges, of any size.
    """
    by = ["specialty", "state", "code"]
    per = lines.groupBy(*by, "npi").agg(
        F.sum("payment").cast("double").alias("payment"), safe_divide(F.sum("services"), F.count_distinct("bene"), None).alias("spb"), F.avg(F.col("charge").cast("double")).alias("charge"))
    if hot is not None:
        per = written(per, "per-provider")
        out = _percentiles(per, by, "payment", hot)
        for name, column in (("median_spb", "spb"), ("median_charge", "charge")):
            other = percentiles(per, by, column, [0.5], hot=hot).select(*(F.col(c).alias(f"_{c}") for c in by), F.get("p", F.lit(0)).alias(name))
            out = out.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))
        return out.where(F.col("peers") >= least)
    out = per.groupBy("specialty", "state", "code").agg(F.count("*").alias("peers"), F.percentile("payment", [0.5, 0.9, 0.99]).alias("p"), F.percentile("spb", 0.5).alias("median_spb"), F.percentile("charge", 0.5).alias("median_charge"))
    return out.where(F.col("peers") >= least).select("specialty", "state", "code", "peers", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "median_spb", "median_charge")


def provider_benchmarks(providers: DataFrame, least: int = 5, hot: int | None = None) -> DataFrame:
    """As code_benchmarks, for providers' totals; with `hot`, providers without a payment aren't peers."""
    if hot is not None:
        out = _percentiles(providers, ["specialty", "state"], "total_payment", hot).where(F.col("peers") >= least)
        return out.select("specialty", "state", F.lit(None).cast("string").alias("code"), "peers", "p50", "p90", "p99")
    out = providers.groupBy("specialty", "state").agg(F.count("*").alias("peers"), F.percentile("total_payment", [0.5, 0.9, 0.99]).alias("p"))
    return out.where(F.col("peers") >= least).select("specialty", "state", F.lit(None).cast("string").alias("code"), "peers", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))


def layer1(totals: DataFrame, benchmarks: DataFrame, keys: list[str], flag_type: str, year: int, ratio: float = 10.0, cuts: tuple[float, float] = (20.0, 50.0), least: int = 10) -> DataFrame:
    """totals(npi, *keys, total) far above their peers' median."""
    b = benchmarks.where(F.col("peers") >= least).select(*keys, "p50", "p90", "peers")
    r = safe_divide("total", "p50", None)
    out = totals.join(b, keys).withColumn("r", r).where(F.col("r") >= ratio)
    severity = F.when(F.col("r") >= cuts[1], 1).when(F.col("r") >= cuts[0], 2).otherwise(3)
    return out.select(
        "npi", *[k for k in keys if k == "code"], F.lit(flag_type).alias("flag_type"), F.lit(1).alias("layer"), F.lit(year).alias("year"), severity.alias("severity"),
        F.least(0.5 + F.col("r") / 200, F.lit(0.99)).alias("confidence"), F.col("total").alias("flag_value"), F.col("p50").alias("peer_value"), F.greatest(F.col("total") - F.col("p90"), F.lit(0.0)).alias("overpayment"))


def yoy_pairs(totals: DataFrame, year: int) -> DataFrame:
    """totals(npi, specialty, year, payment) -> (npi, specialty, before, now) of providers billing in both years."""
    now = totals.where(F.col("year") == year).select("npi", "specialty", F.col("payment").alias("now"))
    return totals.where(F.col("year") == year - 1).select("npi", F.col("payment").alias("before")).join(now, "npi")


def latest_year(totals: DataFrame) -> int | None:
    """The later of the two latest years that follow each other; None with fewer than two."""
    years = [r[0] for r in totals.select("year").distinct().orderBy(F.desc("year")).limit(2).collect()]
    return years[0] if len(years) == 2 else None


def yoy_surge(totals: DataFrame, year: int, ratio: float = 3.0, floor: float = 100_000.0) -> DataFrame:
    r = safe_divide("now", "before", None)
    out = yoy_pairs(totals, year).withColumn("r", r).where((F.col("r") >= ratio) & (F.col("now") >= floor))
    return out.select("npi", F.lit("yoy_surge").alias("flag_type"), F.lit(5).alias("layer"), F.lit(year).alias("year"), F.when(F.col("r") >= 5, 1).otherwise(2).alias("severity"), F.least(0.4 + F.col("r") / 20, F.lit(0.95)).alias("confidence"), F.col("now").alias("flag_value"), F.col("before").alias("peer_value"), F.greatest(F.col("now") - F.col("before"), F.lit(0.0)).alias("overpayment"))


#: (growth at least, peers' growth at most, severity). Fixed values.
TIERS = [(10.0, 3.0, 1), (4.0, 2.0, 2), (2.0, 1.5, 3)]


def yoy_peer_surge(totals: DataFrame, year: int, floor: float = 10_000.0, tiers: list[tuple[float, float, int]] = TIERS) -> DataFrame:
    """Growth far beyond the median growth of the specialty."""
    pairs = yoy_pairs(totals, year).where(F.col("before") >= floor).withColumn("r", safe_divide("now", "before", None))
    pairs = with_medians(pairs, {"peer": "r"}, ["specialty"]).withColumn("rel", safe_divide("r", "peer", None))
    severity: Column = F.lit(None).cast("int")
    for growth, peer, level in reversed(tiers):
        severity = F.when((F.col("r") >= growth) & (F.col("peer") <= peer), level).otherwise(severity)
    out = pairs.withColumn("severity", severity).where("severity IS NOT NULL")
    return out.select("npi", F.lit("yoy_surge").alias("flag_type"), F.lit(4).alias("layer"), F.lit(year).alias("year"), "severity", F.least(0.5 + (F.col("rel") - 1) * 0.05, F.lit(0.95)).alias("confidence"), F.col("r").alias("flag_value"), F.col("peer").alias("peer_value"), F.greatest(F.col("now") - F.col("before") * F.col("peer"), F.lit(0.0)).alias("overpayment"))


def new_provider_spike(totals: DataFrame, people: DataFrame, benchmarks: DataFrame, as_of: str, months: int = 18, least: int = 10) -> DataFrame:
    """totals(npi, total), people(npi, specialty, state, enrolled): young providers at or above their peers' p90."""
    young = people.where(F.months_between(F.lit(as_of).cast("date"), F.col("enrolled")) <= months)
    b = benchmarks.where(F.col("peers") >= least).select("specialty", "state", "p50", "p90")
    out = totals.join(young, "npi").join(b, ["specialty", "state"]).where("total >= p90")
    return out.select("npi", F.lit("new_provider_spike").alias("flag_type"), F.lit(5).alias("layer"), F.year(F.lit(as_of).cast("date")).alias("year"), F.lit(2).alias("severity"), F.lit(0.8).alias("confidence"), F.col("total").alias("flag_value"), F.col("p90").alias("peer_value"), F.greatest(F.col("total") - F.col("p50"), F.lit(0.0)).alias("overpayment"))


def financial_impact(df: DataFrame) -> DataFrame:
    """expected = peer payment per beneficiary x beneficiaries; excess is what lies above, null if an input is missing or 0."""
    ppb = F.coalesce("peer_median_ppb", safe_divide("peer_median_payment", "peer_median_benes", None))
    ready = (F.col("total_payment") > 0) & (F.col("total_beneficiaries") > 0) & (ppb > 0)
    expected = F.when(ready, ppb * F.col("total_beneficiaries"))
    return df.select("npi", expected.alias("expected"), F.greatest(F.lit(0.0), F.col("total_payment") - expected).alias("excess"), safe_divide("total_payment", expected, None).alias("ratio"))


def exposure(flags: DataFrame, df: DataFrame) -> DataFrame:
    """Sum of positive overpayments, or else what lies above the peers' median."""
    paid = flags.where("overpayment > 0").groupBy("npi").agg(F.sum("overpayment").alias("over"))
    return df.join(paid, "npi", "left").select("npi", F.coalesce("over", F.greatest(F.lit(0.0), F.col("total_payment") - F.col("peer_median_payment")), F.lit(0.0)).alias("exposure"))


#: Services per beneficiary (critical, high) of specialties that deliver many by their nature. Fixed values.
INTENSITY = {
    "clinical laboratory": (200, 100), "independent laboratory": (200, 100), "pathology": (120, 60), "diagnostic radiology": (100, 50), "radiology": (100, 50),
    "nuclear medicine": (80, 40), "radiation oncology": (60, 30), "physical therapy": (50, 25), "physical medicine": (50, 25), "chiropractic": (50, 25),
    "optometry": (40, 20), "ophthalmology": (40, 20), "durable medical equipment": (200, 100), "home health": (80, 40), "skilled nursing facility": (80, 40),
}
#: For all others.
OFFICE = (15, 8)


def row_flags(df: DataFrame, volume: tuple[float, float] = (5, 3), services: tuple[float, float] = (5, 3), benes: tuple[float, float] = (4, 2.5), z: tuple[float, float] = (6, 3), cost: tuple[float, float] = (4, 2.5), coding: tuple[float, float] = (0.85, 0.7), intensity: dict[str, tuple[float, float]] | None = None, most: int = 3, office: tuple[float, float] = OFFICE) -> DataFrame:
    """df -> (npi, flags array<struct<type, severity>>): critical first, at most three; exclusion alone if excluded."""
    level = lambda c, cut: F.when(F.col(c) >= cut[0], F.lit("critical")).when(F.col(c) >= cut[1], F.lit("high"))
    dense = level("services_per_bene", office)
    for name, cut in (INTENSITY if intensity is None else intensity).items():
        dense = F.when(F.lower(F.trim("specialty")) == name, level("services_per_bene", cut)).otherwise(dense)
    months = F.col("months_enrolled")
    found = [
        ("opt_out_billing", F.when((F.col("is_opt_out") == 1) & (F.col("total_payment") > 0), F.lit("critical"))),
        ("new_provider_spike", F.when((months > 0) & (months < 12), level("payment_vs_peer", (5, 3)))),
        ("billing_volume", level("payment_vs_peer", volume)),
        ("service_pattern", level("services_vs_peer", services)),
        ("beneficiary_volume", level("benes_vs_peer", benes)),
        ("statistical_outlier", F.when(level("payment_vs_peer", volume).isNull(), level("payment_zscore", z))),
        ("cost_per_patient", F.when(F.col("payment_per_bene") > 500, level("ppb_vs_peer", cost))),
        ("service_intensity", dense),
        ("em_upcoding", level("level5_ratio", coding)),
    ]
    every = F.array(*(F.when(s.isNotNull(), F.struct(F.when(s == "critical", 0).otherwise(1).alias("rank"), F.lit(n).alias("n"), F.lit(t).alias("type"), s.alias("severity"))) for n, (t, s) in enumerate(found)))
    kept = F.slice(F.array_sort(F.filter(every, lambda x: x.isNotNull())), 1, most)
    kept = F.transform(kept, lambda x: F.struct(x["type"].alias("type"), x["severity"].alias("severity")))
    alone = F.array(F.struct(F.lit("leie_exclusion").alias("type"), F.lit("critical").alias("severity")))
    return df.select("npi", F.when(F.col("excluded"), alone).otherwise(kept).alias("flags"))


#: Severity of the row flags' words as numbers. Fixed values.
LEVELS = {"critical": 1, "high": 2, "medium": 3}


def flags_to_rows(flagged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(npi, flags) -> (npi, flag_type, severity), without those that exist already."""
    rows = flagged.select("npi", F.explode("flags").alias("f"))
    table = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    rows = rows.select("npi", F.col("f.type").alias("flag_type"), F.coalesce(F.try_element_at(table, F.col("f.severity")), F.lit(3)).alias("severity"))
    return rows if existing is None else rows.join(existing.select("npi", "flag_type"), ["npi", "flag_type"], "left_anti")


def annualised(payment, months) -> Column:
    """What a part of a year comes to over twelve months; whole years stay."""
    return F.when((months > 0) & (months < 12), payment * 12 / months).otherwise(payment)


def severity_breakdown(flags: DataFrame, layer: int | None = None, year: int | None = None) -> DataFrame:
    """(severity, n) of the active flags of a layer and year."""
    for column, value in (("layer", layer), ("year", year)):
        if value is not None:
            flags = flags.where(F.col(column) == value)
    return flags.where("is_active").groupBy("severity").agg(F.count("*").alias("n"))


def exclusion_timing(df: DataFrame, first: str = "first_bill", last: str = "last_bill", excluded: str = "excldate") -> DataFrame:
    """PREDATES, DURING or POSTDATES the billing period, and years between exclusion and the last bill."""
    day = F.try_to_timestamp(F.col(excluded), F.lit("yyyyMMdd")).cast("date")
    word = F.when(day < F.col(first), "PREDATES").when(day > F.col(last), "POSTDATES").when(day.isNotNull(), "DURING")
    return df.select("npi", word.alias("timing"), F.round(F.datediff(F.col(last), day) / 365.25, 2).alias("years"))
