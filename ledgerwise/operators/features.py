"""Peer features: entropy, ratios, medians with fallback, z-scores, year-over-year change, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, safe_divide
from ..sources.staging import written
from .peers import with_medians, with_peer_medians, with_z_score

FINE, COARSE = ["specialty", "state"], ["specialty"]
#: Model inputs; the exclusion flag is never one of them.
MODEL_COLUMNS = [
    "total_payment_log", "total_services_log", "payment_per_bene_norm", "procedure_types_norm", "services_per_bene", "payment_vs_peer", "services_vs_peer",
    "benes_vs_peer", "payment_zscore", "billing_entropy", "level5_ratio", "ppb_vs_peer", "payment_per_service_vs_peer", "is_opt_out", "months_enrolled",
    "is_sole_proprietor", "months_since_enumeration", "hotspot_state", "yoy_payment_change",
]


def billing_entropy(lines: DataFrame) -> DataFrame:
    """(npi, billing_entropy): Shannon entropy in bits of services over codes, 4 digits; 0 without services."""
    per_code = lines.groupBy("npi", "code").agg(F.sum("services").alias("s"))
    share = per_code.withColumn("all", F.sum("s").over(Window.partitionBy("npi")))
    p = safe_divide("s", "all")
    out = share.groupBy("npi").agg(F.round(F.sum(-p * F.log2(p + 1e-10)), 4).alias("e"), F.max("all").alias("all"))
    return out.select("npi", F.when(F.col("all") > 0, F.col("e") + 0.0).otherwise(0.0).alias("billing_entropy"))


def level5_ratio(lines: DataFrame, family: list[str], level5: list[str]) -> DataFrame:
    """(npi, level5_ratio): services on the top codes over services on the whole family, 3 digits."""
    of = lambda codes: F.sum(F.when(F.col("code").isin(codes), F.col("services")).otherwise(0.0))
    return lines.groupBy("npi").agg(F.round(safe_divide(of(level5), of(family)), 3).alias("level5_ratio"))


def with_code_features(providers: DataFrame, lines: DataFrame, family: list[str], level5: list[str]) -> DataFrame:
    """providers with billing_entropy and level5_ratio; 0 for those without lines."""
    out = providers.join(billing_entropy(lines), "npi", "left").join(level5_ratio(lines, family, level5), "npi", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("billing_entropy", "level5_ratio")})


def peer_features(providers: DataFrame, least: int = 10) -> DataFrame:
    """Ratios to peer medians, z-scores and logs. The z-score's group is the coarse one only if no fine group is large enough."""
    p = providers.where("total_payment > 0 AND total_services > 0 AND total_beneficiaries > 0")
    p = p.withColumns({
        "services_per_bene": safe_divide("total_services", "total_beneficiaries"), "payment_per_bene": safe_divide("total_payment", "total_beneficiaries"),
        "payment_per_service": safe_divide("total_payment", "total_services")})
    p = written(p, "providers")  # its groups are counted thrice
    medians = {"payment": "total_payment", "services": "total_services", "benes": "total_beneficiaries", "ppb": "payment_per_bene", "pps": "payment_per_service"}
    p = with_peer_medians(p, {f"peer_median_{k}": c for k, c in medians.items()}, FINE, COARSE, least)
    p = p.withColumns({
        "payment_vs_peer": safe_divide("total_payment", "peer_median_payment", 1.0), "services_vs_peer": safe_divide("total_services", "peer_median_services", 1.0),
        "benes_vs_peer": safe_divide("total_beneficiaries", "peer_median_benes", 1.0), "ppb_vs_peer": safe_divide("payment_per_bene", "peer_median_ppb", 1.0),
        "payment_per_service_vs_peer": clip(safe_divide("payment_per_service", "peer_median_pps", 1.0), high=50)})
    fine = p.groupBy(*FINE).count().agg(F.max("count")).first()[0] or 0
    p = with_z_score(p, "total_payment", FINE if fine >= least else COARSE, "payment_zscore")
    p = p.withColumn("payment_zscore", clip("payment_zscore", -10, 50))
    logs = {"total_payment_log": "total_payment", "total_services_log": "total_services", "payment_per_bene_norm": "payment_per_bene", "procedure_types_norm": "procedure_types"}
    p = p.withColumns({k: F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for k, c in logs.items()})
    p = p.withColumn("payment_vs_peer_raw", F.col("payment_vs_peer"))
    return p.withColumns({c: clip(c, high=100) for c in ("payment_vs_peer", "services_vs_peer", "benes_vs_peer", "ppb_vs_peer")})


def median_impute(df: DataFrame, column: str, by: list[str], default: float = 0.0) -> DataFrame:
    return with_medians(df, {"_m": column}, by).withColumn(column, F.coalesce(column, "_m", F.lit(default))).drop("_m")


def yoy_change(totals: DataFrame, year: int, by: list[str] = COARSE) -> DataFrame:
    """totals(npi, specialty, year, payment) -> (npi, yoy_payment_change): clipped growth over the year before, less the peers' median."""
    now = totals.where(F.col("year") == year)
    before = totals.where(F.col("year") == year - 1).select("npi", F.col("payment").alias("before"))
    both = now.join(before, "npi", "left")
    growth = clip((F.col("payment") - F.col("before")) / F.greatest("before", F.lit(1.0)), -1, 10)
    both = with_medians(both.withColumn("growth", growth), {"_m": "growth"}, by)
    return both.select("npi", F.coalesce(clip(F.col("growth") - F.coalesce("_m", F.lit(0.0)), -1, 5), F.lit(0.0)).alias("yoy_payment_change"))


def enrich(features: DataFrame, registry: DataFrame | None, as_of: str = "2022-12-31", hotspots: list[str] = (), months_default: float = 120.0) -> DataFrame:
    """Registry columns; missing rows get the global median age and 0, a missing registry constants."""
    if registry is None:
        out = features.withColumns({"months_since_enumeration": F.lit(months_default), "is_sole_proprietor": F.lit(0)})
    else:
        born = F.try_to_timestamp(F.col("enumeration_date"), F.lit("MM/dd/yyyy")).cast("date")
        months = F.coalesce(F.greatest(F.datediff(F.lit(as_of).cast("date"), born) / 30.4375, F.lit(0.0)), F.lit(0.0))
        r = registry.select("npi", months.alias("months_since_enumeration"), (F.upper(F.trim("is_sole_proprietor")) == "Y").cast("int").alias("is_sole_proprietor"))
        middle = r.agg(F.coalesce(F.median("months_since_enumeration"), F.lit(months_default)).alias("_m"))
        out = features.join(r, "npi", "left").crossJoin(F.broadcast(middle))  # one row
        out = out.withColumns({"months_since_enumeration": F.coalesce("months_since_enumeration", "_m"), "is_sole_proprietor": F.coalesce("is_sole_proprietor", F.lit(0))}).drop("_m")
    defaults = {"is_opt_out": 0.0, "months_enrolled": 12.0}
    out = out.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in out.columns})
    pv = next((F.col(c) for c in ("payment_vs_peer_raw", "payment_vs_peer") if c in out.columns), F.lit(0.0))
    return out.withColumns({
        "months_enrolled": F.coalesce(clip("months_enrolled", 0, 12), F.lit(12.0)), "hotspot_state": F.col("state").isin(list(hotspots)).cast("double") if hotspots else F.lit(0.0),
        "new_provider_high_volume": ((F.col("months_since_enumeration") <= 24) & (pv >= 5)).cast("double")})
