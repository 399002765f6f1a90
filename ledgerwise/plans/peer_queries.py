"""Queries: features, benchmarks, detectors, scores and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clip
from ..operators import detectors, features, scoring
from ..operators.peers import with_medians, with_peer_medians, with_z_score
from ..sources.staging import written
from .registry import FLAGS, LABELS, LINES, PEOPLE, PROV, SCORED, TIER, TOTALS, fixtures, flags, labels, query, scored, scored_by_provider, totals

GROUPS = "FROM prov WINDOW f AS (PARTITION BY specialty, state), c AS (PARTITION BY specialty)"


@query(f"""WITH {PROV} SELECT npi, specialty, state, round(m, 2) AS peer_median_payment, round(total_payment / m, 4) AS payment_vs_peer
FROM (SELECT *, CASE WHEN count(total_payment) OVER f >= 10 THEN median(total_payment) OVER f ELSE median(total_payment) OVER c END AS m {GROUPS}) WHERE total_payment / m >= 1.3""")
def peer_ratio_fallback(spark, d):
    p = with_peer_medians(written(fixtures.providers(spark, d), "providers"), {"m": "total_payment"}, features.FINE, features.COARSE)
    r = F.col("total_payment") / F.col("m")
    return p.where(r >= 1.3).select("npi", "specialty", "state", F.round("m", 2).alias("peer_median_payment"), F.round(r, 4).alias("payment_vs_peer"))


@query(f"""WITH {PROV}, s AS (SELECT max(n) >= 10 AS fine FROM (SELECT count(*) AS n FROM prov GROUP BY specialty, state))
SELECT npi, round(coalesce(CASE WHEN fine THEN (total_payment - fa) / nullif(fs, 0) ELSE (total_payment - ca) / nullif(cs, 0) END, 0), 4) + 0.0 AS z
FROM (SELECT *, avg(total_payment) OVER f AS fa, stddev_samp(total_payment) OVER f AS fs, avg(total_payment) OVER c AS ca, stddev_samp(total_payment) OVER c AS cs {GROUPS}), s""")
def peer_zscore(spark, d):
    return features.peer_features(fixtures.providers(spark, d)).select("npi", (F.round("payment_zscore", 4) + 0.0).alias("z"))


@query(f"""WITH {PROV} SELECT npi, round(ln(1 + total_payment), 4) AS total_payment_log, round(ln(1 + total_services), 4) AS total_services_log,
round(ln(1 + total_payment / total_beneficiaries), 4) AS payment_per_bene_norm, round(ln(1 + procedure_types), 4) AS procedure_types_norm FROM prov""")
def log_features(spark, d):
    names = ["total_payment_log", "total_services_log", "payment_per_bene_norm", "procedure_types_norm"]
    return features.peer_features(fixtures.providers(spark, d)).select("npi", *(F.round(c, 4).alias(c) for c in names))


@query(f"""WITH {PROV}, r AS (SELECT *, total_services / total_beneficiaries AS spb, total_payment / total_beneficiaries AS ppb, total_payment / total_services AS pps FROM prov),
m AS (SELECT *, {", ".join(f"CASE WHEN count({c}) OVER f >= 10 THEN median({c}) OVER f ELSE median({c}) OVER k END AS m_{c}" for c in ("total_payment", "total_services", "total_beneficiaries", "ppb", "pps"))}
FROM r WINDOW f AS (PARTITION BY specialty, state), k AS (PARTITION BY specialty))
SELECT npi, round(spb, 4) AS services_per_bene, round(total_services / m_total_services, 4) AS services_vs_peer, round(total_beneficiaries / m_total_beneficiaries, 4) AS benes_vs_peer,
round(ppb / m_ppb, 4) AS ppb_vs_peer, round(least(pps / m_pps, 50), 4) AS payment_per_service_vs_peer FROM m""")
def ratio_features(spark, d):
    names = ["services_per_bene", "services_vs_peer", "benes_vs_peer", "ppb_vs_peer", "payment_per_service_vs_peer"]
    return features.peer_features(fixtures.providers(spark, d)).select("npi", *(F.round(c, 4).alias(c) for c in names))


@query(f"""WITH {PROV}, b AS (SELECT npi, specialty, CASE WHEN npi % 4 = 0 THEN NULL ELSE procedure_types * 1.0 END AS x FROM prov)
SELECT npi, CAST(coalesce(x, median(x) OVER (PARTITION BY specialty), 0) AS DOUBLE) AS x FROM b""")
def group_median_impute(spark, d):
    p = fixtures.providers(spark, d).select("npi", "specialty", F.when(F.col("npi") % 4 != 0, F.col("procedure_types").cast("double")).alias("x"))
    return features.median_impute(p, "x", features.COARSE).select("npi", "x")


@query(f"""WITH {LINES}, s AS (SELECT npi, code, sum(services) AS s FROM lines GROUP BY 1, 2), t AS (SELECT *, s / sum(s) OVER (PARTITION BY npi) AS p FROM s)
SELECT npi, round(sum(-p * log2(p + 1e-10)), 4) + 0.0 AS billing_entropy FROM t GROUP BY npi""")
def billing_entropy(spark, d):
    return features.billing_entropy(fixtures.lines(spark, d))


FAMILY, LEVEL5 = [f"Brand#{i}" for i in range(1, 6)], ["Brand#4", "Brand#5"]


@query(f"""WITH {LINES} SELECT npi, round(coalesce(sum(CASE WHEN code IN ('Brand#4', 'Brand#5') THEN services ELSE 0 END) / nullif(sum(CASE WHEN code IN ({", ".join(f"'{x}'" for x in FAMILY)}) THEN services ELSE 0 END), 0), 0), 3) AS level5_ratio FROM lines GROUP BY npi""")
def level5_ratio(spark, d):
    return features.level5_ratio(fixtures.lines(spark, d), FAMILY, LEVEL5)


@query(f"""WITH {PROV} SELECT specialty, state, count(*) AS peers, round(quantile_cont(total_payment, 0.5), 6) AS p50, round(quantile_cont(total_payment, 0.9), 6) AS p90, round(quantile_cont(total_payment, 0.99), 6) AS p99
FROM prov GROUP BY 1, 2 HAVING count(*) >= 5""")
def provider_benchmarks(spark, d):
    return detectors.provider_benchmarks(fixtures.providers(spark, d)).select("specialty", "state", "peers", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")))


CODE = f"""{LINES}, {PEOPLE}, per AS (SELECT specialty, state, code, npi, CAST(sum(payment) AS DOUBLE) AS payment, sum(services) / count(DISTINCT bene) AS spb, avg(CAST(charge AS DOUBLE)) AS charge FROM lines JOIN people USING (npi) GROUP BY 1, 2, 3, 4),
bench AS (SELECT specialty, state, code, count(*) AS peers, quantile_cont(payment, 0.5) AS p50, quantile_cont(payment, 0.9) AS p90, quantile_cont(payment, 0.99) AS p99, quantile_cont(spb, 0.5) AS median_spb, quantile_cont(charge, 0.5) AS median_charge FROM per GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


def _lines(spark, d):
    return fixtures.lines_by_provider(spark, d).join(fixtures.people(spark, d).select("npi", "specialty", "state"), "npi")


@query(f"WITH {CODE} SELECT specialty, state, code, peers, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(median_spb, 4) AS median_spb, round(median_charge, 5) AS median_charge FROM bench")
def code_benchmarks(spark, d):
    b = detectors.code_benchmarks(_lines(spark, d))
    return b.select("specialty", "state", "code", "peers", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), F.round("p99", 6).alias("p99"), F.round("median_spb", 4).alias("median_spb"), F.round("median_charge", 5).alias("median_charge"))


@query(f"""WITH {PROV}, b AS (SELECT specialty, state, count(*) AS peers, quantile_cont(total_payment, 0.5) AS p50, quantile_cont(total_payment, 0.9) AS p90 FROM prov GROUP BY 1, 2 HAVING count(*) >= 10),
r AS (SELECT npi, total_payment / p50 AS r, greatest(total_payment - p90, 0) AS over FROM prov JOIN b USING (specialty, state))
SELECT npi, CASE WHEN r >= 2.0 THEN 1 WHEN r >= 1.6 THEN 2 ELSE 3 END AS severity, round(least(0.5 + r / 200, 0.99), 4) AS confidence, round(over, 6) AS overpayment FROM r WHERE r >= 1.3""")
def layer1_provider(spark, d):
    p = fixtures.providers(spark, d)
    out = detectors.layer1(p.withColumnRenamed("total_payment", "total"), detectors.provider_benchmarks(p), ["specialty", "state"], "billing_volume", 2000, 1.3, (1.6, 2.0))
    return out.select("npi", "severity", F.round("confidence", 4).alias("confidence"), F.round("overpayment", 6).alias("overpayment"))


@query(f"""WITH {CODE}, r AS (SELECT npi, code, payment / p50 AS r, greatest(payment - p90, 0) AS over FROM per JOIN bench USING (specialty, state, code) WHERE peers >= 10)
SELECT npi, code, CASE WHEN r >= 4.0 THEN 1 WHEN r >= 3.0 THEN 2 ELSE 3 END AS severity, round(over, 6) AS overpayment FROM r WHERE r >= 2.5""")
def layer1_code(spark, d):
    rows = _lines(spark, d)
    per = rows.groupBy("specialty", "state", "code", "npi").agg(F.sum("payment").cast("double").alias("total"))
    out = detectors.layer1(per, detectors.code_benchmarks(rows), ["specialty", "state", "code"], "code_volume", 2000, 2.5, (3.0, 4.0))
    return out.select("npi", "code", "severity", F.round("overpayment", 6).alias("overpayment"))


PAIRS = f"{TOTALS}, y AS (SELECT a.npi, a.specialty, b.payment AS before, a.payment AS now, a.payment / b.payment AS r FROM totals a JOIN totals b ON a.npi = b.npi AND a.year = 2000 AND b.year = 1999)"


@query(f"WITH {PAIRS} SELECT npi, CASE WHEN r >= 5 THEN 1 ELSE 2 END AS severity, round(least(0.4 + r / 20, 0.95), 4) AS confidence, round(greatest(now - before, 0), 6) AS overpayment FROM y WHERE r >= 3 AND now >= 100000")
def yoy_surge(spark, d):
    return detectors.yoy_surge(totals(spark, d), 2000).select("npi", "severity", F.round("confidence", 4).alias("confidence"), F.round("overpayment", 6).alias("overpayment"))


@query(f"""WITH {PAIRS}, m AS (SELECT *, median(r) OVER (PARTITION BY specialty) AS peer FROM y WHERE before >= 10000),
t AS (SELECT *, CASE WHEN r >= 10 AND peer <= 3 THEN 1 WHEN r >= 4 AND peer <= 2 THEN 2 WHEN r >= 2 AND peer <= 1.5 THEN 3 END AS severity FROM m)
SELECT npi, severity, round(least(0.5 + (r / peer - 1) * 0.05, 0.95), 4) AS confidence, round(greatest(now - before * peer, 0), 6) AS overpayment FROM t WHERE severity IS NOT NULL""")
def yoy_peer_surge(spark, d):
    return detectors.yoy_peer_surge(totals(spark, d), 2000).select("npi", "severity", F.round("confidence", 4).alias("confidence"), F.round("overpayment", 6).alias("overpayment"))


@query(f"""WITH {TOTALS}, g AS (SELECT a.npi, a.specialty, CASE WHEN b.payment IS NOT NULL THEN least(greatest((a.payment - b.payment) / greatest(b.payment, 1), -1), 10) END AS g FROM totals a LEFT JOIN totals b ON a.npi = b.npi AND b.year = 1999 WHERE a.year = 2000)
SELECT npi, round(coalesce(CASE WHEN g IS NOT NULL THEN least(greatest(g - coalesce(median(g) OVER (PARTITION BY specialty), 0), -1), 5) END, 0), 4) + 0.0 AS yoy_payment_change FROM g""")
def yoy_payment_change(spark, d):
    return features.yoy_change(totals(spark, d), 2000).select("npi", (F.round("yoy_payment_change", 4) + 0.0).alias("yoy_payment_change"))


@query(f"""WITH {PROV}, b AS (SELECT specialty, state, quantile_cont(total_payment, 0.5) AS p50, quantile_cont(total_payment, 0.9) AS p90 FROM prov GROUP BY 1, 2 HAVING count(*) >= 10), e AS (SELECT o_custkey AS npi, min(CAST(o_orderdate AS DATE)) AS enrolled FROM orders GROUP BY 1)
SELECT npi, round(greatest(total_payment - p50, 0), 6) AS overpayment FROM prov JOIN e USING (npi) JOIN b USING (specialty, state) WHERE enrolled > DATE '1995-03-01' AND total_payment >= p90""")
def new_provider_spike(spark, d):
    p = fixtures.providers(spark, d)
    first = fixtures.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("npi")).agg(F.min("o_orderdate").cast("date").alias("enrolled"))
    young = p.select("npi", "specialty", "state").join(first.where("enrolled > DATE'1995-03-01'"), "npi")
    out = detectors.new_provider_spike(p.select("npi", F.col("total_payment").alias("total")), young, detectors.provider_benchmarks(p), "2002-01-01", 1000)
    return out.select("npi", F.round("overpayment", 6).alias("overpayment"))


@query(f"""WITH {SCORED} SELECT npi, round(med_ppb * total_beneficiaries, 6) AS expected, round(greatest(0, total_payment - med_ppb * total_beneficiaries), 6) AS excess, round(total_payment / (med_ppb * total_beneficiaries), 4) AS ratio FROM scored""")
def financial_impact(spark, d):
    p = scored(spark, d).withColumns({"peer_median_ppb": F.col("med_ppb"), "peer_median_payment": F.col("med"), "peer_median_benes": F.lit(1)})
    return detectors.financial_impact(p).select("npi", F.round("expected", 6).alias("expected"), F.round("excess", 6).alias("excess"), F.round("ratio", 4).alias("ratio"))


@query(f"""WITH {FLAGS} SELECT npi, round(coalesce(o, greatest(0, total_payment - med)), 6) AS exposure FROM scored LEFT JOIN (SELECT npi, sum(overpayment) AS o FROM flags WHERE overpayment > 0 GROUP BY 1) USING (npi)""")
def exposure(spark, d):
    p = scored_by_provider(spark, d)
    return detectors.exposure(flags(p), p.withColumn("peer_median_payment", F.col("med"))).select("npi", F.round("exposure", 6).alias("exposure"))


@query(f"WITH {SCORED} SELECT npi, risk_score, {TIER} AS risk_tier FROM scored")
def risk_tiers(spark, d):
    return scored(spark, d).select("npi", "risk_score", scoring.tier(F.col("risk_score")).alias("risk_tier"))


@query(f"""WITH {SCORED} SELECT npi, round(CASE WHEN specialty IN ('BUILDING', 'MACHINERY') AND NOT excluded THEN risk_score * CASE WHEN pv < 1 THEN 0.15 WHEN pv < 1.2 THEN 0.45 WHEN pv < 1.5 THEN 0.75 ELSE 1 END ELSE risk_score END, 4) AS score FROM scored""")
def volume_discount(spark, d):
    scale = F.when(F.col("pv") < 1, 1.0).when(F.col("pv") < 1.2, 3.0).when(F.col("pv") < 1.5, 10.0).otherwise(20.0)
    return scored(spark, d).select("npi", F.round(scoring.volume_discount(F.col("risk_score"), F.col("specialty"), scale, F.col("excluded"), ["BUILDING", "MACHINERY"]), 4).alias("score"))


@query(f"""WITH {SCORED}, r AS (SELECT npi, risk_score / 100 AS s, (row_number() OVER (ORDER BY risk_score / 100, npi) - 1) AS k, count(*) OVER () AS n FROM scored), c AS (SELECT s AS c0 FROM r WHERE k = CAST(floor(0.95 * (n - 1)) AS BIGINT))
SELECT npi, round(CASE WHEN n >= 100 AND k / greatest(n - 1, 1) >= 0.95 THEN c0 + (1 - c0) * pow((k / greatest(n - 1, 1) - 0.95) / (1 - 0.95), 0.6) ELSE s END, 6) AS score FROM r, c""")
def top_tail_stretch(spark, d):
    p = scored(spark, d).select("npi", (F.col("risk_score") / 100).alias("s"))
    return scoring.top_tail_stretch(p, "s", "npi").select("npi", F.round("stretched", 6).alias("score"))


@query(f"WITH {SCORED} SELECT npi, row_number() OVER (ORDER BY risk_score, npi) AS rank FROM scored")
def ordinal_rank(spark, d):
    return scoring.ordinal_rank(scored(spark, d).select("npi", "risk_score"), ["risk_score", "npi"]).select("npi", "rank")


@query(f"WITH {SCORED} SELECT npi, round(0.5 * risk_score / 100 + 0.3 * least(pv / 3, 1) + 0.2 * least(ppb_vs_peer / 3, 1), 4) AS score FROM scored")
def composite(spark, d):
    p = scored(spark, d)
    return p.select("npi", F.round(scoring.composite(F.col("risk_score") / 100, F.least(F.col("pv") / 3, F.lit(1.0)), F.least(F.col("ppb_vs_peer") / 3, F.lit(1.0))), 4).alias("score"))


ROWFLAGS = f"""{SCORED}, m AS (SELECT *, total_services / median(total_services) OVER (PARTITION BY specialty) AS sv, total_beneficiaries / median(total_beneficiaries) OVER (PARTITION BY specialty) AS bv,
  coalesce((total_payment - avg(total_payment) OVER (PARTITION BY specialty)) / nullif(stddev_samp(total_payment) OVER (PARTITION BY specialty), 0), 0) AS z,
  total_services / total_beneficiaries AS spb, npi % 17 AS months, npi % 41 = 0 AS opt, (npi * 13 % 100) / 100.0 AS lv5 FROM scored),
u AS (SELECT npi, 0 AS n, 'opt_out_billing' AS t, 'critical' AS s FROM m WHERE NOT excluded AND opt AND total_payment > 0
UNION ALL SELECT npi, 1, 'new_provider_spike', CASE WHEN pv >= 5 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND months > 0 AND months < 12 AND pv >= 3
UNION ALL SELECT npi, 2, 'billing_volume', CASE WHEN pv >= 1.5 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND pv >= 1.2
UNION ALL SELECT npi, 3, 'service_pattern', CASE WHEN sv >= 1.5 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND sv >= 1.2
UNION ALL SELECT npi, 4, 'beneficiary_volume', CASE WHEN bv >= 1.5 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND bv >= 1.2
UNION ALL SELECT npi, 5, 'statistical_outlier', CASE WHEN z >= 0.4 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND pv < 1.2 AND z >= 0.2
UNION ALL SELECT npi, 6, 'cost_per_patient', CASE WHEN ppb_vs_peer >= 1.3 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND ppb_vs_peer >= 1.1 AND total_payment / total_beneficiaries > 500
UNION ALL SELECT npi, 7, 'service_intensity', CASE WHEN spb >= CASE WHEN specialty = 'BUILDING' THEN 140 ELSE 120 END THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND spb >= CASE WHEN specialty = 'BUILDING' THEN 120 ELSE 110 END
UNION ALL SELECT npi, 8, 'em_upcoding', CASE WHEN lv5 >= 0.85 THEN 'critical' ELSE 'high' END FROM m WHERE NOT excluded AND lv5 >= 0.7),
k AS (SELECT npi, t AS flag_type, s AS severity FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY s <> 'critical', n) AS r FROM u) WHERE r <= 3 UNION ALL SELECT npi, 'leie_exclusion', 'critical' FROM m WHERE excluded)"""


def _flagged(spark, d):
    p = scored(spark, d)
    p = with_z_score(with_medians(p, {"_s": "total_services", "_b": "total_beneficiaries"}, ["specialty"]), "total_payment", ["specialty"], "payment_zscore")
    p = p.withColumns({
        "payment_vs_peer": F.col("pv"), "services_vs_peer": F.col("total_services") / F.col("_s"), "benes_vs_peer": F.col("total_beneficiaries") / F.col("_b"), "payment_per_bene": F.col("total_payment") / F.col("total_beneficiaries"),
        "services_per_bene": F.col("total_services") / F.col("total_beneficiaries"), "level5_ratio": (F.col("npi") * 13 % 100) / F.lit(100.0), "months_enrolled": (F.col("npi") % 17).cast("double"), "is_opt_out": (F.col("npi") % 41 == 0).cast("double")})
    return detectors.row_flags(p, volume=(1.5, 1.2), services=(1.5, 1.2), benes=(1.5, 1.2), z=(0.4, 0.2), cost=(1.3, 1.1), intensity={"building": (140, 120)}, office=(120, 110))


@query(f"WITH {ROWFLAGS} SELECT * FROM k")
def flag_array(spark, d):
    return _flagged(spark, d).select("npi", F.explode("flags").alias("f")).select("npi", F.col("f.type").alias("flag_type"), F.col("f.severity").alias("severity"))


@query(f"WITH {ROWFLAGS} SELECT npi, flag_type, CASE severity WHEN 'critical' THEN 1 ELSE 2 END AS severity FROM k WHERE NOT (flag_type = 'billing_volume' AND npi % 2 = 0)")
def flags_explode_migrate(spark, d):
    known = fixtures.people(spark, d).where("npi % 2 = 0").select("npi", F.lit("billing_volume").alias("flag_type"))
    return detectors.flags_to_rows(_flagged(spark, d), known)


@query(f"""WITH {FLAGS} SELECT npi, coalesce(w, {TIER}) AS risk_tier, coalesce(n, 0) AS flag_count FROM scored LEFT JOIN (SELECT npi, min(severity) AS w, count(*) AS n FROM flags WHERE is_active GROUP BY 1) USING (npi)""")
def flag_counts(spark, d):
    p = scored_by_provider(spark, d)
    return scoring.tier_from_flags(p.select("npi", scoring.tier(F.col("risk_score")).alias("risk_tier")), flags(p))


EXCL = "ex AS (SELECT c_custkey AS npi, strftime(min(o_orderdate), '%Y%m%d') AS excldate, min(CAST(o_orderdate AS DATE)) AS first_bill, max(CAST(o_orderdate AS DATE)) AS last_bill FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 GROUP BY 1)"


def _exclusions(spark, d):
    o = fixtures.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("npi")).agg(F.min("o_orderdate").cast("date").alias("first_bill"), F.max("o_orderdate").cast("date").alias("last_bill"))
    return fixtures.people(spark, d).where("balance < 0").select("npi").join(o, "npi").withColumn("excldate", F.date_format("first_bill", "yyyyMMdd"))


@query(f"WITH {EXCL} SELECT npi, CASE WHEN excldate < '19960101' THEN 'train' ELSE 'holdout' END AS part FROM ex")
def temporal_labels(spark, d):
    return scoring.temporal_split(_exclusions(spark, d), "19960101")


@query(f"""WITH {SCORED}, {EXCL}, p AS (SELECT scored.npi, pv, ppb_vs_peer, excldate FROM scored LEFT JOIN ex ON scored.npi = ex.npi WHERE excldate IS NULL OR excldate < '19960101'),
k AS (SELECT npi, CASE WHEN npi % 29 = 0 THEN 'cleared' WHEN npi % 31 = 0 THEN 'investigator' WHEN excldate IS NOT NULL THEN 'exclusion' WHEN ppb_vs_peer >= 1.3 THEN 'soft' ELSE 'none' END AS kind FROM p)
SELECT npi, kind, CAST(kind IN ('investigator', 'exclusion', 'soft') AS INT) AS label, CASE kind WHEN 'cleared' THEN 3.0 WHEN 'investigator' THEN 7.0 WHEN 'exclusion' THEN 5.0 WHEN 'soft' THEN 0.2 ELSE 1.0 END::DOUBLE AS weight FROM k""")
def soft_labels_weights(spark, d):
    p = scored(spark, d).select("npi", "ppb_vs_peer", F.col("pv").alias("payment_vs_peer"), F.lit(0.0).alias("level5_ratio"), F.lit(1.0).alias("billing_entropy"))
    split = scoring.temporal_split(_exclusions(spark, d), "19960101")
    return scoring.labelled(p, split, p.where("npi % 31 = 0"), p.where("npi % 29 = 0"), ppb=1.3).select("npi", "kind", "label", "weight")


@query(f"WITH {EXCL} SELECT npi, CASE WHEN npi % 3 = 0 THEN 'PREDATES' WHEN npi % 3 = 1 THEN 'DURING' ELSE 'POSTDATES' END AS timing FROM ex")
def exclusion_timing(spark, d):
    shift = F.when(F.col("npi") % 3 == 0, F.date_sub("first_bill", 1)).when(F.col("npi") % 3 == 1, F.col("last_bill")).otherwise(F.date_add("last_bill", 9))
    return detectors.exclusion_timing(_exclusions(spark, d).withColumn("excldate", F.date_format(shift, "yyyyMMdd"))).select("npi", "timing")


@query(f"""WITH {LABELS}, t AS (SELECT unnest(range(30, 100, 5)) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label <> 1) AS tn FROM marks, t GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall FROM c""")
def threshold_report(spark, d):
    out = scoring.threshold_report(labels(spark, d))
    return out.select("threshold", "tp", "fp", "fn", "tn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query(f"""WITH {LABELS} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 8) AS roc_auc FROM marks a, marks b WHERE a.label = 1 AND b.label <> 1""")
def roc_auc_exact(spark, d):
    return scoring.roc_auc(labels(spark, d)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query(f"""WITH {LABELS}, s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM marks GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(cp / cn * pos) / sum(pos), 8) AS average_precision FROM c""")
def average_precision(spark, d):
    return scoring.average_precision(labels(spark, d)).select(F.round("average_precision", 8).alias("average_precision"))


@query(f"WITH {PROV} SELECT npi, round(greatest(-1.0, least(2.0, (total_payment - 1000000) / 1000000)), 4) + 0.0 AS clipped FROM prov")
def clipped(spark, d):
    return fixtures.providers(spark, d).select("npi", (F.round(clip((F.col("total_payment") - 1_000_000) / 1_000_000, -1, 2), 4) + 0.0).alias("clipped"))
