"""Queries: review pages, cases, search, validation, files in and out, enrichment, texts of briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import zero_filled
from ..operators import briefs, detectors, features, graph, models, review, scoring, serving, textmine, validation
from ..sources import readers, writers
from ..sources.staging import new_path
from ..streaming import feeds
from .registry import ALERTS, EDGES, FLAGS, LINES, PEOPLE, PROV, SCORED, fixtures, flags, query, scored, scored_by_provider

NPI = 11
CASES = f"""{PEOPLE}, cases AS (SELECT o_orderkey AS case_id, o_custkey AS npi, state, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'under_review' ELSE 'closed' END AS status, o_orderpriority AS outcome,
  o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS updated_at, o_orderkey % 5 AS assigned_to, o_orderkey % 3 AS created_by FROM orders JOIN people ON o_custkey = npi)"""


def _cases(spark, d):
    o = fixtures.table(spark, d, "orders").withColumnRenamed("o_custkey", "npi").join(fixtures.people(spark, d).select("npi", "state"), "npi")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "under_review").otherwise("closed")
    return o.select(
        F.col("o_orderkey").alias("case_id"), "npi", "state", status.alias("status"), F.col("o_orderpriority").alias("outcome"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))).alias("updated_at"), (F.col("o_orderkey") % 5).alias("assigned_to"), (F.col("o_orderkey") % 3).alias("created_by"))


def _users(spark, d):
    return fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))


@query(f"WITH {LINES} SELECT year, code, services, CAST(payment AS DOUBLE) AS payment FROM lines WHERE npi = {NPI} ORDER BY payment DESC NULLS LAST, year, code LIMIT 20")
def provider_lines_page(spark, d):
    return review.provider_lines(fixtures.lines(spark, d), NPI, limit=20).select("year", "code", "services", F.col("payment").cast("double").alias("payment"))


@query(f"WITH {ALERTS} SELECT flag_id, severity FROM alerts WHERE npi = 8 AND flag_id % 7 <> 0 ORDER BY severity, created_at DESC, flag_type LIMIT 25")
def provider_flags_page(spark, d):
    a = fixtures.alerts(fixtures.table(spark, d, "events")).withColumn("is_active", F.col("flag_id") % 7 != 0)
    return review.provider_flags(a, 8, limit=25).select("flag_id", "severity")


@query(f"WITH {ALERTS} SELECT flag_id, value FROM alerts WHERE npi = 8 AND flag_id % 7 <> 0 ORDER BY severity, value DESC NULLS LAST, flag_type LIMIT 10")
def provider_flags_by_cost(spark, d):
    a = fixtures.alerts(fixtures.table(spark, d, "events")).withColumns({"is_active": F.col("flag_id") % 7 != 0, "overpayment": F.col("value")})
    return review.flags_by_cost(a, 8, 10).select("flag_id", "value")


@query(f"WITH {SCORED} SELECT npi, name, state, risk_score, round(med_ppb * total_beneficiaries, 4) AS expected FROM scored WHERE npi = {NPI}")
def provider_detail(spark, d):
    p = scored(spark, d)
    impact = detectors.financial_impact(p.withColumns({"peer_median_ppb": F.col("med_ppb"), "peer_median_payment": F.col("med"), "peer_median_benes": F.lit(1)}))
    return review.provider_detail(p, impact, NPI).select("npi", "name", "state", "risk_score", F.round("expected", 4).alias("expected"))


@query(f"WITH {CASES} SELECT case_id, status, a.s_name AS assigned_to_name, b.s_name AS created_by_name FROM cases LEFT JOIN supplier a ON assigned_to = a.s_suppkey LEFT JOIN supplier b ON created_by = b.s_suppkey WHERE npi = {NPI} AND status IN ('open', 'under_review')")
def active_cases(spark, d):
    return review.active_cases(_cases(spark, d), _users(spark, d), NPI).select("case_id", "status", "assigned_to_name", "created_by_name")


@query(f"WITH {CASES} SELECT case_id, npi, outcome FROM cases WHERE state IN ('NATION_3', 'NATION_4') AND state = 'NATION_3' AND status = 'open' AND assigned_to = 2")
def case_filters(spark, d):
    return review.case_list(_cases(spark, d), ["NATION_3", "NATION_4"], status="open", state="nation_3", assigned_to=2).select("case_id", "npi", "outcome")


@query(f"""WITH {CASES}, n AS (SELECT l_orderkey AS case_id, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS notes FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
f AS (SELECT l_orderkey AS case_id, count(*) AS documents FROM lineitem WHERE l_linenumber > 5 GROUP BY 1)
SELECT case_id, name, notes, coalesce(documents, 0) AS documents FROM cases JOIN people USING (npi) LEFT JOIN n USING (case_id) LEFT JOIN f USING (case_id)""")
def case_parts(spark, d):
    items = fixtures.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "case_id")
    notes = items.where("l_linenumber <= 4").select("case_id", F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("text"))
    files = items.where("l_linenumber > 5").select("case_id", F.col("l_linestatus").alias("name"))
    out = review.with_parts(_cases(spark, d), fixtures.people(spark, d), notes, files)
    told = F.array_join(F.transform("notes", lambda x: F.concat(x["at"].cast("string"), x["text"])), ",")
    return out.select("case_id", "provider.name", told.alias("notes"), F.coalesce(F.size("documents"), F.lit(0)).cast("long").alias("documents"))


@query(f"WITH {CASES} SELECT case_id, npi FROM cases WHERE status IN ('open', 'under_review') ORDER BY updated_at, case_id LIMIT 30")
def sweep_order(spark, d):
    return review.sweep_order(_cases(spark, d), most=30).select("case_id", "npi")


@query(f"""WITH {EDGES}, k AS (SELECT DISTINCT source FROM edges WHERE source % 2 = 0)
SELECT s_suppkey AS npi, s_suppkey IN (SELECT source FROM k) AS has_edges FROM supplier WHERE contains(lower(s_name), '01') OR contains(CAST(s_suppkey AS VARCHAR), '01') ORDER BY has_edges DESC, s_acctbal DESC NULLS LAST, npi LIMIT 20""")
def node_search(spark, d):
    people = fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("npi"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("risk_score"))
    return graph.node_search(people, fixtures.edges(spark, d, by=("source",)).where("source % 2 = 0"), "01").select("npi", "has_edges")


@query(f"WITH {SCORED} SELECT address, count(*) AS provider_count, max(risk_score) AS max_risk FROM scored WHERE address = (SELECT address FROM scored WHERE npi = {NPI}) GROUP BY 1 HAVING count(*) >= 2")
def cluster_of_provider(spark, d):
    return graph.cluster_of(scored(spark, d), NPI).select("address", "provider_count", "max_risk")


@query(f"WITH {SCORED} SELECT count(*) AS clusters, CAST(coalesce(sum(n), 0) AS BIGINT) AS providers FROM (SELECT address, count(*) AS n FROM scored GROUP BY 1 HAVING count(*) >= 3)")
def cluster_count(spark, d):
    return graph.cluster_count(scored(spark, d))


@query(f"WITH {SCORED} SELECT count(*) AS providers, count(CASE WHEN npi % 3 > 0 THEN address END) AS with_address, count(CASE WHEN npi % 3 > 0 THEN address END) >= 100 AS is_ready FROM scored")
def address_coverage(spark, d):
    return graph.address_coverage(scored(spark, d).withColumn("address", F.when(F.col("npi") % 3 > 0, F.col("address"))), 100)


@query(f"WITH {FLAGS} SELECT severity, count(*) AS n FROM flags WHERE is_active GROUP BY 1")
def severity_breakdown(spark, d):
    return detectors.severity_breakdown(flags(scored(spark, d)))


@query(f"WITH {SCORED} SELECT count(*) AS providers, count(*) FILTER (risk_score >= 70) AS high_risk, count(*) FILTER (excluded) AS excluded FROM scored WHERE state = 'NATION_2'")
def jurisdiction_summary(spark, d):
    return graph.pack_summary(scored(spark, d), "NATION_2")


HELD = f"{SCORED}, held AS (SELECT *, CAST(npi % 9 = 0 AS INT) AS label FROM scored)"


def _held(spark, d):
    p = scored(spark, d)
    return validation.validation_labels(p, p.where("npi % 9 = 0"), p)


@query(f"""WITH {HELD} SELECT count(*) AS rows, count(*) FILTER (label = 1) AS holdout, {", ".join(f"count(*) FILTER (label = 1 AND risk_score >= {c}) AS caught_{c}, round(count(*) FILTER (label = 1 AND risk_score >= {c}) / greatest(count(*) FILTER (label = 1), 1), 4) AS recall_{c}" for c in (50, 70, 80))},
count(*) FILTER (NOT excluded AND risk_score >= 70) AS new_leads_70, count(*) FILTER (NOT excluded AND risk_score >= 80) AS new_leads_80, count(*) FILTER (NOT excluded AND risk_score >= 50 AND risk_score < 70) AS new_leads_50_69,
round(avg(risk_score) FILTER (label = 1), 2) AS holdout_mean, round(avg(risk_score) FILTER (label = 0), 2) AS other_mean FROM held""")
def recall_report(spark, d):
    return validation.recall_report(_held(spark, d))


@query(f"""WITH {HELD}, e AS (SELECT o_custkey AS npi, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN '1128A1' ELSE '1128b4' END, (o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN '1128A1' ELSE '1128b4' END)) AS r FROM orders GROUP BY 1)
SELECT count(*) FILTER (r = '1128A1') AS billing, count(*) FILTER (r IS NULL OR r <> '1128A1') AS other, count(*) FILTER (r = '1128A1' AND risk_score >= 45) AS caught,
round(count(*) FILTER (r = '1128A1' AND risk_score >= 45) / greatest(count(*) FILTER (r = '1128A1'), 1), 4) AS recall FROM held LEFT JOIN e USING (npi) WHERE label = 1""")
def billing_recall(spark, d):
    e = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("npi"), F.col("o_orderdate").alias("excldate"), F.when(F.col("o_orderkey") % 3 == 0, "1128A1").otherwise("1128b4").alias("excltype"))
    return validation.billing_recall(_held(spark, d), e, 45.0)


@query(f"""WITH {SCORED} SELECT count(*) AS rows, round(avg(risk_score), 4) AS mean, round(stddev_samp(risk_score), 4) AS deviation, count(*) FILTER (risk_score >= 70 AND NOT excluded) AS high_not_excluded, stddev_samp(risk_score) >= 5 AS spreads,
(SELECT count(*) FILTER (NOT excluded) FROM (SELECT * FROM scored ORDER BY risk_score DESC, npi LIMIT 100)) AS top_not_excluded FROM scored""")
def score_quality(spark, d):
    return validation.score_quality(scored(spark, d)).withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query(f"WITH {SCORED} SELECT round(quantile_cont(risk_score, 0.8), 6) AS quantile FROM scored")
def whole_quantile(spark, d):
    return validation.whole_quantile(scored(spark, d), "risk_score", 0.8).select(F.round("quantile", 6).alias("quantile"))


@query(f"WITH {SCORED} SELECT npi, CAST(excluded AS INT) AS label, 'all_exclusions_fallback' AS label_source FROM scored")
def fallback_labels(spark, d):
    p = scored(spark, d)
    return validation.validation_labels(p, None, p.where("excluded")).select("npi", "label", "label_source")


WEIGHTS = {"total_payment": 1e-6, "total_services": 1e-3}


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs((x - m) * {w})), 6) AS importance FROM (SELECT {c} AS x, (SELECT median({c}) FROM prov) AS m FROM prov)" for c, w in WEIGHTS.items()).join([f"WITH {PROV} ", ""]))
def global_importance(spark, d):
    out = validation.global_importance(models.top_drivers(fixtures.providers(spark, d), WEIGHTS, n=2))
    return out.select("feature", F.round("importance", 6).alias("importance"))


MAP = f"""{FLAGS}, m AS (SELECT state, count(*) AS providers, count(*) FILTER (risk_score >= 70) AS at_70 FROM scored GROUP BY 1)"""


@query(f"WITH {MAP} SELECT state, at_70 FROM m ORDER BY at_70 DESC, state LIMIT 7")
def map_order(spark, d):
    from ..operators.scoring import tier

    p = scored(spark, d)
    return review.map_order(serving.state_map(p.withColumn("risk_tier", tier(F.col("risk_score"))), flags(p))).select("state", "at_70").limit(7)


@query(f"WITH {FLAGS} SELECT CAST(count(*) AS BIGINT) AS providers, CAST(count(*) FILTER (risk_score >= 70) AS BIGINT) AS high_risk, round((SELECT sum(overpayment) FROM flags WHERE is_active), 0) AS overpayment FROM scored")
def map_totals(spark, d):
    from ..operators.scoring import tier

    p = scored_by_provider(spark, d)
    out = review.map_totals(serving.state_map(p.withColumn("risk_tier", tier(F.col("risk_score"))), flags(p)))
    return out.withColumn("overpayment", F.round("overpayment", 0))


@query(f"WITH {SCORED} SELECT npi, state FROM scored WHERE state IN ('NATION_5', 'NATION_6', 'NATION_7') AND lower(specialty) NOT IN ('building', 'machinery')")
def physicians_in_valid_states(spark, d):
    own = review.valid_states(scored(spark, d), states=["NATION_5", "NATION_6", "NATION_7"])
    return serving.search(own, facilities=["Building", "Machinery"]).select("npi", "state")


@query(f"WITH {PEOPLE} SELECT npi, npi % 4 IN (0, 1) AS may_export, npi % 4 = 0 AS may_ingest FROM people")
def role_permissions(spark, d):
    role = F.element_at(F.array(*(F.lit(x) for x in ("admin", "analyst", "viewer", "guest"))), (F.col("npi") % 4 + 1).cast("int"))
    return fixtures.people(spark, d).select("npi", review.permitted(role, "providers:export").alias("may_export"), review.permitted(role, "data:ingest").alias("may_ingest"))


@query(f"WITH {PEOPLE} SELECT npi, CASE WHEN npi % 5 = 0 THEN '2024-03-01 00:00' END AS scored_at FROM people")
def rescored(spark, d):
    p = fixtures.people(spark, d)
    out = review.rescored(p, p.where("npi % 5 = 0"), F.lit("2024-03-01").cast("timestamp"))
    return out.select("npi", F.date_format("scored_at", "yyyy-MM-dd HH:mm").alias("scored_at"))


@query(f"""WITH {FLAGS}, j AS (SELECT npi, count(*) FILTER (code = 'Brand#1') AS j FROM lines GROUP BY 1), t AS (SELECT npi, list(flag_type) AS t FROM flags GROUP BY 1)
SELECT npi, CASE WHEN excluded THEN 'excluded provider' WHEN j >= 3 AND total_payment > 900000 THEN CASE WHEN npi % 6 = 0 THEN 'drug billing and referral ring' ELSE 'drug inflation' END
WHEN list_contains(t, 'billing_volume') THEN 'excluded billing' WHEN npi % 6 = 0 THEN 'referral ring with volume' ELSE 'several signals' END AS scheme FROM scored LEFT JOIN j USING (npi) LEFT JOIN t USING (npi)""")
def scheme_rules(spark, d):
    p = scored_by_provider(spark, d)
    lines = fixtures.lines(spark, d).withColumn("code", F.when(F.col("code") == "Brand#1", "J1").otherwise(F.col("code")))
    types = flags(p).groupBy("npi").agg(F.collect_set("flag_type").alias("types"))
    p = p.join(types, "npi", "left").join(review.drug_codes(lines), "npi", "left")
    types = F.concat(F.coalesce("types", F.array().cast("array<string>")), F.when(F.col("npi") % 6 == 0, F.array(F.lit("hub_spoke"))).otherwise(F.array().cast("array<string>")))
    return p.select("npi", review.scheme_of(types, F.col("excluded"), F.coalesce("drug_codes", F.lit(0)), F.col("total_payment"), dear=900_000).alias("scheme"))


@query(f"""WITH {EDGES}, s AS (SELECT CASE WHEN source = 3 THEN target ELSE source END AS npi, shared FROM edges WHERE source = 3 OR target = 3), x AS (SELECT s.npi, shared, s_acctbal < 0 AS ex, s_acctbal / 100 AS r FROM s JOIN supplier ON s.npi = s_suppkey)
SELECT npi, CASE WHEN ex THEN 'subpoena referral and payment records' WHEN npi % 2 = 0 AND shared > 50 THEN 'compare both practices'' patient rosters' WHEN r >= 80 THEN 'review as a partner in a scheme' ELSE 'request referral documents' END AS action,
CASE WHEN shared > 150 THEN format('{{:,}}', shared) || ' shared patients, extremely many' ELSE format('{{:,}}', shared) || ' shared patients' END || CASE WHEN ex THEN '; excluded' ELSE '' END || CASE WHEN r >= 85 THEN '; risk score ' || CAST(CAST(round(r) AS INT) AS VARCHAR) || ' of 100' WHEN r >= 70 THEN '; risk score ' || CAST(CAST(round(r) AS INT) AS VARCHAR) ELSE '' END AS reason FROM x""")
def network_suspects(spark, d):
    s = fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("npi"), (F.col("s_acctbal") < 0).alias("ex"), (F.col("s_acctbal") / 100).alias("r"))
    out = serving.network_suspects(fixtures.edges(spark, d).withColumn("is_suspicious", F.lit(True)), 3, most=1_000_000).join(s, "npi")
    shared = F.col("shared")
    return out.select("npi", review.suspect_action(shared, F.col("ex"), F.col("r"), F.col("npi") % 2 == 0).alias("action"), review.suspect_reasons(shared, F.col("ex"), F.col("r")).alias("reason"))


@query(f"""WITH {LINES}, {PEOPLE}, s AS (SELECT npi, code, sum(services) AS s FROM lines GROUP BY 1, 2), t AS (SELECT *, s / sum(s) OVER (PARTITION BY npi) AS p FROM s), e AS (SELECT npi, round(sum(-p * log2(p + 1e-10)), 4) + 0.0 AS e FROM t GROUP BY 1),
l AS (SELECT npi, round(coalesce(sum(services) FILTER (code = 'Brand#5') / nullif(sum(services) FILTER (code IN ('Brand#4', 'Brand#5')), 0), 0), 3) AS l FROM lines GROUP BY 1)
SELECT npi, coalesce(e, 0) AS billing_entropy, coalesce(l, 0) AS level5_ratio FROM people LEFT JOIN e USING (npi) LEFT JOIN l USING (npi)""")
def code_features(spark, d):
    out = features.with_code_features(fixtures.people(spark, d), fixtures.lines(spark, d), ["Brand#4", "Brand#5"], ["Brand#5"])
    return out.select("npi", "billing_entropy", "level5_ratio")


def _csv(df, name: str, header: bool = True) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


@query(f"""WITH {PROV} SELECT lpad(CAST(npi AS VARCHAR), 10, '1') AS npi, name AS last_name, specialty, total_services, CAST(total_beneficiaries AS DOUBLE) AS total_beneficiaries, CAST(round(CAST(total_payment AS DECIMAL(18,4)), 2) AS DOUBLE) AS total_payment FROM prov WHERE npi % 10 <> 3 AND total_payment > 0""")
def provider_file_read(spark, d):
    p = fixtures.providers(spark, d)
    npi = F.when(F.col("npi") % 10 == 3, "bad").otherwise(F.lpad(F.col("npi").cast("string"), 10, "1"))
    cents = F.round(F.col("total_payment").cast("decimal(18,4)"), 2)  # exact, as half a cent of a double isn't
    path = _csv(p.select(F.concat(F.lit(" "), npi).alias("Rndrng_NPI"), F.col("name").alias("Rndrng_Prvdr_Last_Org_Name"), F.col("specialty").alias("Rndrng_Prvdr_Type"), F.col("total_services").alias("Tot_Srvcs"), F.col("total_beneficiaries").alias("TOT_BENES"), F.concat(F.lit("$"), F.format_number(cents, 2)).alias("Tot_Mdcr_Pymt_Amt")), "providers-csv")
    return readers.provider_file(spark, path).select("npi", "last_name", "specialty", "total_services", "total_beneficiaries", "total_payment")


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '1') AS npi, p_brand AS hcpcs_code, l_quantity AS services, round(l_quantity * l_extendedprice, 2) AS total_payment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 2 = 0 AND l_linenumber = 1")
def billing_file_read(spark, d):
    o, p = fixtures.table(spark, d, "orders"), fixtures.table(spark, d, "part")
    rows = fixtures.table(spark, d, "lineitem").where("l_linenumber = 1").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    npi = F.lpad(F.col("o_custkey").cast("string"), 10, "1")
    path = _csv(rows.select(npi.alias("Rndrng_NPI"), F.lower("p_brand").alias("HCPCS_Cd"), F.col("l_quantity").alias("Tot_Srvcs"), F.col("l_extendedprice").alias("Avg_Mdcr_Pymt_Amt")), "lines-csv")
    keys = o.where("o_custkey % 2 = 0").select(npi.alias("npi"))
    out = readers.billing_file(spark, path, 2022, keys)
    return out.select("npi", F.regexp_replace("hcpcs_code", "BRAND", "Brand").alias("hcpcs_code"), "services", F.round("total_payment", 2).alias("total_payment"))


@query("SELECT '1' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS npi, c_name AS lastname FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def exclusion_file_read(spark, d):
    c = fixtures.table(spark, d, "customer")
    npi = F.when(F.col("c_custkey") % 5 == 0, "0000000000").otherwise(F.concat(F.lit("1"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    path = _csv(c.select(F.col("c_name").alias("LASTNAME"), npi.alias("NPI"), F.lit("1128a1").alias("EXCLTYPE"), F.when(F.col("c_custkey") % 7 == 0, "20200101").when(F.col("c_custkey") % 3 == 0, "00000000").otherwise("").alias("REINDATE")), "exclusions-csv")
    return readers.exclusion_file(spark, path, strict=True).select("npi", "lastname")


@query("SELECT CAST(c_custkey AS VARCHAR) AS npi, substr(c_name, 1, 20) AS credential, substr(c_name || 'xyz', 1, 10) AS taxonomy_code, CASE WHEN c_custkey % 3 > 0 THEN '2020-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS enrollment_date FROM customer WHERE c_custkey % 2 = 0")
def registry_updates_read(spark, d):
    c = fixtures.table(spark, d, "customer")
    day = F.when(F.col("c_custkey") % 3 == 0, "31.12.20").otherwise(F.concat(F.lit("01/"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"), F.lit("/2020")))
    path = _csv(c.select(F.col("c_custkey").alias("NPI"), F.lit("1").alias("Entity Type Code"), F.concat(F.lit(" "), "c_name", F.lit(" and more than twenty letters")).alias("Provider Credential Text"), F.concat("c_name", F.lit("xyz")).alias("Healthcare Provider Taxonomy Code_1"), day.alias("Provider Enumeration Date")), "registry-csv")
    out = readers.registry_updates(spark, path, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("npi")))
    return out.select("npi", F.substring("credential", 1, 18).alias("credential"), "taxonomy_code", F.date_format("enrollment_date", "yyyy-MM-dd").alias("enrollment_date")).withColumn("credential", F.substring("credential", 1, 20))


@query(f"WITH {EDGES} SELECT lpad(CAST(source AS VARCHAR), 10, '0') AS source, lpad(CAST(target AS VARCHAR), 10, '0') AS target, shared FROM edges WHERE shared >= 2")
def pair_file_read(spark, d):
    e = fixtures.edges(spark, d)
    path = _csv(e.select("source", "target", F.lit(1).alias("pairs"), "shared", F.lit(0).alias("same_day")), "pairs-csv")
    return readers.pair_file(spark, path, least=2).select("source", "target", "shared")


@query(f"WITH {LINES} SELECT year, count(*) AS n, round(CAST(sum(CASE WHEN year = 1997 THEN 2 * charge ELSE charge END) AS DOUBLE), 2) AS charge FROM lines GROUP BY 1")
def partition_overwrite(spark, d):
    path, rows = new_path(spark, "by-year"), fixtures.lines(spark, d).select("npi", "charge", "year")
    writers.replace_partitions(rows, path)
    writers.replace_partitions(rows.where("year = 1997").withColumn("charge", (F.col("charge") * 2).cast("decimal(18,2)")), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("charge").cast("double"), 2).alias("charge"))


@query(f"WITH {PEOPLE} SELECT npi, name, 2 AS times FROM people")
def snapshots_appended(spark, d):
    path, p = new_path(spark, "snapshots"), fixtures.people(spark, d).select("npi", "name")
    writers.append_snapshot(p, path)
    writers.append_snapshot(p, path)
    return spark.read.parquet(path).where("taken_at IS NOT NULL").groupBy("npi", "name").agg(F.count("*").cast("int").alias("times"))


@query(f"WITH {PEOPLE} SELECT npi, specialty FROM people")
def csv_round_trip(spark, d):
    path = new_path(spark, "export")
    writers.export_csv(fixtures.people(spark, d).select("npi", "specialty"), path)
    return readers.read_csv(spark, path).select(F.col("npi").cast("long").alias("npi"), "specialty")


@query("SELECT n_nationkey AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS report FROM nation")
def json_reports(spark, d):
    n = fixtures.table(spark, d, "nation").select("n_nationkey", "n_name")
    return writers.json_report(n).select(F.get_json_object("report", "$.n_nationkey").cast("int").alias("k"), "report")


@query("""WITH r AS (SELECT c_custkey AS npi, CASE WHEN c_custkey % 4 > 0 THEN greatest(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2002-12-31') / 30.4375, 0) END AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
f AS (SELECT npi, coalesce(m, 0) AS m FROM r WHERE npi % 5 > 0), g AS (SELECT median(m) AS med FROM f)
SELECT c_custkey AS npi, round(coalesce(m, med), 4) AS months_since_enumeration, CASE WHEN m IS NOT NULL AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS is_sole_proprietor, CAST(n_name IN ('NATION_1', 'NATION_2') AS DOUBLE) AS hotspot_state,
CAST(coalesce(m, med) <= 24 AND c_custkey % 3 = 0 AS DOUBLE) AS new_provider_high_volume FROM customer LEFT JOIN f ON c_custkey = npi LEFT JOIN nation ON c_nationkey = n_nationkey, g""")
def enrichment(spark, d):
    p = fixtures.people(spark, d).withColumn("payment_vs_peer", F.when(F.col("npi") % 3 == 0, 5.0).otherwise(1.0))
    first = fixtures.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("npi")).agg(F.min("o_orderdate").alias("day"))
    r = first.where("npi % 5 > 0").select("npi", F.when(F.col("npi") % 4 > 0, F.date_format("day", "MM/dd/yyyy")).alias("enumeration_date"), F.when(F.col("npi") % 2 == 0, " y ").otherwise("N").alias("is_sole_proprietor"))
    out = features.enrich(p, r, "2002-12-31", ["NATION_1", "NATION_2"])
    return out.select("npi", F.round("months_since_enumeration", 4).alias("months_since_enumeration"), "is_sole_proprietor", "hotspot_state", "new_provider_high_volume")


@query("SELECT event_id AS id, s_name AS name FROM events LEFT JOIN supplier ON user_id = s_suppkey WHERE event_type = 'error' AND user_id % 10 = 3")
def audit_timeline(spark, d):
    e = fixtures.table(spark, d, "events").where("user_id % 10 = 3").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.lit("p").alias("target"), F.col("ts").alias("created_at"))
    return serving.audit_timeline(e, _users(spark, d), action="error").select("id", "name")


@query(f"WITH {HELD} SELECT round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 6) AS scale FROM held")
def class_balance(spark, d):
    return scoring.class_balance(_held(spark, d)).select(F.round("scale", 6).alias("scale"))


@query("""WITH o AS (SELECT o_custkey AS npi, CASE o_orderstatus WHEN 'O' THEN 'confirmed' WHEN 'P' THEN 'cleared' ELSE 'pending' END AS outcome FROM orders WHERE o_orderkey % 8 = 0 AND o_custkey % 7 > 0), c AS (SELECT DISTINCT npi FROM o WHERE outcome = 'cleared')
SELECT npi, 'cleared' AS kind FROM c UNION ALL SELECT DISTINCT npi, 'positive' FROM o WHERE outcome = 'confirmed' AND npi NOT IN (SELECT npi FROM c)""")
def outcome_labels(spark, d):
    o = fixtures.table(spark, d, "orders").where("o_orderkey % 8 = 0")
    outcomes = o.select(F.col("o_custkey").alias("npi"), F.when(F.col("o_orderstatus") == "O", " Confirmed").when(F.col("o_orderstatus") == "P", "cleared").otherwise("pending").alias("outcome"))
    positive, cleared = scoring.label_sets(outcomes, outcomes.where("npi % 7 = 0").select("npi").distinct(), ("confirmed",), ("cleared",))
    return positive.withColumn("kind", F.lit("positive")).unionByName(cleared.withColumn("kind", F.lit("cleared")))


OUTCOMES = """outcomes AS (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'R' THEN 'substantiated' WHEN 'A' THEN 'referred_to_doj' ELSE 'unsubstantiated' END AS outcome, l_shipdate AS told_at FROM lineitem WHERE l_orderkey % 3 = 0)"""


def _outcomes(spark, d):
    told = F.when(F.col("l_returnflag") == "R", "substantiated").when(F.col("l_returnflag") == "A", "referred_to_doj").otherwise("unsubstantiated")
    return fixtures.table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("case_id"), told.alias("outcome"), F.col("l_shipdate").alias("at"))


@query(f"""WITH {CASES}, {OUTCOMES}, o AS (SELECT case_id, max({{'told_at': told_at, 'outcome': outcome}}) AS last FROM outcomes GROUP BY 1)
SELECT case_id, CASE WHEN last IS NULL THEN CASE WHEN case_id % 5 = 0 THEN 'referred' ELSE status END WHEN case_id % 5 = 0 THEN 'referred' ELSE 'closed' END AS status, last.outcome AS outcome FROM cases LEFT JOIN o USING (case_id)""")
def recorded_outcomes(spark, d):
    c = _cases(spark, d).withColumn("status", F.when(F.col("case_id") % 5 == 0, "referred").otherwise(F.col("status")))
    return review.record_outcomes(c, _outcomes(spark, d)).select("case_id", "status", "outcome")


@query(f"""WITH {ALERTS}, {OUTCOMES}, sure AS (SELECT DISTINCT o_custkey AS npi FROM outcomes JOIN orders ON case_id = o_orderkey WHERE outcome <> 'unsubstantiated' AND o_orderkey % 9 = 0)
SELECT flag_id, CASE WHEN flag_id % 7 <> 0 AND npi IN (SELECT npi FROM sure) THEN 1.0 ELSE 0.5 END AS confidence, flag_id % 7 <> 0 AND npi IN (SELECT npi FROM sure) AS reviewed FROM alerts""")
def outcome_feedback(spark, d):
    told = _outcomes(spark, d).where("case_id % 9 = 0").join(_cases(spark, d).select("case_id", "npi"), "case_id")
    a = fixtures.alerts(fixtures.table(spark, d, "events")).withColumns({"is_active": F.col("flag_id") % 7 != 0, "confidence": F.lit(0.5)})
    return serving.outcome_feedback(a, told, ["substantiated", "referred_to_doj", "referred_to_state_ag"]).select("flag_id", "confidence", "reviewed")


@query(f"WITH {SCORED} SELECT npi, round(CASE WHEN excluded THEN greatest(b, 0.97) WHEN b > 0 THEN b ELSE least(risk_score / 100, 0.99) END, 6) AS confidence FROM (SELECT *, CASE WHEN npi % 3 = 0 THEN 0 ELSE least(pv / 4, 1) END AS b FROM scored)")
def model_confidence(spark, d):
    b = F.when(F.col("npi") % 3 == 0, 0.0).otherwise(F.least(F.col("pv") / 4, F.lit(1.0)))
    return scored(spark, d).select("npi", F.round(serving.model_confidence(F.col("excluded"), b, F.col("risk_score")), 6).alias("confidence"))


@query(f"WITH {SCORED} SELECT npi, CASE specialty WHEN 'BUILDING' THEN 'lab' WHEN 'MACHINERY' THEN 'imaging' END AS kind, 'claims, 2022, provider ' || npi AS citation FROM scored")
def facility_and_citation(spark, d):
    p = scored_by_provider(spark, d)
    kind = briefs.facility_kind(F.col("specialty"), {"lab": ["building"], "imaging": ["Machinery"]})
    return p.select("npi", kind.alias("kind")).join(briefs.citations(p, "claims", 2022), "npi")


@query(f"""WITH {SCORED} SELECT npi, name || ' (' || specialty || ', ' || state || ') was paid $' || CASE WHEN total_payment >= 1e6 THEN format('{{:,.2f}}', round(total_payment / 1e6, 2)) || 'M' ELSE format('{{:,.1f}}', round(total_payment / 1e3, 1)) || 'K' END || '.'
|| CASE WHEN excluded THEN ' The provider is on the exclusion list.' ELSE '' END AS narrative FROM scored WHERE total_payment >= 1000""")
def narratives(spark, d):
    return briefs.narrative(scored(spark, d).where("total_payment >= 1000").withColumn("excess", F.lit(0.0)))


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS t FROM documents) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1""")
def search_terms(spark, d):
    t = textmine.matching(textmine.search_terms(fixtures.table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"]), ["EN"])
    return t.select("doc_id", F.size("terms").cast("long").alias("n"))


@query("""SELECT page_id, i AS n, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS url FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS l FROM pages))""")
def page_link_urls(spark, d):
    return textmine.links(fixtures.table(spark, d, "pages")).select("page_id", "n", "url")


@query(f"WITH {ALERTS} SELECT flag_id FROM alerts WHERE created_at > TIMESTAMP '2024-01-19 23:55:00'")
def alerts_since(spark, d):
    return feeds.since(fixtures.alerts(fixtures.table(spark, d, "events")), "2024-01-20").select("flag_id")


@query("""WITH r AS (SELECT c_custkey AS npi, c_custkey % 3 AS k FROM customer) SELECT npi, CASE k WHEN 0 THEN 'deactivated' WHEN 1 THEN 'new within 24 months' ELSE 'in order' END AS finding FROM r""")
def registry_findings(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("npi"), F.lit("Roe").alias("expected_name"))
    k = F.col("npi") % 3
    record = F.to_json(F.struct(F.when(k == 0, "D").otherwise("A").alias("status"), F.when(k == 1, "2023-06-01").otherwise("2001-01-01").alias("enumeration_date"), F.lit("ROE").alias("last_name")))
    return textmine.registry_findings(c.withColumn("record", record), "2024-06-01").select("npi", "finding")


@query("""SELECT c_custkey AS npi, CASE WHEN c_custkey % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM customer WHERE c_custkey % 3 > 0""")
def debarments(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("npi"))
    n = F.col("npi").cast("long")
    e = F.struct(F.lit("x").alias("name"), F.when(n % 3 == 0, "TX").otherwise("CA").alias("state"), F.when(n % 2 == 0, "2030-01-01").otherwise("2001-01-01").alias("until"))
    out = textmine.debarments(c.withColumn("record", F.to_json(F.struct(F.array(e).alias("exclusions")))), "2024-01-01", "CA")
    return out.select(F.col("npi").cast("long").alias("npi"), "severity")


@query("SELECT s_suppkey AS npi, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS padded, 'Acme ' || s_suppkey AS stem FROM supplier")
def names_and_zeros(spark, d):
    s = fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("npi"))
    return s.select("npi", zero_filled("npi").alias("padded"), textmine.strip_forms(F.concat(F.lit("Acme "), F.col("npi").cast("string"), F.lit(", L"), F.lit("LC."))).alias("stem"))


@query(f"WITH {SCORED} SELECT npi, round(CASE WHEN npi % 13 BETWEEN 1 AND 11 THEN total_payment * 12 / (npi % 13) ELSE total_payment END, 2) AS annual FROM scored")
def annualised_payment(spark, d):
    return scored(spark, d).select("npi", F.round(detectors.annualised(F.col("total_payment"), F.col("npi") % 13), 2).alias("annual"))


@query(None)
def drivers(spark, d):
    """Attributions of boosted trees fitted on the proxy labels."""
    p = scored(spark, d).select("npi", *(F.col(c).cast("double").alias(c) for c in INPUTS), F.col("excluded").cast("int").alias("label"), F.lit(1.0).alias("weight"))
    rows, model = models.boosted_model(p, INPUTS, rounds=5)
    return models.attributions(rows, model, INPUTS)


INPUTS = ["total_payment", "total_services", "total_beneficiaries", "procedure_types"]


@query(f"""WITH {SCORED} SELECT npi, concat_ws('; ', CASE WHEN risk_score > 0 THEN 'risk score: ' || CASE WHEN risk_score >= 95 THEN 'top <1%' WHEN risk_score >= 90 THEN 'top 1%' ELSE 'top 5%' END END, CASE WHEN npi % 7 > 3 THEN 'payment z-score' END,
CASE WHEN pv > 1.5 THEN 'payment against peers' END, CASE WHEN total_payment > 0 THEN 'total paid' END, CASE npi % 5 WHEN 1 THEN 'billing entropy: few codes' WHEN 4 THEN 'billing entropy: very many codes' END, CASE WHEN npi % 10 > 4 THEN 'highest-level visits' END, CASE WHEN excluded THEN 'exclusion' END,
CASE WHEN total_services / total_beneficiaries > 110 THEN 'services per beneficiary: ' || CASE WHEN npi % 4 = 0 THEN 'usual for a facility' ELSE 'unusual for an office' END END) AS measures FROM scored""")
def brief_measures(spark, d):
    npi = F.col("npi")
    p = scored(spark, d).withColumns({
        "payment_zscore": (npi % 7).cast("double"), "payment_vs_peer": F.col("pv"), "entropy": (npi % 5).cast("double"), "level5_ratio": npi % 10 / 10.0,
        "services_per_bene": F.col("total_services") / F.col("total_beneficiaries"), "is_facility": npi % 4 == 0})
    told = F.transform("measures", lambda m: F.when(m["label"].isin("risk score", "billing entropy", "services per beneficiary"), F.concat_ws(": ", m["label"], m["reading"])).otherwise(m["label"]))
    return briefs.measures(p, z=3, intensity=110).select("npi", F.array_join(told, "; ").alias("measures"))
