"""Queries: dashboards, search, graph, clusters, leads, deltas, sinks, texts, feeds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import address_key, keyword_severity
from ..operators import briefs, graph, models, serving, textmine
from ..sources import writers
from ..streaming import feeds
from .registry import ALERTS, EDGES, FLAGS, PEOPLE, SCORED, TIER, fixtures, flags, query, scored, scored_by_provider


@query(f"""WITH {SCORED} SELECT count(*) AS providers, count(*) FILTER (risk_score >= 90) AS critical, count(*) FILTER (risk_score >= 70 AND risk_score < 90) AS high, count(*) FILTER (risk_score >= 50 AND risk_score < 70) AS medium,
count(*) FILTER (excluded) AS excluded, count(DISTINCT state) AS states, round(sum(total_payment), 0) AS total_payment, round(avg(risk_score), 4) AS avg_risk FROM scored""")
def dashboard_stats(spark, d):
    out = serving.dashboard(scored(spark, d)).withColumns({"total_payment": F.round("total_payment", 0), "avg_risk": F.round("avg_risk", 4)})
    return out.select("providers", "critical", "high", "medium", "excluded", "states", "total_payment", "avg_risk")


@query(f"""WITH {FLAGS}, o AS (SELECT state, sum(overpayment) AS o FROM flags JOIN scored USING (npi) WHERE is_active GROUP BY 1)
SELECT state, count(*) AS providers, count(*) FILTER ({TIER} <= 2) AS high_risk, count(*) FILTER (risk_score >= 70) AS at_70, round(avg(risk_score), 4) AS avg_risk, round(coalesce(max(o), 0), 2) AS overpayment FROM scored LEFT JOIN o USING (state) GROUP BY state""")
def state_map(spark, d):
    from ..operators.scoring import tier

    p = scored_by_provider(spark, d)
    out = serving.state_map(p.withColumn("risk_tier", tier(F.col("risk_score"))), flags(p))
    return out.withColumns({"avg_risk": F.round("avg_risk", 4), "overpayment": F.round("overpayment", 2)})


@query(f"""WITH {FLAGS} SELECT npi, flag_type, severity, round(overpayment, 2) AS overpayment, name, state, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY severity, overpayment DESC NULLS LAST, flag_type) AS n FROM flags WHERE is_active)
JOIN scored USING (npi) WHERE n = 1 AND NOT excluded ORDER BY severity, overpayment DESC NULLS LAST, npi LIMIT 15""")
def top_leads(spark, d):
    p = scored_by_provider(spark, d)
    return serving.top_leads(p, flags(p)).select("npi", "flag_type", "severity", F.round("overpayment", 2).alias("overpayment"), "name", "state", "risk_score")


@query(f"""WITH {SCORED} SELECT npi, name, specialty, state, risk_score FROM scored WHERE (contains(lower(name), '1') OR contains(lower(specialty), '1')) AND contains(lower(specialty), 'build') AND risk_score >= 20 ORDER BY risk_score DESC, npi LIMIT 20 OFFSET 5""")
def provider_search_page(spark, d):
    found = serving.search(scored(spark, d), text="1", specialty="Build", least=20, columns=("name", "specialty"))
    return serving.page(found.select("npi", "name", "specialty", "state", "risk_score"), offset=5, limit=20)


@query(f"""WITH {SCORED} SELECT npi, name, state, risk_score, npi % 3 AS flag_count FROM scored ORDER BY risk_score DESC, npi LIMIT 100""")
def csv_export(spark, d):
    p = scored(spark, d).select("npi", "name", "state", "risk_score", F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("npi") % 3).cast("int")).alias("flags"))
    return serving.export(p, 100)


@query(f"WITH {SCORED} SELECT npi, state FROM scored WHERE state IN ('NATION_1', 'NATION_2')")
def jurisdiction(spark, d):
    return serving.allowed(scored(spark, d), ["NATION_1", "NATION_2"]).select("npi", "state")


@query(f"WITH {EDGES} SELECT source, target, shared, round(100.0 * shared / sum(shared) OVER (PARTITION BY source), 4) AS referral_percent FROM edges")
def edges_percent(spark, d):
    return graph.edge_percent(fixtures.edges(spark, d, by=("source",))).withColumn("referral_percent", F.round("referral_percent", 4))


SUPPLIERS = "sup AS (SELECT s_suppkey AS npi, 'S' || CAST(s_suppkey % 3 AS VARCHAR) AS specialty, s_acctbal < 0 AS excluded, round(s_acctbal / 100, 2) AS risk_score FROM supplier)"


def _suppliers(spark, d):
    s = fixtures.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("npi"), F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")).alias("specialty"), (F.col("s_acctbal") < 0).alias("excluded"), F.round(F.col("s_acctbal") / 100, 2).alias("risk_score"))


@query(f"""WITH {EDGES}, {SUPPLIERS} SELECT source, target, shared FROM (SELECT e.*, percent_rank() OVER (PARTITION BY a.specialty, b.specialty ORDER BY shared) AS r FROM edges e JOIN sup a ON source = a.npi JOIN sup b ON target = b.npi) WHERE r >= 0.99""")
def edge_outliers(spark, d):
    return graph.edge_outliers(fixtures.edges(spark, d), _suppliers(spark, d)).select("source", "target", "shared")


@query(f"""WITH {EDGES}, {SUPPLIERS} SELECT source, target, shared, (a.npi % 4 = 0 AND b.npi % 4 = 0) OR a.excluded OR b.excluded AS is_suspicious FROM edges JOIN sup a ON source = a.npi JOIN sup b ON target = b.npi""")
def edges_suspicious(spark, d):
    s = _suppliers(spark, d)
    return graph.suspicious_edges(fixtures.edges(spark, d), s.where("npi % 4 = 0"), s.where("excluded"))


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, max(shared) AS max_shared, CAST(sum(shared) AS BIGINT) AS sum_shared FROM edges")
def edge_summary(spark, d):
    return graph.edge_summary(fixtures.edges(spark, d))


EGO1 = f"""{EDGES}, f AS (SELECT * FROM edges WHERE source = 3 OR target = 3 ORDER BY shared DESC, source, target LIMIT 40), n AS (SELECT DISTINCT CASE WHEN source = 3 THEN target ELSE source END AS npi FROM f)"""


@query(f"""WITH {EGO1} SELECT *, 1 AS hop FROM f UNION ALL SELECT *, 0 FROM (SELECT * FROM edges WHERE source IN (SELECT npi FROM n) AND target IN (SELECT npi FROM n) ORDER BY shared DESC, source, target LIMIT 150)""")
def ego_1hop(spark, d):
    return graph.ego_network(fixtures.edges(spark, d), 3, 1, most_edges=40)


@query(f"""WITH {EGO1}, {SUPPLIERS}, s AS (SELECT * FROM edges WHERE source <> 3 AND target <> 3 AND (source IN (SELECT npi FROM n) OR target IN (SELECT npi FROM n)) ORDER BY shared DESC, source, target LIMIT 300),
b AS (SELECT *, 1 AS hop FROM f UNION ALL SELECT *, 2 FROM s), t AS (SELECT npi FROM sup WHERE npi IN (SELECT source FROM b UNION SELECT target FROM b) ORDER BY npi <> 3, risk_score DESC NULLS LAST, npi LIMIT 30)
SELECT * FROM b WHERE source IN (SELECT npi FROM t) AND target IN (SELECT npi FROM t)""")
def ego_2hop(spark, d):
    return graph.ego_network(fixtures.edges(spark, d), 3, 2, most_edges=40, people=_suppliers(spark, d), most_nodes=30, second_edges=300)


@query(f"""WITH {EDGES}, w AS (SELECT source, target, shared FROM edges UNION ALL SELECT target, source, shared + 1 FROM edges WHERE (source + target) % 2 = 0) SELECT a.source, a.target, a.shared, b.shared AS shared_back FROM w a JOIN w b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target""")
def mutual_edges(spark, d):
    e = fixtures.edges(spark, d)
    back = e.where("(source + target) % 2 = 0").select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("shared") + 1).alias("shared"))
    return graph.mutual_edges(e.unionByName(back))


CLUSTERS = f"""{SCORED}, h AS (SELECT address, specialty, count(*) AS n, row_number() OVER (PARTITION BY address ORDER BY count(*) DESC, specialty) AS r FROM scored GROUP BY 1, 2),
w AS (SELECT address, count(*) AS provider_count, max(risk_score) AS max_risk, avg(risk_score) AS avg_risk, count(*) FILTER (excluded) AS excluded_count FROM scored GROUP BY 1 HAVING count(*) >= 3),
clusters AS (SELECT address, provider_count, max_risk, avg_risk, excluded_count, specialty AS dominant, n / provider_count AS same FROM w JOIN h USING (address) WHERE r = 1)"""


@query(f"WITH {CLUSTERS} SELECT address, provider_count, max_risk, excluded_count, dominant, round(same, 4) AS same_fraction FROM clusters")
def address_clusters(spark, d):
    return graph.address_clusters(scored(spark, d)).select("address", "provider_count", "max_risk", "excluded_count", "dominant", F.round("same_fraction", 4).alias("same_fraction"))


@query(f"""WITH {CLUSTERS} SELECT address, floor(greatest(0, least(100, 35 * same + 0.25 * max_risk + 0.15 * avg_risk + 10 * least(provider_count, 10) / 10 + 15 * least(excluded_count, 2) / 2))) AS score FROM clusters""")
def cluster_score(spark, d):
    c = graph.address_clusters(scored(spark, d))
    score = 0.35 * F.col("same_fraction") * 100 + 0.25 * F.col("max_risk") + 0.15 * F.col("avg_risk") + 10 * F.least("provider_count", F.lit(10)) / 10 + 15 * F.least("excluded_count", F.lit(2)) / 2
    near = F.abs(F.col("cluster_score") - score) <= 0.051  # the operator rounds to one digit; compare whole points
    return c.select("address", F.when(near, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("double")).alias("score"))


@query(f"""WITH {CLUSTERS} SELECT npi, address FROM (SELECT npi, address, row_number() OVER (PARTITION BY address ORDER BY risk_score DESC NULLS LAST, npi) AS r FROM scored WHERE address IN (SELECT address FROM clusters)) WHERE r <= 2""")
def cluster_members(spark, d):
    p = scored(spark, d)
    return graph.cluster_members(p, graph.address_clusters(p), 2).select("npi", "address")


LEADS = f"""{FLAGS}, i AS (SELECT npi, greatest(0, total_payment - med_ppb * total_beneficiaries) AS excess FROM scored), z AS (SELECT address, count(*) AS cluster_size FROM scored GROUP BY 1), k AS (SELECT npi, count(DISTINCT flag_type) AS flag_types FROM flags WHERE is_active GROUP BY 1),
c AS (SELECT s.npi, s.state, risk_score, coalesce(flag_types, 0) AS flag_types, coalesce(excess, 0) AS excess, coalesce(cluster_size, 0) AS cluster_size FROM (SELECT * FROM scored ORDER BY risk_score DESC NULLS LAST, npi LIMIT 60) s LEFT JOIN i USING (npi) LEFT JOIN z USING (address) LEFT JOIN k ON k.npi = s.npi),
leads AS (SELECT npi, state, flag_types, cluster_size, excess, round(0.5 * risk_score + 25 * coalesce(excess / nullif(max(excess) OVER (), 0), 0) + 15 * least(flag_types, 5) / 5 + 10 * CAST(cluster_size >= 3 AS INT), 1) AS lead_rank FROM c ORDER BY lead_rank DESC, npi LIMIT 20)"""


def _leads(spark, d):
    p = scored(spark, d)
    impact = p.select("npi", F.greatest(F.lit(0.0), F.col("total_payment") - F.col("med_ppb") * F.col("total_beneficiaries")).alias("excess"))
    return graph.lead_pack(p, flags(p), impact, 20)


@query(f"WITH {LEADS} SELECT npi, flag_types, cluster_size, round(excess, 2) AS excess, lead_rank FROM leads")
def lead_pack(spark, d):
    return _leads(spark, d).select("npi", "flag_types", "cluster_size", F.round("excess", 2).alias("excess"), "lead_rank")


@query(f"WITH {LEADS} SELECT count(*) AS leads, count(*) FILTER (cluster_size >= 3) AS clustered, round(sum(excess), 0) AS excess FROM leads")
def lead_summary(spark, d):
    return _leads(spark, d).agg(F.count("*").alias("leads"), F.count_if(F.col("cluster_size") >= 3).alias("clustered"), F.round(F.sum("excess"), 0).alias("excess"))


@query(f"WITH {PEOPLE}, a AS (SELECT npi FROM people WHERE npi % 3 = 0), b AS (SELECT npi FROM people WHERE npi % 4 = 0) SELECT coalesce(a.npi, b.npi) AS npi, CASE WHEN a.npi IS NULL THEN 'newly_excluded' WHEN b.npi IS NULL THEN 'reinstated' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.npi = b.npi")
def exclusion_delta(spark, d):
    p = fixtures.people(spark, d).select("npi")
    return serving.exclusion_delta(p.where("npi % 3 = 0"), p.where("npi % 4 = 0"))


@query(f"""WITH {SCORED} SELECT npi, CASE WHEN npi % 4 = 0 THEN TRUE WHEN npi % 3 = 0 THEN FALSE ELSE excluded END AS excluded, CASE WHEN npi % 4 = 0 THEN greatest(risk_score, 85.0) ELSE risk_score END AS risk_score, CASE WHEN npi % 4 = 0 THEN least({TIER}, 2) ELSE {TIER} END AS risk_tier FROM scored""")
def exclusion_refresh(spark, d):
    from ..operators.scoring import tier

    p = scored(spark, d).withColumn("risk_tier", tier(F.col("risk_score")))
    return serving.apply_exclusions(p, exclusion_delta(spark, d)).select("npi", "excluded", "risk_score", "risk_tier")


FIND = "c AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS title, props AS url, strftime(ts, '%Y-%m-%d') AS date, ts >= TIMESTAMP '2024-01-15' AS is_new FROM events)"


@query(f"WITH {FIND} SELECT DISTINCT source, title, url FROM c WHERE is_new AND (source, title, url) NOT IN (SELECT (source, title, url) FROM c WHERE NOT is_new)")
def finding_delta(spark, d):
    e = fixtures.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("title"), F.col("props").alias("url"), F.lit(None).cast("string").alias("date"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("is_new"))
    return serving.new_findings(e.where("is_new"), e.where("NOT is_new")).select("source", "title", "url").distinct()


@query("SELECT user_id AS npi, event_id AS flag_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_run(spark, d):
    return serving.latest(fixtures.alerts(fixtures.table(spark, d, "events")), ["npi"], [F.desc("created_at"), "flag_id"]).select("npi", "flag_id")


@query("SELECT user_id AS npi, event_id AS flag_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_keep_first(spark, d):
    return writers.keep_first(fixtures.alerts(fixtures.table(spark, d, "events")), ["npi", "flag_type"], ["created_at", "flag_id"]).select("npi", "flag_id")


def _versions(spark, d):
    c = fixtures.people(spark, d).select("npi", "balance")
    return c.where("npi % 2 = 0"), c.where("npi % 3 = 0").withColumn("balance", F.round(F.col("balance") + 1, 2))


OLDNEW = f"{PEOPLE}, o AS (SELECT npi, balance FROM people WHERE npi % 2 = 0), n AS (SELECT npi, round(balance + 1, 2) AS balance FROM people WHERE npi % 3 = 0)"


@query(f"WITH {OLDNEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE npi NOT IN (SELECT npi FROM n)")
def upsert_merge(spark, d):
    return writers.upsert(*_versions(spark, d), ["npi"])


@query(f"WITH {OLDNEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE npi NOT IN (SELECT npi FROM o)")
def insert_ignore(spark, d):
    return writers.insert_ignore(*_versions(spark, d), ["npi"], ["balance"])


@query(f"WITH {OLDNEW} SELECT o.npi, coalesce(n.balance, o.balance) AS balance FROM o LEFT JOIN n ON o.npi = n.npi")
def update_from_join(spark, d):
    return writers.update_from(*_versions(spark, d), ["npi"], ["balance"])


@query(f"""WITH {FLAGS} SELECT npi, flag_type, is_active AND flag_type <> 'cost_per_patient' AS is_active FROM flags UNION ALL SELECT npi, 'cost_per_patient', TRUE FROM scored WHERE ppb_vs_peer >= 1.25""")
def deactivate_insert(spark, d):
    p = scored_by_provider(spark, d)
    new = p.where("ppb_vs_peer >= 1.25").select("npi", F.lit("cost_per_patient").alias("flag_type"))
    return writers.deactivate_then_insert(flags(p).select("npi", "flag_type", "is_active"), new, F.col("flag_type") == "cost_per_patient")


BUCKETS, NEGATIONS = [("adverse", ["worthless", "pathetic"]), ("warning", ["license", "token"])], ["under the", "gnu general public", "released"]


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT doc_id, regexp_replace(t, '(under the|gnu general public|released)(\\s*)(worthless|pathetic|license|token)', '', 'g') AS t FROM t)
SELECT doc_id, CASE WHEN contains(t, 'worthless') OR contains(t, 'pathetic') THEN 'adverse' WHEN contains(t, 'license') OR contains(t, 'token') THEN 'warning' ELSE 'info' END AS severity FROM n""")
def keyword_severity_documents(spark, d):
    return fixtures.table(spark, d, "documents").select("doc_id", keyword_severity("text", BUCKETS, NEGATIONS).alias("severity"))


@query("""SELECT c_custkey AS npi, CAST(c_custkey % 97 + 10 AS VARCHAR) || ' n main st|springfield|CA|12345' AS address FROM customer""")
def address_normalize(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("npi"), F.concat((F.col("c_custkey") % 97 + 10).cast("string"), F.lit("  North Main Street, Suite 200")).alias("street"))
    return c.select("npi", address_key("street", F.lit(" SpringField "), F.lit("ca"), F.lit("12345-6789")).alias("address"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS links FROM pages WHERE len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) > 0""")
def page_links(spark, d):
    return textmine.links(fixtures.table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@query(f"""WITH {ALERTS}, {PEOPLE} SELECT flag_id, npi, severity, name, state FROM alerts JOIN people USING (npi) WHERE created_at > TIMESTAMP '2024-01-20' AND severity <= 2""")
def alert_feed(spark, d):
    out = serving.alert_feed(fixtures.alerts(fixtures.table(spark, d, "events")), fixtures.people(spark, d), F.lit("2024-01-20").cast("timestamp"))
    return out.select("flag_id", "npi", "severity", "name", "state")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type AS flag_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    out = feeds.tumbling(fixtures.alerts(fixtures.table(spark, d, "events")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "flag_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS npi, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, k""")
def events_session(spark, d):
    out = feeds.sessions(fixtures.alerts(fixtures.table(spark, d, "events")))
    return out.select("npi", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT count(*) AS rows, count(*) FILTER (value IS NULL) AS unstamped, max(value) AS latest FROM events")
def data_vintage(spark, d):
    return serving.vintage(fixtures.table(spark, d, "events"), "value")


@query("SELECT event_type AS target, count(*) AS times, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def prior_access(spark, d):
    e = fixtures.table(spark, d, "events").select(F.col("event_type").alias("target"), "user_id")
    return serving.prior_access(e)


@query(f"WITH {SCORED} SELECT npi, least(CASE WHEN excluded OR risk_score >= 90 THEN 1 WHEN risk_score >= 75 THEN 2 WHEN risk_score >= 55 THEN 3 ELSE 4 END + CAST(specialty = 'BUILDING' AS INT), 4) AS priority FROM scored")
def brief_priority(spark, d):
    return scored(spark, d).select("npi", serving.priority(F.col("risk_score"), F.col("excluded"), F.col("specialty") == "BUILDING").alias("priority"))


@query(f"WITH {PEOPLE} SELECT count(*) AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = npi)) AS matched FROM people")
def registry_coverage(spark, d):
    o = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("npi"))
    return serving.coverage(fixtures.people(spark, d), o, "npi").select("rows", "matched")


@query(f"""WITH {SCORED}, t AS (SELECT npi, CASE WHEN excluded THEN 1 ELSE 0 END AS x, CASE WHEN risk_score >= 75 OR excluded THEN 1 ELSE 0 END AS c, 1 AS z FROM scored)
SELECT npi, CAST(x + c + z AS BIGINT) AS steps FROM t""")
def action_plan(spark, d):
    p = scored_by_provider(spark, d)
    p = p.withColumns({"priority": serving.priority(F.col("risk_score"), F.col("excluded"), F.lit(False)), "excess": F.lit(0.0), "cluster_size": F.lit(0), "suspicious_edges": F.lit(0)})
    return briefs.action_plan(p).groupBy("npi").agg(F.count("*").alias("steps"))


@query(f"""WITH {EDGES}, b AS (SELECT source AS npi, target AS other, shared FROM edges UNION ALL SELECT target, source, shared FROM edges)
SELECT npi, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY shared DESC, other) AS n FROM b) WHERE n <= 5""")
def top_neighbours(spark, d):
    return briefs.top_neighbours(fixtures.edges(spark, d), 5)


@query("""WITH l AS (SELECT o_custkey AS npi, p_brand AS code, sum(l_quantity) AS services, count(DISTINCT l_orderkey) AS benes, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS payment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT npi, code, CASE WHEN code IN ('Brand#4', 'Brand#5') THEN 'highest visit level' WHEN services / benes > 100 THEN 'many services per beneficiary' ELSE 'usual' END AS note FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY payment DESC, code) AS n FROM l) WHERE n <= 3""")
def annotated_lines(spark, d):
    per = fixtures.lines_by_provider(spark, d).groupBy("npi", "code").agg(F.sum("services").alias("services"), F.count_distinct("bene").alias("beneficiaries"), F.sum("charge").alias("payment"))
    return briefs.annotated_lines(per, ["Brand#4", "Brand#5"], 3).select("npi", "code", "note")


MODEL = ["total_payment", "total_services", "total_beneficiaries", "procedure_types"]


@query(None)
def iso_forest_rank(spark, d):
    return models.isolation_scores(scored(spark, d).select("npi", *(F.col(c).cast("double").alias(c) for c in MODEL)), MODEL, trees=50)


@query(None)
def gbt_score(spark, d):
    p = scored(spark, d).select("npi", *(F.col(c).cast("double").alias(c) for c in MODEL), F.col("excluded").cast("int").alias("label"), F.lit(1.0).alias("weight"))
    return models.boosted_scores(p, MODEL).select("npi", "boosted")


@query(None)
def pca_recon(spark, d):
    p = scored(spark, d).select("npi", *(F.col(c).cast("double").alias(c) for c in MODEL))
    return models.reconstruction_errors(p, MODEL, 2).select("npi", "error")


@query(None)
def sampled_edges(spark, d):
    return graph.sampled_edges(scored(spark, d))
