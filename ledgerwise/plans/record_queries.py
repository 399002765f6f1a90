"""Queries: names and amounts as shown, phrases, findings, dockets, digests, steps, year pairs, files by digest, tables replaced, live batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import canonical, display_name, whole_money
from ..operators import briefs, detectors, graph, review, serving, textmine
from ..sources import readers, writers
from ..sources.staging import new_path
from ..streaming import feeds
from .registry import ALERTS, EDGES, PEOPLE, PROV, SCORED, TOTALS, fixtures, query, scored, totals
from .review_queries import _csv
from .serving_queries import BUCKETS, CLUSTERS, LEADS, NEGATIONS, _leads

RANK = "CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 3 ELSE 2 END"


@query("""SELECT s_suppkey AS npi, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 4 > 0 THEN s_name || ' Jr' WHEN s_suppkey % 3 = 2 THEN s_name WHEN s_suppkey % 4 > 0 THEN 'Jr' ELSE CAST(s_suppkey AS VARCHAR) END AS name FROM supplier""")
def display_names(spark, d):
    s = fixtures.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    first = F.when(key % 3 == 1, "  ").when(key % 3 == 2, F.concat(F.lit(" "), "s_name", F.lit(" ")))
    return s.select(key.alias("npi"), display_name(first, F.when(key % 4 > 0, "Jr "), key).alias("name"))


@query(f"""WITH {PEOPLE} SELECT npi, CASE WHEN npi % 4 IN (1, 2) THEN 'unknown' WHEN specialty = 'BUILDING' THEN 'construction' WHEN specialty = 'MACHINERY' THEN 'heavy machinery' ELSE lower(specialty) END AS specialty FROM people""")
def specialty_names(spark, d):
    p = fixtures.people(spark, d)
    shown = F.when(F.col("npi") % 4 == 0, F.concat(F.lit(" "), "specialty", F.lit("  "))).when(F.col("npi") % 4 == 1, " ").when(F.col("npi") % 4 == 3, F.col("specialty"))
    return p.select("npi", canonical(shown, {"building": "construction", "machinery": "heavy machinery"}).alias("specialty"))


@query(f"WITH {PROV} SELECT npi, '$' || format('{{:,}}', CAST(round(total_payment) AS BIGINT)) AS paid FROM prov")
def whole_amounts(spark, d):
    return fixtures.providers(spark, d).select("npi", whole_money("total_payment").alias("paid"))


_FREE = "regexp_replace(lower(text), '(under the|gnu general public|released)(\\s*)({0})', '', 'g')"


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains({_FREE.format(p)}, '{p}') THEN '{p}' END" for _, phrases in BUCKETS for p in phrases) + ") AS phrases FROM documents")
def phrases_found(spark, d):
    """All phrases that occur without a negation before them, in the order of the buckets."""
    return textmine.judged(fixtures.table(spark, d, "documents"), BUCKETS, NEGATIONS).select("doc_id", F.array_join("phrases", ",").alias("phrases"))


@query(f"""WITH {SCORED}, a AS (SELECT address, count(*) AS n FROM scored GROUP BY 1) SELECT npi, concat_ws('; ', CASE WHEN excluded THEN 'exclusion: on the list' END, CASE WHEN 2 * pv >= 3 THEN 'payment against peers: ' || format('{{:.1f}}x', 2 * pv) END,
CASE WHEN 2 * ppb_vs_peer >= 2.5 THEN 'payment per beneficiary: ' || format('{{:.1f}}x', 2 * ppb_vs_peer) END, CASE WHEN total_payment > med THEN 'excess' END, CASE WHEN n >= 3 THEN 'shared address: ' || n || ' providers' END,
CASE WHEN npi % 3 > 0 THEN 'kinds of flags: ' || npi % 3 END) AS findings FROM scored JOIN a USING (address)""")
def brief_findings(spark, d):
    p = scored(spark, d)
    sizes = p.groupBy("address").agg(F.count("*").alias("cluster_size"))
    excess = F.greatest(F.lit(0.0), F.col("total_payment") - F.col("med"))
    p = p.join(sizes, "address").withColumns({"payment_vs_peer": 2 * F.col("pv"), "ppb_vs_peer": 2 * F.col("ppb_vs_peer"), "excess": excess, "flag_types": F.col("npi") % 3})
    told = F.transform("findings", lambda f: F.when(f["label"] == "excess", f["label"]).otherwise(F.concat_ws(": ", f["label"], f["value"])))
    return briefs.key_findings(p).select("npi", F.array_join(told, "; ").alias("findings"))


@query(f"""WITH {LEADS} SELECT npi, concat_ws('; ', CASE WHEN s.excluded THEN 'verify exclusion' END, CASE WHEN cluster_size >= 3 THEN 'visit address' END, CASE WHEN excess >= 250000 THEN 'request records' END, CASE WHEN flag_types >= 3 THEN 'full review' END) AS steps
FROM leads JOIN (SELECT npi, excluded FROM scored) s USING (npi)""")
def next_steps(spark, d):
    leads = _leads(spark, d)
    return leads.select("npi", F.array_join(graph.next_steps(leads), "; ").alias("steps"))


@query("""WITH c AS (SELECT c_custkey AS npi, c_name AS name, c_custkey AS k FROM customer WHERE c_custkey % 11 > 0),
r AS (SELECT npi, CASE k % 3 WHEN 0 THEN 'United States v. ' || name WHEN 1 THEN 'Doe, Qui Tam, v. ' || name ELSE 'Smith v. ' || name END AS title, '2019-03-01' AS date, CASE WHEN k % 3 < 2 THEN 'critical' ELSE 'warning' END AS severity FROM c
  UNION ALL SELECT npi, 'State of Ohio v. ' || name, CASE WHEN k % 2 = 1 THEN '2021-05-01' END, 'adverse' FROM c UNION ALL SELECT npi, 'Roe v. ' || name, '2020-01-0' || (1 + k % 9), 'warning' FROM c)
SELECT npi, n, title, severity FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'adverse' THEN 2 ELSE 3 END, date DESC NULLS LAST, title) AS n FROM r) WHERE n <= 2""")
def docket_list(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("npi"), "c_name")
    k = F.col("npi")
    one = lambda title, date: F.struct(F.concat(title, "c_name").alias("caseName"), date.alias("dateFiled"), F.lit("ca9").alias("court"))
    first = F.when(k % 3 == 0, "United States v. ").when(k % 3 == 1, "Doe, Qui Tam, v. ").otherwise("Smith v. ")
    cases = F.array(one(first, F.lit("2019-03-01")), one(F.lit("State of Ohio v. "), F.when(k % 2 == 1, "2021-05-01")), one(F.lit("Roe v. "), F.concat(F.lit("2020-01-0"), (1 + k % 9).cast("string"))))
    texts = c.select("npi", F.when(k % 11 > 0, F.to_json(F.struct(cases.alias("results")))).alias("results"))
    return briefs.dockets(texts, 2).select("npi", "n", "title", "severity")


@query(f"""WITH own AS (SELECT DISTINCT o_custkey AS npi FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 2),
f AS (SELECT npi, date_trunc('day', ts) AS day, event_type || '-' || (event_id % 4) AS title, {RANK} AS s FROM events JOIN own ON user_id = npi),
now AS (SELECT npi, max(day) AS day FROM f GROUP BY 1 HAVING max(day) >= TIMESTAMP '2024-01-10'),
old AS (SELECT f.npi, max(f.day) AS day FROM f JOIN now USING (npi) WHERE f.day < now.day AND f.day >= now.day - INTERVAL 5 DAY GROUP BY 1),
had AS (SELECT DISTINCT npi, title FROM f JOIN old USING (npi, day))
SELECT npi, count(*) AS new_findings, max(s) AS worst FROM f JOIN now USING (npi, day) ANTI JOIN had USING (npi, title) GROUP BY 1""")
def user_digest(spark, d):
    """A reviewer's open cases with findings that the run before, at most five days older, didn't have; a day's events are a run's findings."""
    o = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("npi"), (F.col("o_orderkey") % 5).cast("string").alias("assigned_to"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    e = fixtures.table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    none = F.lit(None).cast("string")
    finding = F.struct(F.col("event_type").alias("source"), F.concat_ws("-", "event_type", (F.col("event_id") % 4).cast("string")).alias("title"), none.alias("url"), none.alias("date"), severity.alias("severity"))
    runs = e.groupBy(F.col("user_id").alias("npi"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("started")).agg(F.collect_list(finding).alias("findings"))  # a provider's events of a day
    return briefs.digest(o, runs, "2", F.lit("2024-01-10").cast("timestamp"), days=5)


@query(f"""SELECT event_type || event_id AS title FROM events ORDER BY {RANK} DESC, CASE WHEN event_id % 500 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END, event_type || event_id LIMIT 40""")
def finding_order(spark, d):
    """Worst first, then the earliest; a missing date comes before all."""
    e = fixtures.table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    rows = e.select(F.concat("event_type", F.col("event_id").cast("string")).alias("title"), severity.alias("severity"), F.when(F.col("event_id") % 500 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    return review.finding_order(rows).select("title").limit(40)


@query(f"WITH {TOTALS}, y AS (SELECT max(year) AS y FROM totals) SELECT n.npi, n.specialty, b.payment AS before, n.payment AS now FROM totals n JOIN totals b ON n.npi = b.npi AND b.year = n.year - 1 JOIN y ON n.year = y")
def latest_year_pairs(spark, d):
    t = totals(spark, d)
    return detectors.yoy_pairs(t, detectors.latest_year(t)).select("npi", "specialty", "before", "now")


@query(f"WITH {EDGES} SELECT source, target, round(greatest(1, least(5, ln(1 + shared) * 0.6)), 6) AS width FROM edges")
def edge_widths(spark, d):
    return fixtures.edges(spark, d).select("source", "target", F.round(graph.edge_width(F.col("shared")), 6).alias("width"))


@query(f"WITH {CLUSTERS} SELECT address, provider_count, max_risk FROM clusters ORDER BY provider_count DESC, max_risk DESC, address LIMIT 10")
def largest_clusters(spark, d):
    return graph.address_clusters(scored(spark, d), most=10).select("address", "provider_count", "max_risk")


@query(f"WITH {PEOPLE} SELECT npi, name, state FROM people WHERE state = 'NATION_4'")
def default_jurisdiction(spark, d):
    """Nobody asked for a state: the first one that the user may see."""
    access = ["NATION_4", "NATION_3"]
    return serving.search(fixtures.people(spark, d), state=serving.default_state(access, None), access=access).select("npi", "name", "state")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS npi, CAST(1 + c_custkey % 2 AS VARCHAR) AS entity_type, '01/02/2003' AS enumeration_date, 'Y' AS is_sole_proprietor, c_name AS taxonomy_primary, c_custkey || ' Main, "Old" St' AS street, 'Troy' AS city, 'NY' AS state, '12180' AS zip FROM customer WHERE c_custkey % 3 = 1""")
def registry_file_read(spark, d):
    """Nine of a wide file's columns, of the providers that are known; a street with commas and quotes stays whole."""
    c = fixtures.table(spark, d, "customer")
    key, names = F.col("c_custkey").cast("string"), readers.REGISTRY
    values = [key, (1 + F.col("c_custkey") % 2).cast("string"), F.lit("01/02/2003"), F.lit("Y"), F.col("c_name"), F.concat(key, F.lit(' Main, "Old" St')), F.lit("Troy"), F.lit("NY"), F.lit("12180")]
    wide = [v.alias(n[0].title()) for v, n in zip(values, names.values(), strict=True)] + [F.lit(i).alias(f"Other {i}") for i in range(40)]
    path = new_path(spark, "wide-csv")
    c.select(*wide).write.option("header", True).option("escape", '"').csv(path)
    return readers.registry_file(spark, path, c.where("c_custkey % 3 = 1").select(key.alias("npi"))).select(*names)


@query("SELECT '3' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS npi, c_name AS lastname FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0")
def exclusion_file_loose(spark, d):
    """Any ten digits but zeros, where the strict reader asks for a 1 or 2 in front."""
    c, k = fixtures.table(spark, d, "customer"), F.col("c_custkey")
    npi = F.when(k % 5 == 0, "0000000000").when(k % 11 == 0, "12345").otherwise(F.concat(F.lit("3"), F.lpad(k.cast("string"), 9, "0")))
    path = _csv(c.select(F.col("c_name").alias("LASTNAME"), npi.alias("NPI"), F.when(k % 7 == 0, "20200101").otherwise("0").alias("REINDATE")), "loose-csv")
    return readers.exclusion_file(spark, path).select("npi", "lastname")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE 'changed' END AS change, sha256(n_name || chr(10)) AS sha256 FROM nation WHERE n_nationkey % 4 < 2")
def file_changes(spark, d):
    """Files by their SHA-256 against those of the last run: a quarter is new, a quarter has changed."""
    path = new_path(spark, "files")
    fixtures.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(path)
    number = F.regexp_extract("path", r"k=(\d+)", 1).cast("int")
    known = readers.file_digests(spark, path).where(number % 4 > 0).select("path", F.when(number % 4 == 1, "as it was").otherwise(F.col("sha256")).alias("sha256"))
    return readers.changed_files(spark, path, known).select(number.alias("k"), "change", "sha256")


@query("SELECT strftime(max(m), '%Y-%m-%d') AS month FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE month(o_orderdate) % 5 = 2) WHERE m BETWEEN DATE '1996-12-01' AND DATE '1997-06-01'")
def latest_month(spark, d):
    """The newest monthly file up to June 1997; there are some for February, July and December."""
    months = fixtures.table(spark, d, "orders").where(F.month("o_orderdate") % 5 == 2).select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return readers.latest_snapshot(months, "1997-06-15").select(F.date_format("month", "yyyy-MM-dd").alias("month"))


@query(f"WITH {PEOPLE} SELECT npi, name FROM people WHERE npi % 2 = 0")
def table_replaced(spark, d):
    p, path = fixtures.people(spark, d).select("npi", "name"), new_path(spark, "replaced")
    writers.replace_table(p, path)
    writers.replace_table(p.where("npi % 2 = 0"), path)
    return spark.read.parquet(path)


@query(f"WITH {ALERTS}, {PEOPLE} SELECT flag_id, npi, severity, name FROM alerts JOIN people USING (npi) WHERE severity <= 2 AND state IN ('NATION_1', 'NATION_2', 'NATION_3') ORDER BY severity, created_at DESC, flag_id LIMIT 15")
def live_batches(spark, d):
    """Each batch's worst alerts as they are sent; the worst of all of them are the whole table's."""
    events = feeds.event_stream(spark, f"{d}/events*.parquet", fixtures.table(spark, d, "events").schema)
    live = feeds.live_alerts(fixtures.alerts(events), fixtures.people(spark, d), access=["NATION_1", "NATION_2", "NATION_3"])
    out = new_path(spark, "sent")
    spark.createDataFrame([], live.schema).write.parquet(out)  # nothing may be sent at all
    feeds.send_batches(live, lambda top, number: top.write.mode("append").parquet(out), lambda number: None, new_path(spark, "progress")).awaitTermination()
    sent = spark.read.schema(live.schema).parquet(out).dropDuplicates(["flag_id"])  # a batch may be run again
    return sent.orderBy("severity", F.desc("created_at"), "flag_id").limit(15).select("flag_id", "npi", "severity", "name")
