"""Queries: search indexes, bucketed tables, snapshots, guarded streams, deliveries, hot groups, networks of all providers, zips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import title_case
from ..operators import detectors, graph, quantiles, search_index, snapshot, textmine
from ..sources import zips
from ..sources.buckets import Buckets
from ..sources.staging import new_path, written
from ..streaming import delivery, feeds, guards
from .registry import ALERTS, EDGES, PEOPLE, SCORED, fixtures, query, scored
from .serving_queries import SUPPLIERS, _suppliers
from .stream_queries import _drained, _events

#: Stems of the words that customers' rows have. Fixed values.
_STEMS = "CASE w WHEN 'building' THEN 'build' WHEN 'machinery' THEN 'machineri' WHEN 'automobile' THEN 'automobil' WHEN 'furniture' THEN 'furnitur' WHEN 'customer' THEN 'custom' ELSE w END"
_TOKENS = f"""t AS (SELECT npi, i, {_STEMS} AS w, CASE WHEN i <= len(regexp_extract_all(lower(name), '[a-z0-9]+')) THEN 1.0 ELSE 0.1 END AS weight FROM (
  SELECT npi, name, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT npi, name, regexp_extract_all(lower(name || ' ' || specialty || ' ' || state), '[a-z0-9]+') AS ws FROM base)))"""
#: Each term's places in order: the heaviest counts whole, the j-th one its weight / j^2.
_RANKED = """e AS (SELECT npi, w, list(weight ORDER BY i) AS ws FROM t WHERE w IN ({0}) GROUP BY 1, 2),
r AS (SELECT npi, w, (list_max(ws) + list_sum(list_transform(ws, lambda x, j: x / (j * j))) - list_max(ws) / (list_position(ws, list_max(ws)) ** 2)) / 1.64493406685 AS r FROM e)
SELECT npi, CAST(count(*) AS INTEGER) AS terms, round(sum(r) / {1}, 6) AS rank FROM r GROUP BY 1 HAVING count(*) = {1}"""
_FIELDS = {"name": "A", "specialty": "D", "state": "D"}


def _text_index(spark, people: DataFrame):
    index = search_index.text_index(spark, new_path(spark, "terms"), 32)
    index.create(search_index.postings(people, "npi", _FIELDS))
    return index


def _found(index, spark, text: str) -> DataFrame:
    return search_index.text_search(index, spark, text).select(F.col("id").alias("npi"), "terms", F.round("rank", 6).alias("rank"))


@query(f"WITH {PEOPLE}, base AS (SELECT * FROM people), {_TOKENS}, {_RANKED.format(chr(39) + 'build' + chr(39) + ', ' + chr(39) + 'custom' + chr(39), 2)}")
def fulltext_search(spark, d):
    return _found(_text_index(spark, fixtures.people(spark, d)), spark, "the customers of Building")


@query(f"""WITH {PEOPLE}, base AS (SELECT npi, name, CASE WHEN excluded THEN 'FURNITURE' ELSE specialty END AS specialty, state FROM people), {_TOKENS}, {_RANKED.format(chr(39) + 'furnitur' + chr(39), 1)}""")
def fulltext_refreshed(spark, d):
    """Excluded providers change their specialty; only buckets of terms that they had or have are written again."""
    people = fixtures.people(spark, d)
    index = _text_index(spark, people)
    was = people.where("excluded")
    search_index.refresh_text(index, was, was.withColumn("specialty", F.lit("FURNITURE")), "npi", _FIELDS)
    return _found(index, spark, "furniture")


def _people_buckets(spark, people: DataFrame, columns: list[str]):
    table = Buckets(new_path(spark, "people"), ("npi",), 32)
    table.create(people)
    index = search_index.gram_index(spark, new_path(spark, "grams"), 32)
    index.create(search_index.grams(people, "npi", columns))
    return table, index


@query(f"WITH {PEOPLE} SELECT npi, name, specialty, state FROM people WHERE contains(lower(name), '0001') OR contains(lower(specialty), '0001') OR contains(lower(state), '0001')")
def substring_indexed(spark, d):
    columns = ["name", "specialty", "state"]
    table, index = _people_buckets(spark, fixtures.people(spark, d).select("npi", *columns), columns)
    return search_index.containing(table, index, spark, "0001", columns)


@query(f"""WITH {PEOPLE} SELECT npi, CASE WHEN npi % 3 = 0 THEN name || ' Group' ELSE name END AS name FROM people WHERE npi % 3 = 0""")
def substring_refreshed(spark, d):
    """A third of the providers change their names; the index follows, and finds all of them and no others by the new part."""
    people = fixtures.people(spark, d).select("npi", "name")
    table, index = _people_buckets(spark, people, ["name"])
    was = people.where("npi % 3 = 0")
    now = written(was.withColumn("name", F.concat("name", F.lit(" Group"))), "renamed")
    table.upsert(now)
    search_index.refresh_grams(index, was, now, "npi", ["name"])
    return search_index.containing(table, index, spark, "GROUP", ["name"])


@query(f"""WITH {EDGES}, {SCORED} SELECT npi, name, state, risk_score, npi IN (SELECT source FROM edges) AS has_edges FROM scored WHERE contains(lower(name), '0001') ORDER BY has_edges DESC, risk_score DESC NULLS LAST, npi LIMIT 20""")
def node_search_indexed(spark, d):
    table, index = _people_buckets(spark, scored(spark, d).select("npi", "name", "state", "risk_score"), ["name"])
    maybe = search_index.containing(table, index, spark, "0001", ["name"])
    return graph.node_search(maybe, fixtures.edges(spark, d, by=("source",)), "0001", columns=("name",)).select("npi", "name", "state", "risk_score", "has_edges")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS v, o_orderkey % 2 = 0 AND o_orderstatus = 'F' AS is_new FROM orders
UNION ALL SELECT -o_orderkey, o_totalprice, TRUE FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""")
def bucket_upsert(spark, d):
    orders = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    table = Buckets(new_path(spark, "upserted"), ("k",), 32)
    table.create(orders.select("k", "v", F.lit(False).alias("is_new")))
    new = orders.where("o_orderstatus = 'F' AND k % 2 = 0")
    table.upsert(new.select("k", (-F.col("v")).alias("v"), F.lit(True).alias("is_new")).unionByName(new.select((-F.col("k")).alias("k"), "v", F.lit(True).alias("is_new"))))
    return table.table(spark)


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'changed' END, c_name) ELSE c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def bucket_update(spark, d):
    """Keys that the table doesn't have and null values change nothing; rows of deleted keys go."""
    people = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    table = Buckets(new_path(spark, "updated"), ("k",), 16)
    table.create(people.drop("c_acctbal"))
    news = people.where("c_acctbal < 0").select("k", F.when(F.col("k") % 2 == 0, "changed").alias("name"))
    table.update(news.unionByName(news.limit(1).select((-F.col("k")).alias("k"), F.lit("nobody").alias("name"))), ["name"])
    table.delete(people.where("segment = 'BUILDING'"))
    return table.table(spark)


_FIGURES = """count(*) AS providers, count(*) FILTER (excluded) AS excluded, count(*) FILTER (risk_score >= 70) AS high_risk, count(*) FILTER (risk_score >= 70 AND NOT excluded) AS new_leads, count(*) FILTER (risk_score >= 90) AS critical,
count(*) FILTER (risk_score >= 70 AND risk_score < 90) AS high, count(*) FILTER (risk_score >= 50 AND risk_score < 70) AS medium, count(*) FILTER (risk_score < 50) AS low, round(sum(total_payment), 0) AS total_payment, count(DISTINCT state) AS states"""
_CHANGED = "changed AS (SELECT npi, excluded, CASE WHEN npi % 4 = 0 THEN 'NATION_1' ELSE state END AS state, CASE WHEN npi % 4 = 0 THEN 95.0 ELSE risk_score END AS risk_score, total_payment FROM scored WHERE npi % 9 <> 0)"
_CASES = "(SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'{0})"


def _cases(spark, d) -> DataFrame:
    orders = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("npi"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return orders.join(fixtures.people(spark, d).select("npi", "state"), "npi", "left")


def _changed(spark, d) -> tuple[snapshot.Buckets, DataFrame]:
    """A snapshot of all providers, brought up to date: a ninth left, and a quarter of the others moved and got another score."""
    people = scored(spark, d).select("npi", "excluded", "state", "risk_score", "total_payment")
    table = snapshot.snapshot_table(new_path(spark, "figures"))
    snapshot.take(table, people)
    was = people.where("npi % 9 = 0 OR npi % 4 = 0")
    moved = {"state": F.when(F.col("npi") % 4 == 0, "NATION_1").otherwise(F.col("state")), "risk_score": F.when(F.col("npi") % 4 == 0, 95.0).otherwise(F.col("risk_score"))}
    snapshot.refresh(table, was, was.where("npi % 9 <> 0").withColumns(moved))
    return table, people.where("npi % 9 <> 0").withColumns(moved)


@query(f"WITH {SCORED}, {_CHANGED} SELECT {_FIGURES}, {_CASES.format('')} AS open_cases FROM changed")
def dashboard_snapshot(spark, d):
    """What the snapshot says after the changes, which is what counting anew would."""
    table, people = _changed(spark, d)
    return snapshot.dashboard(spark, table, people, _cases(spark, d)).withColumn("total_payment", F.round(F.col("total_payment").cast("double"), 0))


@query(f"WITH {SCORED}, {_CHANGED} SELECT {_FIGURES}, {_CASES.format(chr(32) + 'AND n_name IN (' + chr(39) + 'NATION_1' + chr(39) + ', ' + chr(39) + 'NATION_2' + chr(39) + ')')} AS open_cases FROM changed WHERE state IN ('NATION_1', 'NATION_2')")
def dashboard_limited(spark, d):
    """A user who may see two states gets live figures of these."""
    table, people = _changed(spark, d)
    return snapshot.dashboard(spark, table, people, _cases(spark, d), ["NATION_1", "NATION_2"]).withColumn("total_payment", F.round(F.col("total_payment").cast("double"), 0))


def _quantiles_of_time(events: DataFrame, at: list[float]) -> list[float]:
    """Percentiles of `ts` in microseconds, by counted ranges, since all different times would be one task's buffer."""
    times = events.select(F.lit(1).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return quantiles.percentiles(times, ["k"], "t", at).first()["p"]


def _by_day(spark, d) -> str:
    """The events in files of four weeks or so each, written one after the other, so that a stream meets them in order."""
    events, path = fixtures.table(spark, d, "events"), new_path(spark, "in-order")
    bounds = _quantiles_of_time(events, [0.25, 0.5, 0.75])
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = events.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


#: Lines of an archive, twice that at most on the whole.
ZIP_LINES = 250_000

#: A ticket for each user and six hours, good for two hours.
_TICKET = "SELECT event_id AS use_id, user_id || '-' || CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS t, time_bucket(INTERVAL 6 HOUR, ts) AS issued_at, ts FROM events"


@query(f"""WITH u AS ({_TICKET}), n AS (SELECT *, ts <= issued_at + INTERVAL 2 HOUR AS ok, row_number() OVER (PARTITION BY t, ts <= issued_at + INTERVAL 2 HOUR ORDER BY ts, use_id) AS n FROM u)
SELECT use_id, CASE WHEN NOT ok THEN 'expired' WHEN n = 1 THEN 'accepted' ELSE 'used' END AS verdict FROM n""")
def streamed_tickets(spark, d):
    start = F.window("created_at", "6 hours")["start"]
    events = _events(spark, d, _by_day(spark, d)).withColumn("issued_at", start)
    uses = events.select(F.concat_ws("-", "npi", F.col("issued_at").cast("string")).alias("ticket"), "issued_at", F.col("flag_id").alias("use_id"), F.col("created_at").alias("used_at"))
    return _drained(guards.tickets(uses, 2 * 3600, "1 day")).select("use_id", "verdict")


@query("""WITH e AS (SELECT event_id, user_id, ts, value, event_type FROM events WHERE event_type IN ('purchase', 'click', 'error')),
h AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN ROW(ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM e)
SELECT h.event_id AS ask_id, h.user_id AS key, CASE WHEN s.event_type = 'purchase' AND h.ts <= s.ts + INTERVAL 12 HOUR THEN s.value END AS value FROM h LEFT JOIN e s ON s.event_id = h.last[2] WHERE h.event_type = 'click'""")
def streamed_cache(spark, d):
    """A purchase sets a user's value for twelve hours, an error deletes it, a click asks for it."""
    events = _events(spark, d, _by_day(spark, d)).where("flag_type IN ('purchase', 'click', 'error')")
    kind = F.when(F.col("flag_type") == "purchase", "set").when(F.col("flag_type") == "error", "delete").otherwise("get")
    asks = events.select(F.col("npi").alias("key"), F.col("flag_id").alias("ask_id"), F.col("created_at").alias("at"), kind.alias("kind"), "value")
    return _drained(guards.cached(asks, 12 * 3600, "1 day")).drop("batch")


def _send(sent: str):
    """A receiver that keeps what it gets, with the number of the batch."""
    return lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(sent)


@query(f"WITH {ALERTS} SELECT flag_id, npi, severity FROM alerts")
def delivered_once(spark, d):
    """A stream's batches, the last of which comes twice, as after a failure: each alert is sent once."""
    sent, outbox = new_path(spark, "sent"), delivery.Outbox(new_path(spark, "outbox"))
    last = []

    def twice(df: DataFrame, number: int) -> None:
        outbox.deliver(df, number, _send(sent))
        outbox.deliver(df, number, _send(sent))
        last.append(number)

    feeds.refresh(_events(spark, d, _by_day(spark, d)), twice, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(sent).select("flag_id", "npi", "severity")



@query(f"""WITH {ALERTS}, h AS (SELECT CAST(quantile_cont(epoch_us(ts), 0.5) AS BIGINT) AS half FROM events)
SELECT flag_id, CASE WHEN epoch_us(created_at) <= half AND flag_id % 5 <> 0 THEN 1 ELSE 2 END AS batch FROM alerts, h WHERE flag_id % 5 <> 0 OR epoch_us(created_at) > half - 7 * 86400000000""")
def delivered_late(spark, d):
    """A fifth of the alerts is committed after the first poll. The second one looks back a week and sends those of that week, nothing twice."""
    alerts = fixtures.alerts(fixtures.table(spark, d, "events"))
    half = int(alerts.agg(F.percentile(F.unix_micros("created_at"), 0.5)).first()[0])
    at = F.timestamp_micros(F.lit(half))
    sent, outbox = new_path(spark, "sent"), delivery.Outbox(new_path(spark, "outbox"))
    first = alerts.where((F.unix_micros("created_at") <= half) & (F.col("flag_id") % 5 != 0))
    outbox.poll(first, 1, F.timestamp_micros(F.lit(0)), _send(sent))
    outbox.poll(alerts, 2, at, _send(sent), back="7 days")
    return spark.read.parquet(sent).select("flag_id", "batch")


@query(f"""WITH {ALERTS}, q AS (SELECT quantile_cont(epoch_us(ts), [0.25, 0.5, 0.75]) AS q FROM events),
b AS (SELECT flag_id, severity, created_at, CASE WHEN epoch_us(created_at) <= q[1] THEN 0 WHEN epoch_us(created_at) <= q[2] THEN 1 WHEN epoch_us(created_at) <= q[3] THEN 2 ELSE 3 END AS batch FROM alerts, q),
n AS (SELECT batch, flag_id, row_number() OVER (PARTITION BY batch ORDER BY severity, created_at DESC, flag_id) AS n FROM b WHERE severity <= 2 AND batch <> 2)
SELECT batch, 'alert' AS kind, flag_id FROM n WHERE n <= 15 UNION ALL SELECT DISTINCT 2, 'heartbeat', -1 FROM events""")
def batches_with_heartbeat(spark, d):
    """Four batches: the worst and latest alerts of three, and a heartbeat for the one that has none."""
    cuts = fixtures.table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.percentile("t", [0.5, 0.75])).first()[0]
    at, out = F.unix_micros("created_at"), new_path(spark, "told")
    stream = _events(spark, d, _by_day(spark, d)).where((F.col("severity") <= 2) & ((at <= cuts[0]) | (at > cuts[1])))
    put = lambda df, number, kind: df.select(F.lit(number).alias("batch"), F.lit(kind).alias("kind"), F.col("flag_id").cast("long").alias("flag_id")).write.mode("append").parquet(out)
    feeds.send_batches(
        stream, lambda df, n: put(df, n, "alert"), lambda n: put(spark.createDataFrame([(-1,)], "flag_id long"), n, "heartbeat"), new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
round(quantile_cont(l_quantity, 0.5), 4) AS q50 FROM lineitem GROUP BY 1, 2""")
def hot_percentiles(spark, d):
    """Groups of more than 500 lines are selected by counted ranges; quantities have 50 different values, prices as many as lines."""
    lines = fixtures.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice", "l_quantity")
    price = quantiles.percentiles(lines, ["flag", "status"], "l_extendedprice", [0.5, 0.9, 0.99], hot=500, few=100)
    count = quantiles.percentiles(lines, ["flag", "status"], "l_quantity", [0.5], hot=500, few=100)
    both = price.join(count.select("flag", "status", F.col("p").alias("q")), ["flag", "status"])
    return both.select("flag", "status", "n", *(F.round(F.get("p", F.lit(i)), 4).alias(c) for i, c in enumerate(("p50", "p90", "p99"))), F.round(F.get("q", F.lit(0)), 4).alias("q50"))


_ALL_FIRST = """f AS (SELECT * FROM (SELECT center, source, target, shared, row_number() OVER (PARTITION BY center ORDER BY shared DESC, source, target) AS n FROM (
  SELECT source AS center, * FROM edges UNION ALL SELECT target, * FROM edges)) WHERE n <= 40), n AS (SELECT DISTINCT center, CASE WHEN source = center THEN target ELSE source END AS npi FROM f)"""


@query(f"""WITH {EDGES}, {_ALL_FIRST}, i AS (SELECT a.center, e.*, row_number() OVER (PARTITION BY a.center ORDER BY shared DESC, source, target) AS n FROM edges e JOIN n a ON a.npi = source JOIN n b ON b.npi = target AND a.center = b.center)
SELECT center, source, target, shared, 1 AS hop FROM f UNION ALL SELECT center, source, target, shared, 0 FROM i WHERE n <= 30""")
def ego_networks_1hop(spark, d):
    edges = written(fixtures.edges(spark, d), "edges")
    return graph.ego_networks(edges, _suppliers(spark, d), 1, most_edges=40, most_inner=30)


@query(f"""WITH {EDGES}, {SUPPLIERS}, {_ALL_FIRST},
s AS (SELECT * FROM (SELECT center, source, target, shared, row_number() OVER (PARTITION BY center ORDER BY shared DESC, source, target) AS n FROM (
  SELECT DISTINCT n.center, e.* FROM edges e JOIN n ON n.npi = source OR n.npi = target WHERE source <> center AND target <> center)) WHERE n <= 60),
b AS (SELECT center, source, target, shared, 1 AS hop FROM f UNION ALL SELECT center, source, target, shared, 2 FROM s),
t AS (SELECT center, npi FROM (SELECT center, npi, row_number() OVER (PARTITION BY center ORDER BY npi <> center, risk_score DESC NULLS LAST, npi) AS n FROM (SELECT DISTINCT center, unnest([source, target]) AS npi FROM b) JOIN sup USING (npi)) WHERE n <= 25)
SELECT b.* FROM b JOIN t x ON x.center = b.center AND x.npi = source JOIN t y ON y.center = b.center AND y.npi = target""")
def ego_networks_2hop(spark, d):
    edges, people = written(fixtures.edges(spark, d), "edges"), _suppliers(spark, d)
    return graph.ego_networks(edges, people, 2, most_edges=40, people=people, most_nodes=25, second_edges=60)


@query(f"""WITH {EDGES} SELECT lpad(CAST(source AS VARCHAR), 10, '0') AS source, lpad(CAST(target AS VARCHAR), 10, '0') AS target, shared * 2 AS pairs, shared, CASE WHEN source % 3 = 0 THEN 0 ELSE target END AS same_day FROM edges WHERE shared >= 3""")
def zip_pairs(spark, d):
    """Pairs in zip archives, half of them with a header, as the source that they are downloaded as."""
    edges = written(fixtures.edges(spark, d), "edges")
    same_day = F.when(F.col("source") % 3 == 0, "n/a").otherwise(F.col("target").cast("string"))
    line = F.concat_ws(",", "source", "target", (F.col("shared") * 2).cast("string"), F.concat(F.col("shared").cast("string"), F.lit(".0")), same_day)
    rows = edges.select(line.alias("line"), (F.col("source") % 2).alias("half"))
    loops = edges.select(F.concat_ws(",", "source", "source", F.lit("9"), F.lit("9"), F.lit("1")).alias("line"), F.lit(0).alias("half"))
    folder, header = new_path(spark, "zips"), "NPI 1,NPI 2,Pair Count,Bene Count,Same Day Count"
    zips.write_zips(spark.createDataFrame([(header,)], "line string"), folder).count()  # one without pairs
    every, archives = rows.unionByName(loops.distinct()), edges.count() // ZIP_LINES + 1
    for half in (0, 1):
        zips.write_zips(every.where(F.col("half") == half).repartition(archives, "line"), folder, header=None if half else header).count()
    return zips.pairs_of(zips.zip_lines(spark, folder), least=3)


@query("""SELECT c_custkey AS k, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment || ' o''neil 3m ' || c_name), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM customer""")
def title_cased(spark, d):
    c = fixtures.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("k"), title_case(F.concat("c_mktsegment", F.lit(" o'neil 3m "), "c_name")).alias("name"))


#: Words of the corpus that stand for those of criminal actions and of civil ones.
_CRIMINAL, _CIVIL = ["that is the", "was on"], ["of the"]


@query(f"""SELECT doc_id, CASE WHEN {" OR ".join(f"contains(lower(text), '{w}')" for w in _CRIMINAL)} THEN 'critical' WHEN {" OR ".join(f"contains(lower(text), '{w}')" for w in _CIVIL)} THEN 'adverse' ELSE 'warning' END AS severity FROM documents""")
def enforcement_severities(spark, d):
    docs = fixtures.table(spark, d, "documents")
    return docs.select("doc_id", textmine.enforcement_severity("text", criminal=_CRIMINAL, civil=_CIVIL).alias("severity"))


@query("""SELECT o_custkey AS id, 'Order ' || o_orderkey || ' of ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.test/' ELSE 'https://site.test/news/' END || o_orderkey AS url,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date, CASE o_orderstatus WHEN 'F' THEN 'Was sentenced' WHEN 'O' THEN 'A settlement of ' || o_orderpriority ELSE '' END AS summary,
CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'adverse' ELSE 'warning' END AS severity FROM orders WHERE o_orderkey % 7 <> 0""")
def press_cards(spark, d):
    """A page of each customer's orders as press releases, some without date, body or title."""
    o = fixtures.table(spark, d, "orders")
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    title = F.concat(F.lit('<h2 class="t">\n <a rel="x" href="'), F.when(F.col("o_orderkey") % 2 == 0, "https://x.test/").otherwise("/news/"), key, F.lit('">Order <b>'), key, F.lit("</b>\n of "), kind, F.lit("</a></h2>"))
    body = F.when(F.col("o_orderstatus") == "F", F.lit("<p>Was\n  sentenced</p>")).when(F.col("o_orderstatus") == "O", F.concat(F.lit("A <i>settlement</i> of "), kind))
    card = F.concat(
        F.lit('<article class="node node--type-press-release c">'), F.when(F.col("o_orderkey") % 7 != 0, title).otherwise(F.lit("<h2>none</h2>")),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit('<time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00">x</time>'))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit('<div class="field field--name-body f">'), body, F.lit("</div>")), F.lit("")), F.lit("</article><article>other</article>"))
    pages = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(card)), "\n").alias("html"))
    return textmine.press_cards(pages, "https://site.test").drop("n").withColumn("date", F.col("date").cast("string"))


_DAYS = "date_diff('day', d, DATE '2024-06-30')"


@query(f"""WITH c AS (SELECT c_custkey AS npi, c_custkey % 10 = 0 AS off, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-06-30' - INTERVAL (c_custkey % 1500) DAY END AS d, c_custkey % 4 AS q, c_custkey % 5 AS a, c_custkey % 6 AS p, c_mktsegment AS s FROM customer),
m AS (SELECT *, greatest(0, CAST(floor({_DAYS} / 30.0) AS INTEGER)) AS months FROM c),
f AS (SELECT npi, 'critical' AS severity, 'deactivated, status D' AS title FROM m WHERE off UNION ALL SELECT npi, CASE WHEN months <= 24 THEN 'warning' ELSE 'info' END, 'new, ' || months || ' months' FROM m WHERE months <= 36
UNION ALL SELECT npi, 'adverse', 'name differs from billing record' FROM m WHERE q = 1 UNION ALL SELECT npi, 'info', a || ' other names' FROM m WHERE a > 0 UNION ALL SELECT npi, 'info', p || ' places' FROM m WHERE p >= 3)
SELECT * FROM f UNION ALL SELECT npi, 'none', 'identity verified, ' || s FROM m WHERE npi NOT IN (SELECT npi FROM f)""")
def registry_checked(spark, d):
    """Records made of customers: some deactivated, new, under another name, with other names or many places, and the rest verified."""
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("npi"), "c_name", "c_mktsegment")
    day = F.date_sub(F.lit("2024-06-30").cast("date"), (F.col("npi") % 1500).cast("int"))
    many = lambda n, value: F.transform(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= n), lambda i: value)
    basic = F.struct(
        F.when(F.col("npi") % 10 == 0, "D").otherwise("A").alias("status"), F.when(F.col("npi") % 3 == 0, day.cast("string")).alias("enumeration_date"),
        F.when(F.col("npi") % 4 >= 2, F.concat(F.lower("c_name"), F.lit(" inc"))).alias("organization_name"), F.when(F.col("npi") % 4 == 1, "other").otherwise("Same ").alias("last_name"))
    record = F.to_json(F.struct(
        basic.alias("basic"), many(F.col("npi") % 5, F.struct(F.lit("").alias("organization_name"), F.lit("x").alias("first_name"))).alias("other_names"),
        F.concat(many(F.col("npi") % 6, F.struct(F.lit("Location").alias("address_purpose"))), F.array(F.struct(F.lit("MAILING").alias("address_purpose")))).alias("addresses"),
        F.array(F.struct(F.col("c_mktsegment").alias("desc"))).alias("taxonomies")))
    return textmine.registry_checks(c.select("npi", record.alias("record"), F.lit("A").alias("first_name"), F.lit("SAME").alias("last_name"), F.col("c_name").alias("organization")), "2024-06-30")


@query("""WITH p AS (SELECT o_orderpriority AS specialty, o_orderstatus AS state, o_totalprice AS v FROM orders)
SELECT specialty, state, count(*) AS peers, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.99), 4) AS p99 FROM p GROUP BY 1, 2 HAVING count(*) >= 5""")
def benchmarks_of_hot_groups(spark, d):
    """Benchmarks whose groups of more than a hundred are selected by counted ranges."""
    o = fixtures.table(spark, d, "orders").select(F.col("o_orderpriority").alias("specialty"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("total_payment"))
    out = detectors.provider_benchmarks(o, hot=100)
    return out.select("specialty", "state", "peers", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")))
