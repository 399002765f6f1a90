"""Queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..operators.peers import beside
from ..operators.quantiles import MOST_KEYS, percentiles
from ..sources.staging import dealt, dropped, written, written_within
from . import fixtures

QUERIES: dict = {}
ORACLE: dict = {}

LINES = """lines AS (SELECT o_custkey AS npi, l_orderkey AS bene, year(o_orderdate) AS year, p_brand AS code, p_type AS kind, l_quantity AS services,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS payment, CAST(l_extendedprice AS DECIMAL(18,2)) AS charge
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
PEOPLE = """people AS (SELECT c_custkey AS npi, c_name AS name, c_mktsegment AS specialty, coalesce(n_name, 'UNK') AS state, c_acctbal < 0 AS excluded, c_acctbal AS balance
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
PROV = f"""{LINES}, {PEOPLE}, prov AS (SELECT people.*, total_payment, total_services, total_beneficiaries, procedure_types FROM people JOIN (
  SELECT npi, CAST(sum(payment) AS DOUBLE) AS total_payment, sum(services) AS total_services, count(DISTINCT bene) AS total_beneficiaries, count(DISTINCT code) AS procedure_types FROM lines GROUP BY npi) USING (npi))"""
SCORED = f"""{PROV}, scored AS (SELECT *, total_payment / med AS pv, (total_payment / total_beneficiaries) / med_ppb AS ppb_vs_peer,
  round(least(100.0, 45.0 * (total_payment / med) + (npi * 37) % 11), 2) AS risk_score, state || ' ' || CAST(npi % 7 AS VARCHAR) AS address
  FROM (SELECT *, median(total_payment) OVER (PARTITION BY specialty) AS med, median(total_payment / total_beneficiaries) OVER (PARTITION BY specialty) AS med_ppb FROM prov))"""
TIER = "CASE WHEN risk_score >= 90 THEN 1 WHEN risk_score >= 70 THEN 2 WHEN risk_score >= 50 THEN 3 ELSE 4 END"
FLAGS = f"""{SCORED}, flags AS (SELECT npi, 'billing_volume' AS flag_type, CASE WHEN pv >= 1.5 THEN 1 ELSE 2 END AS severity, total_payment - med AS overpayment, npi % 5 <> 0 AS is_active FROM scored WHERE pv >= 1.2
  UNION ALL SELECT npi, 'cost_per_patient', 3, 0.0, TRUE FROM scored WHERE ppb_vs_peer >= 1.2)"""
EDGES = """pairs AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), edges AS (SELECT a.s AS source, b.s AS target, count(*) AS shared FROM pairs a JOIN pairs b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2)"""
TOTALS = f"""{LINES}, {PEOPLE}, totals AS (SELECT npi, specialty, year, CAST(sum(payment) AS DOUBLE) AS payment FROM lines JOIN people USING (npi) GROUP BY 1, 2, 3)"""
ALERTS = "alerts AS (SELECT event_id AS flag_id, user_id AS npi, event_type AS flag_type, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS severity, ts AS created_at, value FROM events)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Where the scored providers of a session and a folder are; queries share them.
_WRITTEN: dict[tuple[str, str], tuple] = {}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Providers with a deterministic proxy score, written once for all queries of a session, in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        with written_within() as made:
            p = base = written(fixtures.providers(spark, d).withColumn("_ppb", F.col("total_payment") / F.col("total_beneficiaries")), "providers")
            for name, value in {"med": "total_payment", "med_ppb": "_ppb"}.items():  # a specialty's providers are more than one buffer holds
                medians = written(percentiles(base, ["specialty"], value, [0.5]).select("specialty", F.get("p", F.lit(0)).alias(name)), "medians")
                # dealt by specialty, a task would have all providers of one
                p = beside(p, F.broadcast(medians) if medians.count() <= MOST_KEYS else medians, ["specialty"])
        p = p.drop("_ppb")
        p = p.withColumns({"pv": F.col("total_payment") / F.col("med"), "ppb_vs_peer": F.col("total_payment") / F.col("total_beneficiaries") / F.col("med_ppb")})
        risk = F.round(F.least(F.lit(100.0), 45.0 * F.col("pv") + (F.col("npi") * 37) % 11), 2)
        out = written(p.withColumns({"risk_score": risk, "address": F.concat("state", F.lit(" "), (F.col("npi") % 7).cast("string"))}), "scored")
        dropped(*made)
        _WRITTEN[key] = (out.schema, out.written_to)
    schema, path = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def scored_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """scored, dealt by provider, for joins and groups of its rows by npi."""
    p = scored(spark, d)
    return dealt(p, p.count(), "npi")


def flags(p: DataFrame) -> DataFrame:
    """Both kinds of flags in one pass over the providers."""
    flag = lambda kind, severity, over, active: F.struct(F.lit(kind).alias("flag_type"), severity.alias("severity"), over.alias("overpayment"), active.alias("is_active"))
    volume = flag("billing_volume", F.when(F.col("pv") >= 1.5, 1).otherwise(2), F.col("total_payment") - F.col("med"), F.col("npi") % 5 != 0)
    cost = flag("cost_per_patient", F.lit(3), F.lit(0.0), F.lit(True))
    every = F.filter(F.array(F.when(F.col("pv") >= 1.2, volume), F.when(F.col("ppb_vs_peer") >= 1.2, cost)), lambda x: x.isNotNull())
    return p.select("npi", F.explode(every).alias("f")).select("npi", "f.*")


def totals(spark: SparkSession, d: str) -> DataFrame:
    per = fixtures.lines(spark, d).groupBy("npi", "year").agg(F.sum("payment").cast("double").alias("payment"))
    return per.join(fixtures.people(spark, d).select("npi", "specialty"), "npi")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, score, label): a score from the text's length against labels.quality."""
    docs = fixtures.table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(fixtures.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select("doc_id", (F.col("n_chars") % 101).cast("double").alias("score"), "label")


LABELS = "marks AS (SELECT doc_id, CAST(n_chars % 101 AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"

__all__ = ["ALERTS", "EDGES", "FLAGS", "LABELS", "LINES", "ORACLE", "PEOPLE", "PROV", "QUERIES", "SCORED", "TIER", "TOTALS", "fixtures", "flags", "labels", "query", "safe_divide", "scored", "scored_by_provider", "totals"]
