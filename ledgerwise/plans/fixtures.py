"""The driver's tables as billing data: lines, providers, exclusions, edges, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.staging import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(npi, bene, year, code, kind, services, payment, charge): a row for each billed line; money is exact."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("npi"), F.year("o_orderdate").alias("year"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"), F.col("p_type").alias("kind"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("services"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("payment"), F.col("l_extendedprice").cast("decimal(18,2)").alias("charge"))
    n = items.count()
    items, orders = dealt(items, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    out = items.join(orders, items.l_orderkey == orders.o_orderkey)
    if parts.count() <= staging.TASK_ROWS:  # a task holds them all
        parts = F.broadcast(parts)
    else:
        out, parts = dealt(out, n, "l_partkey"), dealt(parts, n, "p_partkey")
    out = out.join(parts, out.l_partkey == parts.p_partkey)
    return out.select("npi", F.col("l_orderkey").alias("bene"), "year", "code", "kind", "services", "payment", "charge")


def lines_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines, a provider's in one task, for groups by npi and others."""
    return dealt(lines(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "npi")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(npi, name, specialty, state, excluded): the dimension."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    c = table(spark, sf_dir, "customer")
    return c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("npi"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("specialty"), F.coalesce("state", F.lit("UNK")).alias("state"), (F.col("c_acctbal") < 0).alias("excluded"), F.col("c_acctbal").alias("balance"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """people with total_payment, total_services, total_beneficiaries, procedure_types."""
    # a line counts once for its beneficiary and once for its code, all in the provider's own task; distinct counts would deal them anew
    none = lambda kind: F.lit(None).cast(kind)
    all_lines = lines_by_provider(spark, sf_dir).select("npi", "bene", "code", "payment", "services")
    kinds = dict(all_lines.dtypes)
    of_bene = F.struct("bene", none(kinds["code"]).alias("code"), "payment", "services")
    of_code = F.struct(none(kinds["bene"]).alias("bene"), "code", none(kinds["payment"]).alias("payment"), none(kinds["services"]).alias("services"))
    each = all_lines.select("npi", F.inline(F.array(of_bene, of_code))).groupBy("npi", "bene", "code").agg(F.sum("payment").alias("payment"), F.sum("services").alias("services"))
    totals = each.groupBy("npi").agg(
        F.sum("payment").cast("double").alias("total_payment"), F.sum("services").alias("total_services"),
        F.count("bene").alias("total_beneficiaries"), F.count("code").alias("procedure_types"))
    return people(spark, sf_dir).join(totals, "npi")


def edges(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """(source, target, shared): suppliers whose parts were ordered together, source < target.

    by: what deals large tables to tasks; ("source",) has all edges of a source in one, for what groups by it next.
    """
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))
    n = items.count()
    pairs = dealt(items, n, "k").distinct()
    a, b = pairs.withColumnRenamed("s", "source"), pairs.withColumnRenamed("s", "target")
    # an order of four lines has six pairs
    return dealt(a.join(b, "k").where("source < target").drop("k"), 2 * n, *by).groupBy("source", "target").agg(F.count("*").alias("shared"))


def alerts(events: DataFrame) -> DataFrame:
    """events -> (flag_id, npi, flag_type, severity, created_at, value); severity from the type's first letter."""
    return events.select(
        F.col("event_id").alias("flag_id"), F.col("user_id").alias("npi"), F.col("event_type").alias("flag_type"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3).alias("severity"), F.col("ts").cast("timestamp").alias("created_at"), "value")
