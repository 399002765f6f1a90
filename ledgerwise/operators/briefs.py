"""Investigation briefs for all providers at once: line notes, findings, actions, narrative, and case digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money
from ..sources.staging import dealt, written
from .serving import latest, new_findings, severity_rank


def facility_kind(specialty: Column, kinds: dict[str, list[str]]) -> Column:
    """lab, imaging or another kind of facility; null for physicians. Compared without regard to case."""
    out = F.lit(None).cast("string")
    for kind, names in kinds.items():
        out = F.when(F.lower(specialty).isin([n.lower() for n in names]), kind).otherwise(out)
    return out


def annotated_lines(lines: DataFrame, level5: list[str], top: int = 12) -> DataFrame:
    """lines(npi, code, services, beneficiaries, payment) -> each provider's largest lines with a note."""
    per = F.try_divide(F.col("services"), F.col("beneficiaries"))
    drug = F.upper(F.substring("code", 1, 1)) == "J"
    note = (
        F.when(drug & (per > 200), "drug units far above need").when(drug & (per > 50), "many drug units").when(F.col("code").isin(level5), "highest visit level")
        .when(per > 100, "many services per beneficiary").otherwise("usual")
    )
    first = F.row_number().over(Window.partitionBy("npi").orderBy(F.desc_nulls_last("payment"), "code"))
    return lines.withColumns({"per_beneficiary": per, "note": note, "n": first}).where(F.col("n") <= top)


def key_findings(df: DataFrame) -> DataFrame:
    """(npi, findings): labelled values, only those that hold."""
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    every = F.array(
        F.when(F.col("excluded"), pair("exclusion", F.lit("on the list"))),
        F.when(F.col("payment_vs_peer") >= 3, pair("payment against peers", F.format_string("%.1fx", "payment_vs_peer"))),
        F.when(F.col("ppb_vs_peer") >= 2.5, pair("payment per beneficiary", F.format_string("%.1fx", "ppb_vs_peer"))),
        F.when(F.col("excess") > 0, pair("excess", money("excess"))),
        F.when(F.col("cluster_size") >= 3, pair("shared address", F.concat(F.col("cluster_size").cast("string"), F.lit(" providers")))),
        F.when(F.col("flag_types") > 0, pair("kinds of flags", F.col("flag_types").cast("string"))),
    )
    return df.select("npi", F.filter(every, lambda x: x.isNotNull()).alias("findings"))


def measures(df: DataFrame, z: float = 2, ratio: float = 1.5, entropy: tuple[float, float] = (1.5, 3.5), coding: float = 0.4, intensity: float = 30) -> DataFrame:
    """(npi, measures): eight labelled measures with their reading, those that stand out; nulls don't."""
    one = lambda when, label, reading: F.when(when, F.struct(F.lit(label).alias("label"), reading.alias("reading")))
    score, mixed = F.col("risk_score"), F.col("entropy")
    every = F.array(
        one(score > 0, "risk score", F.when(score >= 95, "top <1%").when(score >= 90, "top 1%").otherwise("top 5%")),
        one(F.col("payment_zscore") > z, "payment z-score", F.format_string("%.1f", "payment_zscore")),
        one(F.col("payment_vs_peer") > ratio, "payment against peers", F.format_string("%.1fx", "payment_vs_peer")),
        one(F.col("total_payment") > 0, "total paid", money("total_payment")),
        one(((mixed > 0) & (mixed < entropy[0])) | (mixed > entropy[1]), "billing entropy", F.when(mixed < entropy[0], "few codes").otherwise("very many codes")),
        one(F.col("level5_ratio") > coding, "highest-level visits", F.format_string("%.0f%%", F.col("level5_ratio") * 100)),
        one(F.col("excluded"), "exclusion", F.lit("on the list")),
        one(F.col("services_per_bene") > intensity, "services per beneficiary", F.when(F.col("is_facility"), "usual for a facility").otherwise("unusual for an office")))
    return df.select("npi", F.filter(every, lambda x: x.isNotNull()).alias("measures"))


def action_plan(df: DataFrame) -> DataFrame:
    """(npi, n, action): steps in order, numbered from 1."""
    every = F.array(
        F.when(F.col("excluded"), "stop payments and verify the exclusion"), F.when(F.col("priority") <= 2, "open a case"), F.when(F.col("excess") >= 250_000, "request records"),
        F.when(F.col("cluster_size") >= 3, "visit the address"), F.when(F.col("suspicious_edges") > 0, "review the referral network"), F.lit("compare with the next data year"))
    steps = df.select("npi", F.posexplode(F.filter(every, lambda x: x.isNotNull())).alias("n", "action"))
    return steps.withColumn("n", F.col("n") + 1)


def narrative(df: DataFrame) -> DataFrame:
    text = F.concat_ws(
        " ", F.concat(F.col("name"), F.lit(" ("), F.col("specialty"), F.lit(", "), F.col("state"), F.lit(") was paid "), money("total_payment"), F.lit(".")),
        F.when(F.col("excess") > 0, F.concat(money("excess"), F.lit(" lie above what peers would have been paid."))),
        F.when(F.col("excluded"), F.lit("The provider is on the exclusion list.")))
    return df.select("npi", text.alias("narrative"))


def citations(df: DataFrame, source: str, year: int) -> DataFrame:
    return df.select("npi", F.format_string("%s, %d, provider %s", F.lit(source), F.lit(year), F.col("npi").cast("string")).alias("citation"))


def top_neighbours(edges: DataFrame, most: int = 20) -> DataFrame:
    """(npi, other, shared): each provider's neighbours by their best edge."""
    edges = written(edges.select("source", "target", "shared"), "edges")
    both = edges.select(F.col("source").alias("npi"), F.col("target").alias("other"), "shared").unionByName(edges.select(F.col("target").alias("npi"), F.col("source").alias("other"), "shared"))
    # not by provider alone: the tasks drop what isn't among a hub's best before it is gathered
    best = dealt(both, 2 * edges.count(), "npi", "other").groupBy("npi", "other").agg(F.max("shared").alias("shared"))
    n = F.row_number().over(Window.partitionBy("npi").orderBy(F.desc("shared"), "other"))
    return best.withColumn("n", n).where(F.col("n") <= most).drop("n")


def dockets(texts: DataFrame, most: int = 10) -> DataFrame:
    """(npi, results JSON) -> court dockets by severity, then by date, the latest first."""
    schema = "struct<results:array<struct<caseName:string, dateFiled:string, court:string>>>"
    each = texts.select("npi", F.explode(F.from_json("results", schema)["results"]).alias("r")).select("npi", F.col("r.caseName").alias("title"), F.col("r.dateFiled").alias("date"), F.col("r.court").alias("court"))
    name = F.lower("title")
    severity = F.when(F.contains(name, F.lit("united states v")) | F.contains(name, F.lit("qui tam")), "critical").when(F.contains(name, F.lit("state of")), "adverse").otherwise("warning")
    out = each.withColumn("severity", severity)
    n = F.row_number().over(Window.partitionBy("npi").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc_nulls_last("date"), "title"))
    return out.withColumn("n", n).where(F.col("n") <= most)


def digest(cases: DataFrame, runs: DataFrame, user: str, since, days: int = 30) -> DataFrame:
    """A user's open cases with findings in their latest run that the run before, at most `days` older, didn't have.

    runs(npi, started, findings array<struct<source, title, url, date, severity>>).
    """
    own = cases.where((F.col("assigned_to") == user) & (F.col("status") == "open")).select("npi").distinct()
    mine = runs.join(own, "npi", "left_semi")
    now = latest(mine, ["npi"], [F.desc("started")]).where(F.col("started") >= since)
    old = mine.alias("o").join(now.select("npi", F.col("started").alias("at")), "npi").where((F.col("started") < F.col("at")) & (F.col("started") >= F.col("at") - F.make_dt_interval(F.lit(days))))
    old = latest(old.drop("at"), ["npi"], [F.desc("started")])
    rows = lambda df: df.select("npi", F.explode("findings").alias("f")).select("npi", "f.*").withColumn("source", F.concat_ws("\u0001", F.col("npi").cast("string"), "source"))
    fresh = new_findings(rows(now), rows(old))
    return fresh.groupBy("npi").agg(F.count("*").alias("new_findings"), F.max(severity_rank(F.col("severity"))).alias("worst")).orderBy(F.desc("worst"), "npi")
