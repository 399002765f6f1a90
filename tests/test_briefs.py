"""Briefs and digests."""

import datetime

from pyspark.sql import functions as F

from ledgerwise.operators import briefs

FINDING = "array<struct<source:string, title:string, url:string, date:string, severity:string>>"


def test_brief_parts(spark):
    df = spark.createDataFrame([(1, "Ann", "Lab", "CA", True, 4.0, 3.0, 300_000.0, 3, 2, 1, 1, 900_000.0), (2, "Bob", "GP", "TX", False, 1.0, 1.0, 0.0, 1, 0, 4, 0, 10.0)], "npi long, name string, specialty string, state string, excluded boolean, payment_vs_peer double, ppb_vs_peer double, excess double, cluster_size int, flag_types int, priority int, suspicious_edges int, total_payment double")
    found = {r.npi: [f.label for f in r.findings] for r in briefs.key_findings(df).collect()}
    assert len(found[1]) == 6 and found[2] == []
    steps = briefs.action_plan(df).collect()
    assert [r.n for r in steps if r.npi == 1] == [1, 2, 3, 4, 5, 6] and [r.action for r in steps if r.npi == 2] == ["compare with the next data year"]
    told = {r.npi: r.narrative for r in briefs.narrative(df).collect()}
    assert told[1] == "Ann (Lab, CA) was paid $900.0K. $300.0K lie above what peers would have been paid. The provider is on the exclusion list."
    assert told[2] == "Bob (GP, TX) was paid $10."
    assert [r[0] for r in df.select(briefs.facility_kind(F.col("specialty"), {"lab": ["LAB"]})).collect()] == ["lab", None]
    assert briefs.citations(df, "claims", 2022).first().citation == "claims, 2022, provider 1"


def test_dockets(spark):
    rows = [("1", '{"results":[{"caseName":"A v. B","dateFiled":"2020-01-01"},{"caseName":"United States v. C","dateFiled":"2019-01-01"},{"caseName":"State of X v. D","dateFiled":"2021-01-01"}]}'), ("2", None)]
    got = briefs.dockets(spark.createDataFrame(rows, "npi string, results string"), 2).orderBy("n").collect()
    assert [(r.title, r.severity) for r in got] == [("United States v. C", "critical"), ("State of X v. D", "adverse")]


def test_digest(spark):
    t = datetime.datetime
    one, two = ("s", "t", "u", "d", "warning"), ("s", "t2", "u", "d", "critical")
    runs = spark.createDataFrame([(1, t(2024, 1, 1), [one]), (1, t(2024, 1, 14), [one, two]), (2, t(2024, 1, 1), [one]), (2, t(2024, 1, 14), [one]), (3, t(2024, 1, 14), [two])], f"npi long, started timestamp, findings {FINDING}")
    cases = spark.createDataFrame([(1, "me", "open"), (2, "me", "open"), (3, "you", "open")], "npi long, assigned_to string, status string")
    got = briefs.digest(cases, runs, "me", F.lit("2024-01-10").cast("timestamp")).collect()
    assert [(r.npi, r.new_findings, r.worst) for r in got] == [(1, 1, 5)]
