"""Behaviour of single operators on small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from ledgerwise.functions import columns as C
from ledgerwise.operators import detectors, features, graph, models, peers, scoring, serving, textmine
from ledgerwise.sources import readers, writers


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(values[n], float) or values[n] is None else 'string' if isinstance(values[n], str) else 'long'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_safe_divide_and_clip(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 0.0), (5.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_divide("a", "b")).collect()] == [0, 0, 2.5, 0]
    got = [r[0] for r in spark.createDataFrame([(-3.0,), (3.0,), (math.nan,), (None,)], "a double").select(C.clip("a", -1, 2)).collect()]
    assert got == [-1, 2, None, None]


def test_z_score_of_equal_values_is_0(spark):
    df = spark.createDataFrame([(5.0, "A"), (5.0, "A"), (5.0, "A"), (10.0, "B")], "v double, g string")
    assert {r[0] for r in peers.with_z_score(df, "v", ["g"], "z").select("z").collect()} == {0.0}


def test_peer_median_falls_back_to_the_coarse_group(spark):
    rows = [("s", "X", float(i)) for i in range(10)] + [("s", "Y", 100.0)]
    rows += [(None, None, 3.0), (None, "X", 5.0)]
    df = peers.with_peer_medians(spark.createDataFrame(rows, "specialty string, state string, v double"), {"m": "v"}, ["specialty", "state"], ["specialty"])
    assert {(r.specialty, r.state, r.m) for r in df.collect()} == {("s", "X", 4.5), ("s", "Y", 5.0), (None, None, 4.0), (None, "X", 4.0)}


@pytest.mark.parametrize("street,key", [("123 North Main Street, Suite 4B", "123 n main st|la|CA|90001"), ("5 Oak Ave #12", "5 oak ave|la|CA|90001"), ("77 Norwood Road", "77 norwood rd|la|CA|90001"), ("1", None)])
def test_address_key(spark, street, key):
    assert one(spark, C.address_key("s", F.lit("LA "), F.lit("ca"), F.lit("90001-1234")), s=street) == key


def test_small_functions(spark):
    assert one(spark, C.zero_filled("a"), a="123") == "0000000123"
    assert one(spark, C.zero_filled("a"), a="12345678901") == "12345678901"
    assert [one(spark, C.money("a"), a=v) for v in (1_250_000.0, 3400.0, 950.0)] == ["$1.25M", "$3.4K", "$950"]
    assert one(spark, C.display_name(F.lit(" Ann "), F.lit(None).cast("string"), "a"), a=7) == "Ann"
    assert one(spark, C.display_name(F.lit(""), F.lit(" "), "a"), a=7) == "7"
    assert one(spark, C.canonical("a", {"im": "internal medicine"}), a=" IM ") == "internal medicine"
    assert one(spark, C.canonical("a", {}), a="  ") == "unknown"


BUCKETS, NEGATIONS = [("critical", ["revoked"]), ("adverse", ["probation"])], ["not", "no record of", "never been"]


@pytest.mark.parametrize("text,severity", [("License REVOKED in 2019", "critical"), ("license has not revoked", "info"), ("not revoked. later revoked", "critical"), ("never been revoked but on probation", "adverse"), (None, "info"), ("not within the last twenty years revoked", "critical")])
def test_keyword_severity(spark, text, severity):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.keyword_severity("t", BUCKETS, NEGATIONS)).first()[0] == severity


def test_features_are_finite_and_leave_exclusion_out(spark):
    rows = [(i, "im", "CA", 50_000.0 + 1000 * i, 200.0 + i, 50 + i, 1 + i % 20, i < 5) for i in range(30)]
    p = features.peer_features(spark.createDataFrame(rows, "npi long, specialty string, state string, total_payment double, total_services double, total_beneficiaries long, procedure_types int, excluded boolean"))
    p = features.enrich(p.withColumns({"billing_entropy": F.lit(1.0), "level5_ratio": F.lit(0.0), "yoy_payment_change": F.lit(0.0)}), None)
    assert "excluded" not in features.MODEL_COLUMNS and len(set(features.MODEL_COLUMNS)) == len(features.MODEL_COLUMNS)
    for r in p.select(*features.MODEL_COLUMNS).collect():
        assert all(math.isfinite(v) for v in r)


def test_registry_enrichment(spark):
    base = spark.createDataFrame([(1, "CA", 6.0), (2, "CA", 1.0), (3, "TX", 9.0)], "npi long, state string, payment_vs_peer double")
    registry = spark.createDataFrame([(1, "01/01/2018", "Y"), (2, "bad", "X")], "npi long, enumeration_date string, is_sole_proprietor string")
    got = {r.npi: r for r in features.enrich(base, registry, hotspots=["TX"]).collect()}
    assert abs(got[1].months_since_enumeration - 60) < 1 and got[1].is_sole_proprietor == 1
    assert got[2].months_since_enumeration == 0 and got[2].new_provider_high_volume == 0
    assert abs(got[3].months_since_enumeration - got[1].months_since_enumeration / 2) < 1e-9 and got[3].hotspot_state == 1


def test_volume_discount(spark):
    df = spark.createDataFrame([("lab", 1.1, False, 75.0), ("lab", 0.5, True, 60.0), ("cardiology", 0.1, False, 70.0), ("lab", 20.0, False, 80.0)], "s string, p double, x boolean, v double")
    got = [r[0] for r in df.select(scoring.volume_discount(F.col("v"), F.col("s"), F.col("p"), F.col("x"), ["lab"])).collect()]
    assert got == [75 * 0.15, 60, 70, 80]


def test_stretch_keeps_order_and_small_tables(spark):
    df = spark.range(200).select(F.col("id").alias("npi"), (F.col("id") / 400).alias("s"))
    got = [r.stretched for r in scoring.top_tail_stretch(df, "s", "npi").orderBy("npi").collect()]
    assert got == sorted(got) and got[-1] == pytest.approx(1.0) and got[100] == 0.25
    small = scoring.top_tail_stretch(df.limit(50), "s", "npi").collect()
    assert all(r.stretched == r.s for r in small)
    assert scoring.top_tail_stretch(df.limit(0), "s", "npi").count() == 0


def test_labels(spark):
    panel = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 0.0) for i in range(10)], "npi long, ppb_vs_peer double, level5_ratio double, billing_entropy double, payment_vs_peer double")
    split = scoring.temporal_split(spark.createDataFrame([(3, "20200101"), (7, "20240101"), (8, "bad")], "npi long, excldate string"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "npi long")
    got = {r.npi: (r.label, r.kind, r.weight) for r in scoring.labelled(panel, split, ids(3, 5, 8), ids(8)).collect()}
    assert len(got) == 9 and 7 not in got
    assert got[3] == (1, "investigator", 7.0) and got[5] == (1, "investigator", 7.0) and got[8] == (0, "cleared", 3.0) and got[0] == (0, "none", 1.0)


def test_roc_and_precision_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.5, 1), (0.2, 0)], "score double, label int")
    assert scoring.roc_auc(df).first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert scoring.average_precision(df).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert scoring.roc_auc(df.limit(0)).first()[0] is None


def test_row_flags(spark):
    cols = "npi long, excluded boolean, specialty string, is_opt_out double, total_payment double, months_enrolled double, payment_vs_peer double, services_vs_peer double, benes_vs_peer double, payment_zscore double, payment_per_bene double, ppb_vs_peer double, services_per_bene double, level5_ratio double"
    rows = [(1, True, "x", 0.0, 9.0, 12.0, 9.0, 9.0, 9.0, 9.0, 900.0, 9.0, 99.0, 1.0), (2, False, "x", 0.0, 9.0, 12.0, 6.0, 3.5, 1.0, 9.0, 900.0, 9.0, 1.0, 0.9), (3, False, "x", 0.0, 9.0, 12.0, 1.0, 1.0, 1.0, 3.0, 100.0, 9.0, 1.0, 0.0), (4, False, "x", 1.0, 9.0, 5.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0)]
    got = {r.npi: [(f.type, f.severity) for f in r.flags] for r in detectors.row_flags(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == [("leie_exclusion", "critical")]
    assert got[2] == [("billing_volume", "critical"), ("cost_per_patient", "critical"), ("em_upcoding", "critical")]
    assert got[3] == [("statistical_outlier", "high")]
    assert got[4] == [("opt_out_billing", "critical"), ("new_provider_spike", "high"), ("billing_volume", "high")]


@pytest.mark.parametrize("args,low,high", [((0, 0.0, 0.0, 0.0, 0), 0, 0), ((100, 100.0, 100.0, 1.0, 2), 100, 100), ((3, 35.0, 25.0, 0.33, 0), 0, 50), ((8, 88.0, 75.0, 1.0, 0), 70, 100)])
def test_cluster_score_bounds(spark, args, low, high):
    n, top, mean, same, excluded = map(F.lit, args)
    assert low <= spark.range(1).select(graph.cluster_score(n, top, mean, same, excluded)).first()[0] <= high


def test_ego_network(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 9), (1, 3, 1)], "source long, target long, shared long")
    assert {(r.source, r.target, r.hop) for r in graph.ego_network(edges, 1).collect()} == {(1, 2, 1), (1, 3, 1), (2, 3, 0)}
    assert {(r.source, r.target, r.hop) for r in graph.ego_network(edges, 1, 2).collect()} == {(1, 2, 1), (1, 3, 1), (2, 3, 2), (3, 4, 2)}


def test_sampled_edges(spark):
    """Partners come from the whole state by risk, 3 to 8 of them; pairs are there once; exempt ends aren't suspicious."""
    n = 2000
    rows = [(i, "AA", "Radiology " if i % 10 == 0 else "Oncology", 100.0 if i < 20 else float(i % 30)) for i in range(n)]
    rows += [(n + i, "BB", None, [None, 0.0, 90.0][i % 3]) for i in range(7)] + [(n + 10, "CC", "x", 50.0), (n + 11, None, "x", 50.0)]
    people = spark.createDataFrame(rows, "npi long, state string, specialty string, risk_score double")
    got = graph.sampled_edges(people).collect()
    by = {r[0]: r for r in rows}
    pairs = {frozenset((r.source, r.target)) for r in got}
    assert len(pairs) == len(got) and all(len(x) == 2 for x in pairs)
    assert all(by[r.source][1] == by[r.target][1] for r in got)
    risks = sorted(r[3] or 0.0 for r in rows)
    h = 0.8 * (len(risks) - 1)
    cut = risks[int(h)] + (risks[int(h) + 1] - risks[int(h)]) * (h - int(h))
    for r in got:
        assert r.is_suspicious == all((by[x][3] or 0) >= cut and by[x][2] != "Radiology " for x in (r.source, r.target))
    assert any(r.is_suspicious for r in got)
    degree = dict.fromkeys(by, 0)
    for x in pairs:
        for i in x:
            degree[i] += 1
    assert all(degree[i] >= min(int(3 + min(5, (r[3] or 0) / 20)), sum(x[1] == r[1] for x in rows) - 1) for i, r in by.items() if r[1])
    assert degree[n + 10] == degree[n + 11] == 0
    # 20 of 2,000 hold a share of the weight, and each gets that share of all draws: 3 or 4 a provider, 8 of these 20
    weight = {i: (r[3] or 0) + 1 for i, r in by.items() if r[1] == "AA"}
    draws = sum(int(3 + min(5, (by[i][3] or 0) / 20)) for i in weight)
    mean = sum(degree[i] for i in range(20)) / 20 - 8
    assert 0.8 < mean / (draws * 101 / sum(weight.values())) < 1.1
    again = graph.sampled_edges(people.repartition(7)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_exclusion_timing_and_impact(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2020, 1, 1), d(2021, 1, 1), "20190101"), (2, d(2020, 1, 1), d(2021, 1, 1), "20200601"), (3, d(2020, 1, 1), d(2021, 1, 1), "20220101"), (4, d(2020, 1, 1), d(2021, 1, 1), "x")], "npi long, first_bill date, last_bill date, excldate string")
    assert [r.timing for r in detectors.exclusion_timing(df).orderBy("npi").collect()] == ["PREDATES", "DURING", "POSTDATES", None]
    f = spark.createDataFrame([(1, 1000.0, 10, 50.0, 1.0, 1.0), (2, 1000.0, 0, 50.0, 1.0, 1.0), (3, 100.0, 10, None, 80.0, 4.0)], "npi long, total_payment double, total_beneficiaries long, peer_median_ppb double, peer_median_payment double, peer_median_benes double")
    got = {r.npi: (r.expected, r.excess) for r in detectors.financial_impact(f).collect()}
    assert got[1] == (500, 500) and got[2][0] is None and got[3] == (200, 0)


def test_search_and_paging(spark):
    p = spark.createDataFrame([(1, "Ann", "Lab", "CA", 80.0, False, 1.0), (2, "Bob", "Cardiology", "TX", None, False, 1.0), (3, "Anna", "Cardiology", "CA", 85.0, True, 1.0)], "npi long, name string, specialty string, state string, risk_score double, excluded boolean, total_payment double")
    assert [r.npi for r in serving.page(serving.search(p, text="ANN")).collect()] == [3, 1]
    assert [r.npi for r in serving.page(p, descending=False).collect()] == [2, 1, 3]
    assert [r.npi for r in serving.search(p, access=["TX"]).collect()] == [2]
    assert [r.npi for r in serving.search(p, facilities=["lab"], excluded=False).collect()] == [2]
    assert serving.default_state(["CA", "TX"], None) == "CA"
    with pytest.raises(PermissionError):
        serving.default_state(["CA"], "TX")


def test_findings_delta_and_feedback(spark):
    now = spark.createDataFrame([("a", "t ", "u", None, "warning"), ("b", "t", "u", None, "info")], "source string, title string, url string, date string, severity string")
    before = spark.createDataFrame([("a", "t", "u", "")], "source string, title string, url string, date string")
    assert [r.source for r in serving.new_findings(now, before).collect()] == ["b"]
    flags = spark.createDataFrame([(1, 0.5, True), (1, 0.4, False), (2, 0.3, True)], "npi long, confidence double, is_active boolean")
    got = serving.outcome_feedback(flags, spark.createDataFrame([(1, "fraud")], "npi long, outcome string"), ["fraud"]).collect()
    assert sorted((r.npi, r.confidence, r.reviewed) for r in got) == [(1, 0.4, False), (1, 1.0, True), (2, 0.3, False)]


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text(" Rndrng_NPI ,Tot_Srvcs,Tot_Mdcr_Pymt_Amt,Rndrng_Prvdr_Type\n1000000001,\"1,200\",$50.5,Lab\n12,3,4,x\n1000000002,5,-1,x\n1000000003,bad,9,x\n")
    got = readers.provider_file(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.npi, r.total_services, r.total_payment, r.specialty, r.city) for r in got] == [("1000000001", 1200.0, 50.5, "Lab", None)]
    (tmp_path / "l.csv").write_text("NPI,HCPCS_CD,TOT_SRVCS,AVG_MDCR_PYMT_AMT\n1000000001, 99213 ,3,10\n1000000009,1,1,1\n1000000001,x,nan,5\n")
    keys = spark.createDataFrame([("1000000001",)], "npi string")
    assert [(r.hcpcs_code, r.total_payment, r.year) for r in readers.billing_file(spark, str(tmp_path / "l.csv"), 2022, keys).collect()] == [("99213", 30.0, 2022)]
    (tmp_path / "x.csv").write_text("NPI,GENERAL,REINDATE\n1000000001,a,00000000\n3000000001,b,\n0000000000,c,\n1000000002,d,20200101\n")
    assert sorted(r.npi for r in readers.exclusion_file(spark, str(tmp_path / "x.csv")).collect()) == ["1000000001", "3000000001"]
    assert [r.npi for r in readers.exclusion_file(spark, str(tmp_path / "x.csv"), strict=True).collect()] == ["1000000001"]
    (tmp_path / "s.csv").write_text("NPI_1,NPI_2,Pair,Bene,Same\n123,1000000001,5,20,1\n5,5,9,99,1\n6,7,9,3,1\n")
    assert [(r.source, r.target, r.shared) for r in readers.pair_file(spark, str(tmp_path / "s.csv")).collect()] == [("0000000123", "1000000001", 20)]
    with pytest.raises(ValueError, match="no column for npi"):
        readers.provider_file(spark, str(tmp_path / "l.csv").replace("l.csv", "s.csv"))
    assert len(readers.file_digests(spark, str(tmp_path / "s.csv")).first().sha256) == 64
    months = spark.createDataFrame([(datetime.date(2024, m, 1),) for m in (1, 3)], "month date")
    assert readers.latest_snapshot(months, "2024-06-15").first()[0] == datetime.date(2024, 3, 1)


def test_sinks(spark, tmp_path):
    t = lambda rows: spark.createDataFrame(rows, "k long, year int, v string")
    writers.replace_partitions(t([(1, 2020, "a"), (2, 2021, "b")]), str(tmp_path / "t"))
    writers.replace_partitions(t([(3, 2021, "c")]), str(tmp_path / "t"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (3, "c")]
    writers.append_snapshot(t([(1, 1, "a")]), str(tmp_path / "s"))
    writers.append_snapshot(t([(2, 1, "a")]), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert writers.json_report(t([(1, 2, "x")])).first()[0] == '{"k":1,"year":2,"v":"x"}'
    first = writers.insert_ignore(t([(1, 1, "old")]), t([(1, 1, "new"), (2, 1, "b"), (2, 1, "a")]), ["k"], ["v"])
    assert sorted((r.k, r.v) for r in first.collect()) == [(1, "old"), (2, "a")]


def test_public_records(spark):
    r = '{"status":"D","enumeration_date":"2023-06-01","last_name":"Roe","other_names":["x"],"addresses":["a","b","c"]}'
    df = spark.createDataFrame([("1", "Doe", r), ("2", "Roe", '{"status":"A","enumeration_date":"2001-01-01","last_name":"roe"}')], "npi string, expected_name string, record string")
    got = sorted((x.npi, x.finding) for x in textmine.registry_findings(df, "2024-06-01").collect())
    assert got == [("1", "deactivated"), ("1", "name differs"), ("1", "new within 24 months"), ("1", "other names"), ("1", "three or more places"), ("2", "in order")]
    e = '{"exclusions":[{"name":"a","state":"CA","until":"2030-01-01"},{"name":"b","state":"TX","npi":"1"},{"name":"c","state":"TX"},{"name":"d","state":"CA","until":"2001-01-01"}]}'
    out = textmine.debarments(spark.createDataFrame([("1", e)], "npi string, record string"), "2024-01-01", "CA").collect()
    assert sorted((x.name, x.severity) for x in out) == [("a", "critical"), ("b", "critical"), ("d", "warning")]
    assert one(spark, textmine.strip_forms("a"), a="Acme Health, LLC.") == "Acme Health"
    terms = textmine.search_terms(spark.createDataFrame([("Ann Lee", "Lab")], "a string, b string"), ["a", "b"])
    assert textmine.matching(terms, ["lee", "LAB"]).count() == 1 and textmine.matching(terms, ["leo"]).count() == 0


def test_isolation_finds_the_odd_one(spark):
    df = spark.range(300).select(F.col("id").alias("npi"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("a", F.when(F.col("npi") == 17, 500.0).otherwise(F.col("a")))
    got = models.isolation_scores(df, ["a", "b"], trees=40).orderBy(F.desc("isolation_rank")).first()
    assert got.npi == 17 and got.isolation_rank == 1.0
    assert models.reconstruction_errors(df, ["a", "b"], 2).agg(F.max("error")).first()[0] <= 1
    top = models.top_drivers(df, {"a": 1.0, "b": 1.0}).where("npi = 17").first()
    assert top.top[0] == "a" and top["values"]["a"] > 400


def test_robust_scaling(spark):
    df = spark.createDataFrame([(i, float(i), 7.0) for i in range(1, 102)], "npi long, a double, same double")
    got = {r.npi: list(r.features) for r in models.scaled(df, ["a", "same"]).collect()}
    assert got[51] == [0.0, 0.0] and got[101] == [1.0, 0.0] and got[1] == [-1.0, 0.0]
