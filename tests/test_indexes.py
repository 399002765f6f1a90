"""Bucketed tables, search indexes, snapshots, hot groups, networks of many providers, zip archives."""

import random
import zipfile
from functools import partial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.catalogue import QUERIES
from ledgerwise.functions.english import stem
from ledgerwise.operators import briefs, graph, quantiles, search_index, snapshot
from ledgerwise.plans import fixtures, index_queries, registry
from ledgerwise.sources import staging, zips
from ledgerwise.sources.buckets import Buckets


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def files_read(df):
    """Runs df and gives the number of files that its scans read, by Spark's own count."""
    df.collect()
    waiting, n = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        plan = waiting.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(plan.plan())
        elif name == "FileSourceScanExec":
            n += plan.metrics().apply("numFiles").value()
        else:
            children = plan.children()
            waiting += [children.apply(i) for i in range(children.size())]
    return n


def test_stems():
    pairs = """consigned:consign consistency:consist consistently:consist knackeries:knackeri knavish:knavish generously:generous communism:communism cries:cri ties:tie
    running:run hopping:hop hoping:hope national:nation relational:relat university:univers skies:sky dying:die innings:inning proceeded:proceed fluently:fluentli happy:happi
    by:by say:say cry:cri gas:gas this:this gaps:gap kiwis:kiwi agreed:agre feed:feed luxuriated:luxuri falling:fall filing:file bled:bled sized:size rate:rate controlling:control
    conditional:condit rational:ration digitizer:digit vietnamization:vietnam operator:oper feudalism:feudal hopefulness:hope callousness:callous formative:format electrical:electr
    goodness:good revival:reviv allowance:allow inference:infer adjustable:adjust irritant:irrit replacement:replac adoption:adopt homologous:homolog angularity:angular effective:effect
    roll:roll probate:probat cease:ceas yes:yes youth:youth boy:boy machinery:machineri household:household automobile:automobil dog's:dog 0012:0012 été:été""".split()
    assert {w: stem(w) for w, _ in (p.split(":") for p in pairs)} == dict(p.split(":") for p in pairs)


def test_upsert_rewrites_only_changed_buckets(spark, tmp_path):
    table = Buckets(f"file://{tmp_path}/t", ("k",), 16)
    rows = {k: (f"v{k}", k * 1.5) for k in range(500)}
    table.create(spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, a string, b double"))
    before = files(f"{tmp_path}/t")
    new = {3: ("x", None), 4: (None, 1.0), 1000: ("n", 2.0)}
    numbers = table.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], "k long, a string, b double"))
    rows |= new
    read = lambda: {r["k"]: (r["a"], r["b"]) for r in table.table(spark).collect()}
    assert read() == rows and table.table(spark).count() == len(rows)
    after = files(f"{tmp_path}/t")
    assert 1 <= len(numbers) <= 3
    same = {p for p in before if int(p.parent.name.split("=")[1]) not in numbers}
    assert same and all(after[p] == before[p] for p in same)
    assert all(p not in after for p in set(before) - same)
    table.update(spark.createDataFrame([(5, None, 9.0), (7, "y", None), (-1, "z", 0.0)], "k long, a string, b double"), ["a", "b"])
    rows |= {5: ("v5", 9.0), 7: ("y", 10.5)}
    assert read() == rows
    table.delete(table.table(spark).where("k >= 10").select("k"))
    assert read() == {k: v for k, v in rows.items() if k < 10}
    assert table.upsert(table.table(spark).limit(0)) == [] and len(read()) == 10
    with pytest.raises(ValueError, match="16 buckets"):
        Buckets(table.path, ("k",), 8).table(spark)
    found = table.lookup(spark.createDataFrame([(3,), (99,)], "k long"))
    assert [r["k"] for r in found.collect()] == [3] and files_read(found) <= 2 < len(files(f"{tmp_path}/t"))


def test_keys_of_several_columns_and_empty_tables(spark, tmp_path):
    table = Buckets(f"file://{tmp_path}/t", ("a", "b"), 4)
    table.create(spark.createDataFrame([], "a string, b int, v int"))
    assert table.table(spark).count() == 0
    table.upsert(spark.createDataFrame([("x", 1, 1), ("x", 2, 2)], "a string, b int, v int"))
    table.upsert(spark.createDataFrame([("x", 2, 3)], "a string, b int, v int"))
    assert sorted(map(tuple, table.table(spark).collect())) == [("x", 1, 1), ("x", 2, 3)]


def people(spark, n=400, seed=1):
    rng = random.Random(seed)
    first, kinds = ["Anna", "Joanne", "Ann Marie", "Émile", "O'Neil", "Li", None, "Running"], ["Internal Medicine", "Cardiology", "Nursing Homes", None]
    rows = [(i, rng.choice(first), f"Smith{rng.randrange(60)}", rng.choice(kinds), rng.choice(["NY", "CA", None])) for i in range(n)]
    return spark.createDataFrame(rows, "npi long, first string, last string, specialty string, state string")


def test_text_index_follows_changes(spark, tmp_path):
    fields = {"first": "A", "last": "A", "specialty": "D", "state": "D"}
    index = search_index.text_index(spark, f"file://{tmp_path}/i", 16)
    rows = people(spark)
    index.create(search_index.postings(rows, "npi", fields))

    def expected(rows, text):
        wanted = set(search_index.query_terms(text))
        out = set()
        for r in rows.collect():
            words = [w for c in fields for w in search_index.query_terms(r[c] or "")]
            if wanted <= set(words):
                out.add(r["npi"])
        return out

    ids = lambda text: {r["id"] for r in search_index.text_search(index, spark, text).collect()}
    for text in ("nurse homes in NY", "nursing home", "ann", "run", "émile", "medicine CA internal", "nobody"):
        assert ids(text) == expected(rows, text), text
    assert ids("nursing") and ids("nursing") == ids("Nursing the homes")
    assert ids("the of and") == set()
    some = search_index._asked(index, spark, "term", ["nurs"])
    assert 0 < files_read(some) <= 8 < len(files(f"{tmp_path}/i"))
    ranks = {r["id"]: r["rank"] for r in search_index.text_search(index, spark, "run", every=False).collect()}
    assert ranks and all(abs(r - 1 / 1.64493406685) < 1e-9 for r in ranks.values())
    was = rows.where("npi < 40")
    now = was.where("npi >= 10").withColumn("specialty", F.lit("Podiatry"))
    before = files(f"{tmp_path}/i")
    numbers = search_index.refresh_text(index, was, now, "npi", fields)
    kept = {p for p in before if int(p.parent.name.split("=")[1]) not in numbers}
    assert kept and kept <= set(files(f"{tmp_path}/i"))
    after = rows.where("npi >= 40").unionByName(now)
    for text in ("podiatry", "nursing home", "NY"):
        assert ids(text) == expected(after, text), text


def test_grams_narrow_what_is_read(spark, tmp_path):
    columns = ["first", "last", "specialty"]
    rows = people(spark, 600)
    table, index = Buckets(f"file://{tmp_path}/p", ("npi",), 64), search_index.gram_index(spark, f"file://{tmp_path}/g", 32)
    table.create(rows)
    index.create(search_index.grams(rows, "npi", columns))
    for text in ("smith17", "NURSING h", "ann", "O'N", "ÉMI", "an", "", "zzzz", "th5", "medicinecard"):
        found = search_index.containing(table, index, spark, text, columns)
        want = {r["npi"] for r in rows.collect() if any(text.lower() in (r[c] or "").lower() for c in columns)}
        assert {r["npi"] for r in found.collect()} == want, text
    asked = search_index._asked(index, spark, "gram", search_index.query_grams("smith17"))
    assert 0 < files_read(asked) < len(files(f"{tmp_path}/g")) / 2
    found = search_index.containing(table, index, spark, "smith17", columns)
    assert 0 < files_read(found) < len(files(f"{tmp_path}/p")) / 2 + len(files(f"{tmp_path}/g")) / 2


def test_postings_of_a_frequent_term_are_in_several_files(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("npi"), F.lit("common").alias("t"))
    index = search_index.text_index(spark, f"file://{tmp_path}/i", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else parts as small as these are put together
    try:
        index.create(search_index.postings(rows, "npi", {"t": "A"}))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(f"{tmp_path}/i")) > 1 and search_index.text_search(index, spark, "common").count() == 4000


def test_snapshot_equals_live_after_changes(spark, tmp_path):
    rng = random.Random(3)
    row = lambda i: (i, rng.choice(["A", "B", "C", None]), rng.choice([True, False, None]), rng.choice([None, 10.0, 50.0, 69.99, 70.0, 90.0, 99.5]), rng.choice([None, 0.1, 1e9, 12.345678]))
    schema = "npi long, state string, excluded boolean, risk_score double, total_payment double"
    rows = {i: row(i) for i in range(200)}
    frame = lambda rs: spark.createDataFrame(list(rs), schema)
    table = snapshot.snapshot_table(f"file://{tmp_path}/s", 4)
    snapshot.take(table, frame(rows.values()))
    for turn in range(3):
        changed = rng.sample(sorted(rows), 50)
        was = [rows[i] for i in changed]
        for i in changed[:20]:
            rows.pop(i)
        rows |= {i: row(i) for i in changed[20:]} | {1000 + turn: (1000 + turn, "D", False, 80.0, 5.0)}
        now = [rows[i] for i in (*changed[20:], 1000 + turn)]
        numbers = snapshot.refresh(table, frame(was), frame(now))
        assert len(numbers) <= 4
        assert snapshot.dashboard(spark, table, frame([])).collect() == snapshot.live(frame(rows.values())).collect()
    cases = spark.createDataFrame([("A", "open"), ("B", "open"), ("A", "closed")], "state string, status string")
    limited = snapshot.dashboard(spark, table, frame(rows.values()), cases, ["A"]).first()
    assert limited["open_cases"] == 1 and limited["states"] == 1 and limited["providers"] == sum(r[1] == "A" for r in rows.values())
    snapshot.refresh(table, frame(rows.values()), frame([]))
    assert table.table(spark).count() == 0 and snapshot.dashboard(spark, table, frame([])).first()["providers"] == 0


@pytest.mark.parametrize("hot,few", [(50, 1), (50, 20), (10**6, 10)])
def test_percentiles(spark, hot, few):
    rng = np.random.default_rng(5)
    groups = {"ties": rng.integers(0, 3, 3000).astype(float), "tail": rng.lognormal(0, 8, 3000), "one": np.full(300, 7.25), "two": np.array([1.0, 2.0]), "small": rng.normal(size=49), "signs": rng.normal(0, 1e300, 500), "tiny": np.array([0.0, 5e-324] * 60 + [0.0]), "": rng.normal(size=400)}
    rows = [(k or None, float(v)) for k, vs in groups.items() for v in vs] + [("small", None), ("small", float("nan")), ("nothing", None)]
    at = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["k"]: r for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", at, hot=hot, few=few).collect()}
    assert set(got) == {k or None for k in groups}
    for k, vs in groups.items():
        assert got[k or None]["n"] == len(vs)
        np.testing.assert_allclose(got[k or None]["p"], np.percentile(vs, [100 * a for a in at]), rtol=1e-12)


def test_percentiles_of_infinite_values(spark):
    values = [float("-inf")] * 3 + list(range(100)) + [float("inf")] * 2
    got = quantiles.percentiles(spark.createDataFrame([(1, float(v)) for v in values], "k int, v double"), ["k"], "v", [0.0, 0.5, 1.0], hot=10, few=4).first()
    assert got["p"] == [float("-inf"), 49.0, float("inf")]


def test_networks_of_all_centers_equal_one_by_one(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(40), rng.randrange(40)): rng.randint(11, 30) for _ in range(260)} | {(0, i): 40 for i in range(1, 40)}
    frame = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "source long, target long, shared long").cache()
    known = spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 10)) for i in range(38)], "npi long, risk_score double")
    for hops, more in ((1, {"most_edges": 6, "most_inner": 9}), (2, {"most_edges": 6, "second_edges": 12}), (2, {"most_edges": 6, "second_edges": 12, "people": known, "most_nodes": 8})):
        got = graph.ego_networks(frame, spark.range(40).withColumnRenamed("id", "npi"), hops, **more).collect()
        for center in (0, 1, 7, 13, 39):
            one = graph.ego_network(frame, center, hops, **more).collect()
            assert sorted((r["source"], r["target"], r["shared"], r["hop"]) for r in got if r["center"] == center) == sorted((r["source"], r["target"], r["shared"], r["hop"]) for r in one)


def test_zip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zips, "BLOCK", 7)
    plain = ["1,2,30,20,5", "2,1,30,20,5", "3,3,99,99,1", "12,13,x,20,1", "12,14,30.0,11.9,", "5,6,1,10,0", "7,8,40,50,bad", "bad,1,1,50,1"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.md", "no")
        z.writestr("dir/pairs.CSV", "\r\n".join(["NPI_1,NPI_2,Pair_Count,Bene_Count,Same_Day_Count", *plain]) + "\r\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("pairs.txt", "\n".join(plain))
    lines = zips.zip_lines(spark, str(tmp_path / "*.zip")).cache()
    assert [r["line"] for r in lines.where("path LIKE '%b.zip'").orderBy("n").collect()] == plain
    want = sorted([("1", "2", 30, 20, 5), ("2", "1", 30, 20, 5), ("12", "14", 30, 11, 0), ("7", "8", 40, 50, 0)])
    for name in "ab":
        got = zips.pairs_of(lines.where(f"path LIKE '%{name}.zip'")).collect()
        assert sorted((r["source"].lstrip("0"), r["target"].lstrip("0"), *r[2:]) for r in got) == want
        assert all(len(r["source"]) == len(r["target"]) == 10 for r in got)
    keys = spark.createDataFrame([("0000000001",), ("0000000002",)], "npi string")
    assert zips.pairs_of(lines, keys=keys).count() == 4
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("readme.md", "no")
    with pytest.raises(Exception, match="no member that fits"):
        zips.zip_lines(spark, str(tmp_path / "c.zip")).collect()


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Edges and providers of a table of many tasks' rows: dealt by its number of rows, with the same results."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, fixtures.edges(spark, sf).collect())), sorted(map(tuple, fixtures.providers(spark, sf).collect()))
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(staging, "TASK_ROWS", 250)
    edges, lines = fixtures.edges(spark, sf), fixtures.lines_by_provider(spark, sf)
    assert edges.rdd.getNumPartitions() == -(-2 * n // 250) and lines.rdd.getNumPartitions() == -(-n // 250)
    assert (sorted(map(tuple, edges.collect())), sorted(map(tuple, fixtures.providers(spark, sf).collect()))) == whole


def test_archives_of_a_bounded_size(spark, monkeypatch):
    """Many pairs are in many archives, half of them with a header, and all are read."""
    sf, written = "/root/testdata/sf0.01", []
    write = zips.write_zips
    monkeypatch.setattr(index_queries, "ZIP_LINES", 500)
    monkeypatch.setattr(zips, "write_zips", lambda *a, **k: written.append(write(*a, **k).cache()) or written[-1])
    got = index_queries.zip_pairs(spark, sf)
    want = fixtures.edges(spark, sf).where("shared >= 3")
    assert sorted((int(r["source"]), int(r["target"]), r["shared"]) for r in got.collect()) == sorted(map(tuple, want.collect()))
    sizes = [r["lines"] for df in written for r in df.collect()]
    assert len(sizes) > 4 and max(sizes) <= 1000


def test_neighbours_and_second_hops_of_many_tasks(spark, monkeypatch):
    """Rows of several tasks, dealt by pair and by centre, have the same best neighbours and networks; edges are computed once."""
    edges = spark.createDataFrame([(i, j, (i * 31 + j * 17) % 23) for i in range(40) for j in range(i + 1, 40)], "source long, target long, shared long")
    centers = spark.createDataFrame([(i,) for i in range(0, 40, 7)], "npi long")
    run = lambda: [sorted(map(tuple, df.collect())) for df in (briefs.top_neighbours(edges, 4), graph.ego_networks(edges, centers, 2, most_edges=6, second_edges=9))]
    whole, tasks, deal = run(), [], staging.dealt
    monkeypatch.setattr(staging, "TASK_ROWS", 50)
    for module in (briefs, graph):
        monkeypatch.setattr(module, "dealt", lambda df, rows, *keys: tasks.append((rows, keys)) or deal(df, rows, *keys))
    assert run() == whole
    assert tasks == [(2 * 780, ("npi", "other")), (6 * 6 * 11, ("center",))]


def exchanged(df):
    """What each exchange of the plan deals by: [names of columns]."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"hashpartitioning\((.*?)\)", plan)]


def test_distinct_counts_need_no_exchange_of_their_own(spark, monkeypatch):
    """Lines dealt by provider are counted where they are: Spark's own exchange by (provider, beneficiary, code) would be of tasks that grow."""
    monkeypatch.setattr(staging, "TASK_ROWS", 250)
    found = exchanged(fixtures.providers(spark, "/root/testdata/sf0.001"))
    assert ["npi"] in found and not any("npi" in keys and len(keys) > 1 for keys in found)


def test_edges_are_dealt_once_by_source(spark, monkeypatch):
    """Percentages and sources by edges dealt so; another exchange by source would be of tasks that grow."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, fixtures.edges(spark, sf).collect()))
    monkeypatch.setattr(staging, "TASK_ROWS", 250)
    assert sorted(map(tuple, fixtures.edges(spark, sf, by=("source",)).collect())) == whole
    for name in ("edges_percent", "node_search_indexed"):
        found = exchanged(QUERIES[name](spark, sf))
        assert [keys for keys in found if keys[0] == "source"] == [["source"]]


def test_medians_of_scored_providers_are_selected(spark, monkeypatch):
    """Specialties of more providers than a buffer should hold: by counted ranges, with the same scores."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, registry.scored(spark, sf).collect()))
    monkeypatch.setattr(registry, "_WRITTEN", {})
    monkeypatch.setattr(registry, "percentiles", partial(quantiles.percentiles, hot=5, few=3))
    assert sorted(map(tuple, registry.scored(spark, sf).collect())) == whole


def test_parts_are_broadcast_or_dealt_with_their_lines(spark, monkeypatch):
    """Never by Spark's own exchange by part, whose tasks grow with the lines."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, fixtures.lines(spark, sf).collect()))
    by_part = lambda: [keys for keys in exchanged(fixtures.lines(spark, sf)) if keys[0].endswith("partkey")]
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert by_part() == []
        monkeypatch.setattr(staging, "TASK_ROWS", 100)
        assert sorted(by_part()) == [["l_partkey"], ["p_partkey"]]
        plan = fixtures.lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan
        assert sorted(map(tuple, fixtures.lines(spark, sf).collect())) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_scored_providers_are_not_dealt_by_specialty(spark, monkeypatch):
    """A specialty's providers would be one task's."""
    sf, made, write = "/root/testdata/sf0.001", [], registry.written
    whole = sorted(map(tuple, registry.scored(spark, sf).collect()))
    monkeypatch.setattr(registry, "_WRITTEN", {})
    monkeypatch.setattr(registry, "written", lambda df, name: made.append((name, exchanged(df))) or write(df, name))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, registry.scored(spark, sf).collect())) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert dict(made)["scored"] == []


def dealt_alone(spark, monkeypatch, name, sf="/root/testdata/sf0.001"):
    """Does a query on scored providers deal large tables to its joins and groups by npi, and leave none to Spark's own exchange, with the same rows?"""
    whole = sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(staging, "TASK_ROWS", 5)
    try:
        df = QUERIES[name](spark, sf)
        plan, found = df._jdf.queryExecution().executedPlan().toString(), exchanged(df)
        for got, want in zip(sorted(map(tuple, df.collect())), whole, strict=True):
            assert got == tuple(pytest.approx(x, abs=0.011) if isinstance(x, float) else x for x in want)  # rounded sums of doubles in another order
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    own = [x for x in plan.split("\n") if "hashpartitioning(npi#" in x and "ENSURE_REQUIREMENTS" in x]
    return found.count(["npi"]) >= 2 and not own


def test_facilities_and_citations_of_many_tasks(spark, monkeypatch):
    assert dealt_alone(spark, monkeypatch, "facility_and_citation")


def test_flags_of_many_tasks_are_counted_by_provider(spark, monkeypatch):
    assert dealt_alone(spark, monkeypatch, "flag_counts")


@pytest.mark.parametrize("name", ["state_map", "map_totals", "exposure"])
def test_flags_of_many_tasks_meet_their_providers(spark, monkeypatch, name):
    assert dealt_alone(spark, monkeypatch, name)


def test_map_order_deals_no_providers(spark, monkeypatch):
    """Its states are counted in the tasks; what it doesn't show isn't joined."""
    monkeypatch.setattr(staging, "TASK_ROWS", 5)
    assert not any("npi" in keys for keys in exchanged(QUERIES["map_order"](spark, "/root/testdata/sf0.001")))
