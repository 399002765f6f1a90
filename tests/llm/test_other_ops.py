"""URL filters, WARC, vectors, licences and shards against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np

from ledgerwise.llm import ann, license_scan, sharding, url_filter, warc


def test_url_filter(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "notexample.org", "x.com", "com", "de.net", "", "a.b.com:80", "org"]
    paths = ["", "/", "/es/1", "/es", "/en/12", "/en/2", "/fr/x", "/de/", "/fr"]
    urls = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#/de/', '?a://b'])}") for i in range(300)]
    urls += [(500, None), (501, ""), (502, "no scheme/es/"), (503, "http://"), (503, "http://"), (None, "http://example.org/es/")]
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("x.com", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=str)
    want = []
    for i, u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert got == sorted(want, key=str)


def test_bloom_loses_nothing(spark):
    keys = spark.range(0, 3000).selectExpr("concat('k', id) AS key")
    probes = spark.range(0, 30000).selectExpr("concat('k', id) AS key", "id AS w0")
    blocks = url_filter.bloom_blocks(3000)
    hits = url_filter.possible_hits(probes, "key", url_filter.blocked_bloom(keys, "key", blocks), blocks)
    found = {r.key for r in hits.collect()}
    assert found >= {f"k{i}" for i in range(3000)} and len(found) < 3300
    told = url_filter.possible_hits(probes, "key", url_filter.blocked_bloom(keys, "key", blocks), blocks, keep=True)
    assert told.count() == 30000 and {r.key for r in told.where("maybe").collect()} == found
    assert url_filter.without(probes.withColumn("id", probes.w0), spark.range(0, 10).toDF("id"), "id").count() == 29990


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 200_000
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", None), (4, "", ""), (5, "q", "x\r\n\r\ny"), (5, "q", "x\r\n\r\ny"), (None, "q", "x\r\n\r\ny"), (7, "z", "WARC/1.1\r\n"), (None, "n", "only null")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    archives = warc.write_archives(pages.repartition(2), f"file://{tmp_path}/warc")
    chunks = warc.read_archives(archives).collect()
    of = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in chunks if r.is_last), key=str)
    best = {}
    for i, _, t in rows:
        best[t or ""] = max([best.get(t or ""), i], key=lambda x: (x is not None, x or 0))
    want = [(i, len((t or "").encode()), of(t), "response" if best[t or ""] in (i, None) else "revisit", None if best[t or ""] in (i, None) else best[t or ""]) for i, _, t in rows]
    assert last == sorted(want, key=str)
    parts = sorted((r for r in chunks if r.page_id == 2), key=lambda r: r.chunk_no)
    assert b"".join(r.chunk for r in parts) == big.encode() and len(parts) == -(-400_000 // warc.CHUNK_BYTES)
    sha, size = hashlib.sha1(), 0
    for r in parts:
        sha.update(r.chunk)
        size += len(r.chunk)
        assert r.running_sha1 == warc.digest(sha.digest()) and r.bytes_so_far == size
    only = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/two", least_bytes=100)).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in only] == [(1, 2)]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_keeps_very_long_urls_and_many_copies(spark):
    url = "http://example.org/" + "u" * 400_000
    pages = spark.createDataFrame([(i, url if i % 3 == 0 else None, "same" * 1000 if i < 40 else f"other {i}") for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages.repartition(3))).collect()}
    assert len(got) == 60 and all(got[i].target_uri == (url if i % 3 == 0 else None) for i in got)
    assert {i for i in got if got[i].record_type == "response"} == {39, *range(40, 60)}
    assert all(got[i].refers_to == 39 and got[i].payload_bytes == 4000 and got[i].payload_digest == got[39].payload_digest for i in range(39))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i]], "s") for i in range(900)]
    rows += [(2000, None, "s"), (2001, [0.0] * 8, "s"), (2002, [math.nan] + [1.0] * 7, "s"), (2003, [math.inf] + [1.0] * 7, "s"), (2004, [1.0] * 3, "s"), (None, [1.0] * 8, "s"), (2005, [None] + [1.0] * 7, "s")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = table.where("vec_id % 100 = 0")
    exact = {}
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        exact[q] = [(i, d[i]) for i in np.lexsort((np.arange(900), d)) if i != q][:10]
    for target, floor in ((1.0, 1.0), (0.9, 0.85)):
        got = ann.search(table, asked, target=target).collect()
        hits = 0
        for q in exact:
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 11))
            assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
            hits += len({r.vec_id for r in mine} & {i for i, _ in exact[q]})
            if floor == 1.0:
                assert np.allclose([r.score for r in mine], [s for _, s in exact[q]], rtol=0, atol=0)
        assert hits >= floor * 90
    assert {r.query_id for r in got} == set(exact)
    few = ann.search(table.where("vec_id < 4"), table.where("vec_id = 0")).collect()
    assert len(few) == 3
    assert ann.search(table.limit(0), asked).count() == 0


def test_few_entries_are_enough_with_clusters(spark, monkeypatch):
    """With clusters the walk stops after a small part of the entries, at a recall of 0.9 or more of all queries."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(60, 16)) * 4
    x = (centers[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    measured = ann.enough_entries
    monkeypatch.setattr(ann, "enough_entries", lambda *a: seen.append(measured(*a)) or seen[-1])
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        hits += len(got[q] & {i for i in np.lexsort((np.arange(6000), d))[:11].tolist() if i != q})
    assert seen[0] < 0.1 * 6000 and hits >= 0.9 * 3000


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(0)
    one, two = rng.random(6), rng.random(5)
    cells = ann.walk(one, two, np.ones((6, 5), int), 30)
    sums = [one[i] + two[j] for i, j in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)
    assert len(ann.walk(one, two, np.full((6, 5), 10), 25)) == 3


def brute_scan(rows, least):
    n, templates = len(rows), license_scan.TEMPLATES
    known = {t for _, x in templates for t in license_scan.terms_of(x)}
    idf = {t: math.log((1 + n) / (1 + sum(t in license_scan.terms_of(x or "") for _, _, x in rows))) + 1 for t in known}
    vector = lambda terms: {t: terms.count(t) * idf.get(t, math.log(1 + n) + 1) for t in set(terms)}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own = {}
    for i, path, text in rows:
        name = (path or "").split("/")[-1]
        is_file = re.match(license_scan.LICENSE_FILE, name) is not None
        for segment in [*re.split("\r?\n|\r", text or ""), *([text or ""] if is_file else [])]:
            v = vector(license_scan.terms_of(segment))
            for lic, notice in templates:
                t = vector(license_scan.terms_of(notice))
                cos = round(sum(w * t.get(k, 0) for k, w in v.items()) / (norm(v) * norm(t)), 6) if v else 0
                held = {x for x in license_scan.terms_of(notice) if x.isdigit()} <= v.keys()
                if cos >= least and held:
                    own[i] = min(own.get(i, (0, "z", "")), (-cos, lic, path or ""))
    files = {}
    for i, path, _ in rows:
        if i in own and path and re.match(license_scan.LICENSE_FILE, path.split("/")[-1]):
            folder = path[: path.rfind("/") + 1]
            s, lic, p = own[i]
            files[folder] = min(files.get(folder, (0, "~", "")), (s, path, lic))
    out = {}
    for i, path, _ in rows:
        if i in own:
            out[i] = (own[i][1], "own", None)
            continue
        folder = path[: path.rfind("/") + 1] if path is not None else None
        over = [f for f in files if folder is not None and folder.startswith(f)]
        best = files[max(over, key=len)] if over else None
        out[i] = (best[2], "inherited", best[1]) if best else (None, None, None)
    return out


def test_license_scan(spark):
    rng = random.Random(6)
    filler = lambda k: " ".join(rng.choices(["under", "the", "public", "version", "words", "of", "license", "zeta"], k=k))
    notices = [x for _, x in license_scan.TEMPLATES]
    rows = [(0, "LICENSE", notices[3]), (1, "a/LICENSE.md", f"intro\n{notices[0].upper()}\nmore {filler(20)}"), (2, "a/b/x.py", filler(30)), (3, "a/b/COPYING", "nothing here"), (4, None, None), (5, "a/c/d/e", ""), (6, "/abs/LICENSE", notices[6]), (7, "/abs/y/z", "q"), (8, "other/LICENSE", notices[4].replace("\n", " ")), (9, "other/f", f"{filler(8)}\r\n{notices[12]}!\r\n{filler(8)}"), (10, "licenses/f", "x")]
    for i in range(11, 60):
        rows.append((i, f"{rng.choice(['a', 'a/b', 'other', 'abs', ''])}/f{i}", "\n".join([filler(rng.randint(1, 9)), rng.choice([*notices, filler(12)]) + " " + filler(rng.randint(0, 6)), filler(3)])))
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    for least in (0.5, license_scan.LEAST):
        got = {r.doc_id: (r.license, r.how, r.from_path) for r in license_scan.scan(files, least=least).collect()}
        assert got == brute_scan(rows, least)
    assert license_scan.scan(files.limit(0)).count() == 0


def test_license_query_weighs_all_terms(spark, tmp_path):
    """Notices with common words, wrapped comments and whole licence texts, among files full of common words."""
    from ledgerwise.llm import queries

    rng = random.Random(9)
    common = "you may not use this file except in compliance with see for details is the of and a to under".split()
    rows = [(i, " ".join(rng.choices(common, k=60)) + f" w{i}", f"s{i}") for i in range(1, 600) if i % 100]
    full = dict(license_scan.full_texts())
    header = "Permission is hereby granted, free of charge,\n{0} to any person obtaining\n{0} a copy of this software"
    rows += [
        (1001, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "a"),
        (1102, f"x = 1\n# {header.format('#')}\ny = 2", "b"), (1203, f"/*\n{header.format('')}\n*/\nint main;", "c"),
        (1304, f"# Copyright someone else and others\n#\n# {header.format('#')}\n#\n# more about a thing that is not at all near, far zz yy xx vv uu tt ss", "d"),
        (1400, full["MIT"], "e"), (1401, "inherits", "e"), (1500, full["GPL-2.0"], "f"), (1600, full["BSD-2-Clause"], "g"), (1705, "nothing of the kind", "h"), (1806, None, "i")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.how) for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    want = {1001: ("Apache-2.0", "own"), 1102: ("MIT", "own"), 1203: ("MIT", "own"), 1304: ("MIT", "own"), 1400: ("MIT", "own"), 1401: ("MIT", "inherited"), 1500: ("GPL-2.0", "own"), 1600: ("BSD-2-Clause", "own")}
    assert {d: x for d, x in got.items() if x[0]} == want


def test_license_versions_and_families(spark, tmp_path):
    """Notices that differ by a version or a clause, SPDX tags, and heads of licence files, in the query itself."""
    from ledgerwise.llm import queries

    full = dict(license_scan.full_texts()[len(license_scan.HEADERS) :])
    files = {p.stem: p.read_text() for p in sorted(license_scan.Path(license_scan.__file__).with_name("licenses").glob("*.txt"))}
    assert set(files) == set(full)
    probes = [
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("Licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("Licensed under the GNU General Public License, version 1", None), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Released under the ISC License", "ISC"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "ISC"),
        ("Released under the MIT License.", "MIT"), ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), ("words about nothing of the kind", None)]
    rows = [(1001 + i, text, "a") for i, (text, _) in enumerate(probes)]
    want = {1001 + i: name for i, (_, name) in enumerate(probes)}
    for n, (name, text) in enumerate(files.items()):
        for m, part in enumerate([text, text[:700], text[:1500]] if len(text) > 5000 else [text]):
            rows.append((100 * (100 + 3 * n + m), part, f"f{n}-{m}"))
            want[rows[-1][0]] = name
    header = license_scan._GNU.format("program", "General Public License", "2", ";", ";")
    rows.append((5001, "/*\n * " + "\n * ".join(header[i : i + 80] for i in range(0, len(header), 80)) + "\n */\nint x;", "c"))
    want[5001] = "GPL-2.0"
    rng = random.Random(1)
    rows += [(200_001 + i, " ".join(rng.choices("you may not use this file the of a to under public work general version free software".split(), k=50)) + f" w{i}", "z") for i in range(300) if (i + 1) % 100]
    want |= dict.fromkeys((r[0] for r in rows if r[0] > 200_000), None)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    assert {d: x for d, x in got.items() if x != want[d]} == {}


def test_shards(spark):
    rng = random.Random(7)
    texts = [f"text {rng.randint(0, 40)}" for _ in range(500)] + ["hot"] * 300 + [None, "", "é"]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, label int")
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    sizes = [0] * 16
    for r in got:
        sizes[r.shard] += 1
    assert max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    hot = zlib.crc32(b"hot")
    assert sum(len(s) - 1 for c, s in by.items() if c != hot) <= 16 and len(by[hot]) <= 300 // (len(rows) // 16) + 2
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_propagation_gathers_linked_documents(spark):
    """Chains and cliques that begin in different shards end with fewer cut links; loads keep their quota."""
    rng = random.Random(9)
    links = [(g * 20 + i, g * 20 + rng.randrange(20)) for g in range(40) for i in range(20) for _ in range(3)]
    nodes, edges = spark.range(0, 800).toDF("id"), spark.createDataFrame(links, "src long, dst long")
    cut = lambda state: (lambda at: sum(at[a] != at[b] for a, b in links))({r.id: r.label for r in state.collect()})
    first, last = sharding.propagate(nodes, edges, 8, rounds=0), sharding.propagate(nodes, edges, 8, rounds=6)
    assert cut(last) < 0.7 * cut(first)
    assert last.count() == 800


def test_propagation_equals_plain_python(spark):
    """With room for all, labels after each number of rounds are those of a plain version that uses the same draws."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    n, shards = 90, 5
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(110)] + [(3, 3), (4, 1000)]
    nodes, edges = spark.range(n).toDF("id"), spark.createDataFrame(links, "src long, dst long")
    draws = {r[0]: r[1:] for r in nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(shards)), *(F.shiftrightunsigned(F.xxhash64("id", F.lit(t)), 24) for t in range(4))).collect()}
    near = {i: set() for i in range(n)}
    for a, b in links:
        if a != b and max(a, b) < n:
            near[a].add(b)
            near[b].add(a)
    degree = {i: len(near[i]) + (i == 4) for i in near}  # a link to an unknown id counts as a link, not as a vote
    label = {i: draws[i][0] for i in near}
    cut = []
    for turn in range(5):
        got = {r.id: (r.cluster, r.label) for r in sharding.propagate(nodes, edges, shards, turn, slack=100.0).collect()}
        assert got == {i: (min([i, *near[i]]), label[i]) for i in near}
        cut.append(sum(label[a] != label[b] for a, b in links if max(a, b) < n))
        if turn == 4:
            break
        first = {i: ((sharding.MOST_DEGREE - degree[i]) * (turn % 2 == 0), draws[i][1 + turn]) for i in near}
        after = dict(label)
        for i in near:
            if near[i] and all(first[i] > first[j] for j in near[i]):
                votes = [label[j] for j in near[i]]
                after[i] = min(set(votes), key=lambda x: (-votes.count(x), x))
        label = after
    assert cut == sorted(cut, reverse=True) and cut[-1] < cut[0]


def test_more_rounds_keep_more_equal_texts_together(spark):
    """In the query's own operator: rounds, not the start, bring equal texts together, and quotas bind."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"text {rng.randint(0, 300)}") for i in range(1500)] + [(9000 + i, f"alone {i}") for i in range(1500)], "doc_id long, text string")
    apart = []
    for rounds in (0, 1, 4):
        at = {}
        for r in sharding.shard_documents(docs, rounds=rounds).collect():
            at.setdefault(r.text_crc32, set()).add(r.shard)
        apart.append(sum(len(x) - 1 for x in at.values()))
    assert apart[0] > 700 and apart[2] <= apart[1] < 0.5 * apart[0] and apart[2] <= 15


def test_shares_of_full_shards():
    assert sharding.shares([(0, 1, 10), (1, 0, 10)], {0: 50, 1: 50}, 50) == {0: 1.0, 1: 1.0}
    one = sharding.shares([(0, 1, 40), (2, 1, 40)], {0: 50, 1: 50, 2: 50}, 60)
    assert abs(one[1] - 10 / 80) < 1e-6
    assert sharding.shares([(0, 1, 5)], {0: 5, 1: 99}, 60)[1] == 0.0


def test_url_filter_without_pages_or_rules_and_with_long_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://example.org/es/" + "x" * 300_000), (2, "http://" + "a." * 300 + "org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block", 300_004), 2: ("org/", "allow", 1)}
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_splits_a_hot_url(spark):
    """A url that half of all pages have is many tasks' work, and one without a host isn't shuffled."""
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
        pages = spark.range(300_000).selectExpr("id AS page_id", "CASE WHEN id % 8 > 0 THEN 'http://example.org/es/' WHEN id % 3 = 0 THEN NULL ELSE concat('http://h', id, '.org/') END AS url")
        out = url_filter.judge_urls(pages.repartition(8), rules)
        assert out.count() == 300_000 and out.where("verdict = 'block'").count() == 262_500
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
