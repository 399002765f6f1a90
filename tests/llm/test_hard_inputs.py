"""Inputs that once made a step quadratic, a row unbounded or a task die."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import license_scan, near_dedup, packing, substring_dedup, url_filter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 5_000_000, "\n" * 1_000_000, " \n\t" * 400_000, "\u3000 " * 300_000])
def test_packing_takes_any_white_space(spark, run):
    text = "a" + run + "b<|endoftext|>" + run[:7] + "c"
    want = np.array([*library_ids(text), 1], "<u4")
    assert [*packing.ids_of(BYTE_BPE)(text), 1] == want.tolist()
    docs = spark.createDataFrame([(1, text), (2, "x y"), (3, run)], "doc_id long, text string")
    got = packing.pack(docs, BYTE_BPE, length=2048).where("doc_id = 1").orderBy("start").collect()
    at = 0
    for r in got:
        assert (r["start"], r["doc_tokens"]) == (at, len(want))
        assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
        at += r["length"]
    assert at == len(want)


def test_run_lengths_about_the_switch():
    encode = packing.ids_of(BYTE_BPE)
    for n in (packing.RUN - 1, packing.RUN, packing.RUN + 1):
        for blank in (" ", "\n", "\t "):
            text = "x" + blank * n + "y"
            assert encode(text) == library_ids(text)


def families(m, seed=1):
    """Two families of m near copies of texts that share about 0.6 of their shingles."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    both = [word() for _ in range(225)]
    rows = []
    for family in range(2):
        own = [word() for _ in range(75)]
        for i in range(m):
            text = both + own
            for _ in range(3):
                text[rng.randrange(len(text))] = word()
            rows.append((family * m + i, " ".join(text)))
    return rows


def candidates_of(spark, rows, monkeypatch):
    counted, plain = [], near_dedup.straggler_candidates

    def counting(*args):
        members, pairs = plain(*args)
        counted.append(pairs.count())
        return members, pairs

    monkeypatch.setattr(near_dedup, "straggler_candidates", counting)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    return counted, {r["doc_id"]: r["component_id"] for r in found.collect()}


def test_two_families_have_few_candidates(spark, monkeypatch):
    for m in (40, 400):
        counted, comps = candidates_of(spark, families(m), monkeypatch)
        assert counted[-1] <= 4 * m
        assert set(comps.values()) == {0, m} and all(c == (0 if d < m else m) for d, c in comps.items())


def test_links_of_one_id_with_several_texts(spark):
    """A chain a - b - c where b and c are texts of one id, and copies of either text under other ids."""
    rng = random.Random(4)
    text = lambda: [f"w{rng.randrange(10**9)}" for _ in range(120)]
    one, two, three = text(), text(), text()
    near = lambda words, i: " ".join(words[:i] + ["changed"] + words[i + 1 :])
    rows = [(7, " ".join(one)), (7, " ".join(two)), (7, " ".join(three)), (5, near(one, 30)), (9, near(two, 40)), (11, near(three, 50)), (12, " ".join(text())), (3, near(three, 80)), (7, " ".join(two))]
    for k in (2, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, 12 if d == 12 else 3) for d in (7, 5, 9, 11, 12, 3)}
        assert len(got) == len(rows)


def tables(spark):
    from pathlib import Path

    from ledgerwise.llm.shared import shared_dir

    return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


def left_behind(spark, run):
    """The names of the tables that are there after a run and weren't before."""
    before = tables(spark)
    run()
    return sorted(name.rsplit("-", 1)[0] for name in tables(spark) - before)


def test_only_tables_that_a_result_reads_are_left(spark):
    found = left_behind(spark, lambda: near_dedup.near_duplicates(spark.createDataFrame(families(20), "doc_id long, text string"), k=2).count())
    assert found == ["comps", "comps", "signatures"]
    files = spark.createDataFrame([(1, "a/LICENSE", license_scan.TEMPLATES[0][1]), (2, "a/b", "x")], "doc_id long, path string, text string")
    found = left_behind(spark, lambda: license_scan.scan(files, texts=license_scan.full_texts(), corpus_idf=True, comments=True).count())
    assert found == ["inherited", "own"]


def test_long_hosts(spark):
    host = ".".join(["a"] * 100_000) + ".example.org"
    rows = [(1, f"http://{host}/en/1x?q"), (2, f"http://{host}/fr/"), (3, "http://example.org/es/1"), (4, "http://.org/"), (5, "http://org"), (6, "http://org/x"), (7, "http://a..com/de/"), (8, "http://" + "." * 100_000 + "com/fr/")]
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert time.time() - began < 60
    assert got == {
        1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("example.org/es/", "block"), 4: ("org/", "allow"), 5: (None, "allow"), 6: ("org/", "allow"), 7: ("com/de/", "block"), 8: ("com/fr/", "allow")}


def test_long_rules(spark):
    """Rules of many label counts, with empty labels, against plain suffixes."""
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "", "c"])
    host = lambda n: ".".join(label() for _ in range(n))
    rules = {(host(rng.randint(1, 6)), rng.choice(["", "/", "/x"])): rng.choice(["allow", "block"]) for _ in range(60)}
    urls = [(i, f"h://{host(rng.randint(1, 8))}{rng.choice(['', '/', '/x1'])}") for i in range(400)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    got = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    for i, url in urls:
        rest = url.split("://", 1)[1]
        h, slash, p = rest.partition("/")
        fit = [a + b for a, b in rules if h and (h == a or h.endswith("." + a)) and (slash + p).startswith(b)]
        assert got[i] == min(fit, key=lambda x: (-len(x), x), default=None), url


def test_unclosed_comments(spark):
    mit = dict(license_scan.TEMPLATES)["MIT"] if "MIT" in dict(license_scan.TEMPLATES) else license_scan.TEMPLATES[0][1]
    rows = [(1, "/* " * 1_700_000), (2, "<!-- " * 1_000_000), (3, '""" /* <!-- ' * 400_000), (4, "/* x */ " * 600_000), (5, f"x\n/* {mit} */\n/* open"), (6, f"/* open\n<!-- {mit} -->"), (7, f"/*/ {mit}"), (8, None)]
    files = spark.createDataFrame([(i, f"p{i}/f", t) for i, t in rows], "doc_id long, path string, text string")
    began = time.time()
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(files, texts=license_scan.full_texts(), corpus_idf=True, comments=True).collect()}
    assert time.time() - began < 120
    assert len(got) == 8 and got[1] is None and got[2] is None and got[4] is None
    assert got[5] is not None and got[5] == got[6]


def test_delimited_comments_are_found_as_before(spark):
    """Blanks in place of beginnings without an end change no match of the pattern."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["/*", "*/", "<!--", "-->", '"""', "a", " ", "\n", "/", "*", "-", "<!"], k=rng.randint(0, 25))) for _ in range(2000)]
    found = lambda text: F.regexp_extract_all(text, F.lit(license_scan.COMMENT), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", found(F.col("t")).alias("plain"), found(license_scan._closed(F.col("t"))).alias("closed"))
    for r in rows.collect():
        assert [x.replace("<!--", "    ").replace("/*", "  ") for x in r["plain"]] == [x.replace("<!--", "    ").replace("/*", "  ") for x in r["closed"]], r["t"]


def test_many_rows_without_an_id(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocab, k=60)
    rows = [(i, " ".join([*rng.choices(vocab, k=30), *passage, *rng.choices(vocab, k=rng.randint(0, 20))])) for i in range(40)]
    lost = [(None, " ".join([*rng.choices(vocab, k=30), *rng.choice([passage, passage[:20], []]), *rng.choice(rows)[1].split()[:25]])) for _ in range(3000)]
    rows += [*lost, lost[0], (None, None), (None, ""), *((99, t) for _, t in lost[:1000])]

    def windows(text):
        words = (text or "").split()
        return [tuple(words[i : i + 13]) for i in range(len(words) - 12)]

    first = {}
    for d, t in rows:
        for w in windows(t):
            first[w] = min(first.get(w, 10**9), 10**9 if d is None else d)
    want = []
    for d, t in rows:
        gone = {i + j for i, w in enumerate(windows(t)) if first[w] < (10**9 if d is None else d) for j in range(13)}
        want.append((d, len((t or "").split()), len(gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in substring_dedup.cut_repeats(docs, k=13).select("doc_id", "n_words", "n_removed").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_takes_white_space_and_leaves_one_table(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(0, f"{words(30)}{' ' * 1_200_000}{words(30)}"), (1, words(80)), (2, f"{words(20)}{chr(10) * 1_200_000}{words(9)}"), (3, None), (None, words(40))]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, words(12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = []
    assert left_behind(spark, lambda: out.extend(corpus_pipeline.run(spark, str(tmp_path)).collect())) == ["stage-packing"]
    ids = {d: len(library_ids(t)) + 1 for d, t in rows if t}
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == ids
    assert sum(r["length"] for r in out) == sum(ids.values())
