"""The pipeline against plain Python, on documents of every kind that a stage acts on."""

import re

import pytest

from . import brute
from .test_text_ops import corpus


def cut_text(rows, k):
    """(id, text, words, removed) with the removed words and the white space after them cut out."""
    first, spans = {}, {d: [m.span() for m in re.finditer(brute.SPACE, t or "")] for d, t in rows}
    word = {d: [t[a:b] for a, b in spans[d]] for d, t in rows if t is not None} | {d: [] for d, t in rows if t is None}
    for d in sorted(word):
        for i in range(len(word[d]) - k + 1):
            first.setdefault(tuple(word[d][i : i + k]), d)
    for d, t in rows:
        gone = {j for i in range(len(word[d]) - k + 1) if first[tuple(word[d][i : i + k])] < d for j in range(i, i + k)}
        starts = [a for a, _ in spans[d]] + [len(t or "")]
        out = t or ""
        for j in sorted(gone, reverse=True):
            out = out[: starts[j]] + out[starts[j + 1] :]
        yield d, out, len(word[d]), len(gone)


def test_pipeline(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in corpus(150, seed=11)] + [(1000, "12 34 !!"), (1001, "...")]
    items = [(0, " ".join((dict(rows)[9] or "").split()[:12])), (1, "nothing like it in any text of the corpus at all here")]
    spark.createDataFrame([(d, t, "en" if d % 2 else "fr", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    groups = brute.near_duplicates(left, 5)
    left = [(d, t) for d, t in left if groups[d][2]]
    cut = list(cut_text(left, 13))
    assert any(r for *_, r in cut)
    left = [(d, t) for d, t, n, r in cut if r == 0 or r < n]
    hits = brute.benchmark_hits(left, items)
    left = [(d, t) for d, t in left if not hits[d][4]]
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in left}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
    assert {r.doc_id: r.text for r in docs.collect()} == dict(left)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = cp.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in got:
        assert r.doc_tokens == want[r.doc_id]
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == want


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_language_stage_rejects_languages_that_nobody_taught(spark):
    import random

    import corpus_pipeline as cp

    rng = random.Random(3)
    taught = ["".join(rng.choices(LETTERS, k=5)) for _ in range(200)]
    rows = [(d, " ".join(rng.choices(taught, k=30)), "en", "s", 1) for d in range(60)]
    rows += [(100, "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства", None, "s", 1), (101, "мощный", None, "s", 1), (None, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", None, "s", 1), (102, " ".join(taught[:30]), None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.identified(spark, docs, "").collect()} == {*range(60), 101, 102}


def test_stages_on_null_and_repeated_ids_more_columns_and_empty_tables(spark, tmp_path):
    """Contaminated rows go by their own text; clashing names are handed on; nothing in, nothing out."""
    import corpus_pipeline as cp

    leak = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, owner string, id long, block int, kept boolean, n_removed int, foreign string"
    row = lambda d, t, n=0: (d, t, "en", "s", len(t or ""), 0.5, "o", 7, 1, False, n, "f")
    clean = " ".join(f"clean{i}" for i in range(40))
    rows = [row(1, f"x {leak} y"), row(None, f"x {leak} y"), row(2, clean), row(2, f"z {leak}"), row(None, "quiet words of no other row", 5), row(3, "quiet words of no other row", 6)]
    docs = spark.createDataFrame(rows, schema)
    left = cp.decontaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if leak not in r.text)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and out.count() >= 2 and all(r.foreign == "f" and r.score == 0.5 for r in out.collect()), name


@pytest.mark.parametrize("lang", ["nothing", "all held out", "und"])
def test_language_stage_keeps_documents_with_letters(spark, lang):
    """With no label to learn from, or one that is `und`, only documents without a letter go."""
    import zlib

    import corpus_pipeline as cp

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    of = {"nothing": lambda d: None, "all held out": lambda d: "en" if held(d) else None, "und": lambda d: "und" if d % 2 else "en"}[lang]
    rows = [(d, f"some words {d}", of(d), "s", 12) for d in range(40)] + [(100, "12 34 !!", of(100), "s", 8), (101, None, None, "s", 0), (102, "é", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.identified(spark, docs, "")
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {r for r in rows if r[0] not in (100, 101)}
