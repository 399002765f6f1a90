"""The text operators against plain Python on small tables of hard cases."""

import random
import zlib

import numpy as np
import pytest

from ledgerwise.llm import decontamination, language_id, near_dedup, packing, substring_dedup
from ledgerwise.llm.textarrays import LOWER, NOT_SPACE, Words

from . import brute

SCHEMA = "doc_id long, text string, id string, key string, marks int, block int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, 1, 2) for d, t in rows], SCHEMA)


def corpus(n=120, seed=3):
    """Copies, near copies, shared passages, short, empty and null texts, tabs and letters beyond ASCII."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "É", "NASA", "a\u00a0b", "x,y"]
    text = lambda k: rng.choice([" ", "\n", "\t"]).join(rng.choices(vocab, k=k))
    passage = text(40)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "one two"), (6, "one  two\n")]
    base = text(90)
    for d in range(7, n):
        kind = rng.random()
        if kind < 0.3:
            words = base.split()
            for _ in range(rng.randint(0, 14)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((d, " ".join(words)))
        elif kind < 0.5:
            rows.append((d, rows[rng.randrange(len(rows))][1]))
        elif kind < 0.7:
            rows.append((d, f"{text(rng.randint(0, 30))} {passage} {text(rng.randint(0, 30))}"))
        else:
            rows.append((d, text(rng.randint(1, 60))))
    rows.append((n, " ".join(["again"] * 300)))
    rows.append((n + 1, " ".join(["again"] * 5000)))
    rng.shuffle(rows)
    return rows


def digest(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


def test_substring_dedup(spark):
    from pyspark.sql import functions as F

    rows = corpus()
    for k in (3, 13):
        got = substring_dedup.cut_repeats(table(spark, rows).repartition(5), k).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256))
        assert digest(got.collect()) == brute.cut_repeats(rows, k)


def test_substring_dedup_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "z b c d"), (None, "a b c d"), (2, "a b c d"), (2, "q a b c d"), (3, None)]
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed, r.kept_words) for r in substring_dedup.cut_repeats(table(spark, rows), 3).collect()))
    assert got == [(-1, 4, 4, ""), (1, 4, 0, "a b c d"), (1, 4, 0, "z b c d"), (2, 4, 4, ""), (2, 5, 4, "q"), (3, 0, 0, "")]


@pytest.mark.parametrize("bits", [10, 16])
def test_sketch_never_underestimates(spark, bits, monkeypatch):
    """With far too few cells everything passes to the exact step and the result is the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(substring_dedup, "MIN_BITS", bits)
    monkeypatch.setattr(substring_dedup, "MAX_BITS", bits)
    rows = corpus(60)
    got = substring_dedup.cut_repeats(table(spark, rows).repartition(3), 5).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256))
    assert digest(got.collect()) == brute.cut_repeats(rows, 5)


def test_gaps_round_trip():
    for cells in ([], [0], [254], [255], [256, 511, 512, 70000], list(range(0, 3000, 7))):
        cells = np.array(cells, np.int64)
        assert (substring_dedup._ungaps(substring_dedup._gaps(cells)) == cells).all()


def test_near_dedup(spark):
    rows = corpus()
    for k in (2, 5):
        got = near_dedup.near_duplicates(table(spark, rows), k).collect()
        assert digest(got) == brute.near_duplicates(rows, k)


def test_stragglers_of_a_large_group(spark):
    """Near copies of which many aren't linked to the pivot, but to one another."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocab, k=80)
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randint(3, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((d, " ".join(words)))
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((1000 + d, " ".join(words)))
    want = brute.near_duplicates(rows, 2)
    assert digest(near_dedup.near_duplicates(table(spark, rows), 2).collect()) == want
    assert len({v[1] for v in want.values()}) > 3


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    one, two = np.unique(pool[:1500]), np.unique(pool[500:])
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    a, b = near_dedup.superminhash([one, two], 1024)
    assert abs((a == b).mean() - true) < 0.05
    together = near_dedup.superminhash([one, np.zeros(0, np.uint64), two[:3]], 64)
    assert (together[0] == near_dedup.superminhash([one], 64)[0]).all() and (together[1] == np.iinfo(np.uint64).max).all()


def test_decontamination(spark):
    rows = corpus()
    by_id = dict(rows)
    long = [t for t in by_id.values() if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[5:18])) for i, t in enumerate(long[:6])]
    items += [(20, "one two"), (21, "W7"), (22, None), (23, "!!"), (24, " ".join(long[0].split()[3:10])), (25, "no such words at all here"), (20, "one two")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    from pyspark.sql import functions as F

    got = decontamination.benchmark_hits(table(spark, rows), bench)
    told = got.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), F.col("n_hit") > 0)
    want = brute.benchmark_hits(rows, items)
    assert digest(told.collect()) == want
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    for r in got.where("n_hit > 0").collect():
        assert sum(b - a for a, b in r.spans) == r.n_hit
        assert all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [*corpus(60), (60, "long " * 3000), (60, "twice"), (None, "<|endoftext|> it's 12 !?\n\n  x")]
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = sorted(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    for length in (64, 2048):
        got = packing.pack(table(spark, rows), P.path("byte_bpe_50k.json"), length).toPandas()
        rest = {}
        for d, t in rows:
            rest.setdefault(d, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
        assert got.length.sum() == sum(len(x) // 4 for x in ids)
        for d, all_ids in rest.items():
            mine = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
            assert mine.length.sum() == sum(map(len, all_ids))
            for r in mine.itertuples():
                fit = [x for x in all_ids if len(x) == r.doc_tokens]
                assert any(zlib.crc32(x[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32 for x in fit)
        filled = got.groupby("sequence_id").agg(size=("length", "sum"), first=("offset", "min"))
        assert list(filled.index) == list(range(len(filled))) and (filled["first"] == 0).all() and (filled["size"] <= length).all()
        assert (filled["size"] < length).sum() <= 1
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()


def test_ids_are_the_tokenizers_own():
    """On random strings of letters, marks, spaces, controls and added tokens."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    loaded, encode = Tokenizer.from_file(path), packing.ids_of(path)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|", "|>", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2028", "\u3000", "\x00", "\x1c", "\x85", "é", "e\u0301", "ß", "中文", "😀", "०१", "²", "½", "_", "-", "12", "9", "a", "The", " the", "x" * 40, "ﬁ", "\u200b", "ي", "א"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert encode(text) == loaded.encode(text, add_special_tokens=False).ids, repr(text)


def test_sequences_follow_the_curve(spark):
    """Whole sequences and remainders are numbered in the order of the documents' keys on the curve."""
    P = pytest.importorskip("public_tokenizers")
    rows = [(d, t) for d, t in corpus(80, seed=5) if t] + [(500 + i, f"w{i} " * 300) for i in range(5)]
    key = {}
    for d, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        key[d] = int(packing.curve_keys(data, np.array([0, len(data)]))[0])
    got = packing.pack(table(spark, rows).repartition(4), P.path("byte_bpe_50k.json"), 64).toPandas()
    whole = got[got.length == 64].sort_values(["sequence_id"])
    whole = whole[(whole.offset == 0) & (whole.start % 64 == 0)]
    rest = got[(got.start + got.length == got.doc_tokens) & (got.doc_tokens % 64 > 0)].sort_values(["sequence_id", "offset"])
    for part in (whole, rest):
        keys = [key[d] for d in part.doc_id]
        assert keys == sorted(keys) and len(set(keys)) > 3


def test_added_tokens_as_the_tokenizer_is_loaded(spark, tmp_path):
    """op4's ids against the library's own, whose added token is one id wherever a text holds it."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from ledgerwise.llm import queries

    loaded = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"  {end}  \n x {end}\n\n", f"é {end[:-1]} {end} it's", "plain text  here \n", None, "", f"<|{end}|>", f"{'word ' * 3000}{end} {'more ' * 3000}"]
    want = {d: np.array([*loaded.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in enumerate(texts)}
    assert want[0].tolist() == [64, 50256, 65, 1]
    table(spark, enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_packing(spark, str(tmp_path)).collect()
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_hilbert_keys_are_a_walk():
    """Along the curve, neighbours differ by one cell in one dimension, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        order = np.argsort(key)
        assert (key[order] == np.arange(len(cells))).all()
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_language_id(spark):
    rng = random.Random(5)
    words = {"aa": ["bana", "kolo", "mira"], "bb": ["strutz", "gern", "weiss"], "cc": ["ouiè", "éaux", "leche"], "dd": ["xyqa", "zzy", "qoph"], "ee": ["ulu", "umu", "unu"], "ff": ["tik", "tok", "tak"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 40))), k) for i, k in enumerate(rng.choices(sorted(words), k=300))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 + 3 !", "aa"), (903, "bana kolo", None), (None, "gern weiss", "bb"), (904, "ulu " * 30000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(docs, keep=("score",)).withColumnRenamed("score", "s").collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows[:300]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert got[d].lang_pred == lang
    assert [got[d].lang_pred for d in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "aa", "bb", "ee"]


def test_language_id_equals_plain_python(spark):
    """Training and decoding, written out letter by letter."""
    import math

    rng = random.Random(15)
    words = {"aa": ["bana", "kolo", "mira"], "bb": ["strutz", "gern", "bana"], "cc": ["ouiè", "éaux", "mira"], "dd": ["xyqa", "kolo", "qoph"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(1, 9))) + rng.choice(["", ".", " 12 "]), k) for i, k in enumerate(rng.choices(sorted(words), k=120))]
    rows += [(300, "Zzyzx " * 12, None), (301, "a", None), (302, "bana bana", "aa"), (302, "bana bana", "aa"), (303, "быстрая лиса прыгает", None), (304, "éa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def cells(text):
        raw = [32, 32, *(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())]
        out = []
        for x in zip(raw, raw[1:], raw[2:], strict=False):
            code = x[0] << 16 | x[1] << 8 | x[2]
            mixed = (code * 0x9E3779B1 & 0xFFFFFFFF) ^ (code >> 7)
            out += [(mixed * 0x85EBCA6B & 0xFFFFFFFF) >> 16] if code != 0x202020 else []
        return out

    names, cellcount = sorted(words), language_id.CELLS
    counts = {k: {} for k in names}
    for d, t, k in rows:
        if k and zlib.crc32(str(d).encode()) % 5:
            for c in cells(t):
                counts[k][c] = counts[k].get(c, 0) + 1
    total = {k: sum(counts[k].values()) + language_id.SMOOTHING * cellcount for k in names}
    share = lambda k, c: (counts[k].get(c, 0) + language_id.SMOOTHING) / total[k]
    bits = [[-1 if n == 0 else 1 if (b >> (2 - (n - 1))) & 1 else -1 for n in range(4)] for b in range(1, 8)]
    every = sorted({c for k in names for c in counts[k]})

    def side(bit, s, c):
        got = [share(k, c) for k, x in zip(names, bit, strict=True) if x == s]
        return sum(got) / len(got)

    def scale(bit):
        known = sum((side(bit, 1, c) - side(bit, -1, c)) * math.log(side(bit, 1, c) / side(bit, -1, c)) for c in every)
        one, zero = side(bit, 1, -1), side(bit, -1, -1)
        return (known + (cellcount - len(every)) * (one - zero) * math.log(one / zero)) / 2

    scales = [scale(b) for b in bits]
    for r in language_id.identify(docs).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        got = cells(text)
        margin = [sum(math.log(side(b, 1, c) / side(b, -1, c)) for c in got) / len(got) / s for b, s in zip(bits, scales, strict=True)]
        loss = {k: sum(math.log1p(math.exp(-language_id.STEEPNESS * m * b[n])) * s for m, b, s in zip(margin, bits, scales, strict=True)) / sum(scales) * 7 for n, k in enumerate(names)}
        best = min(names, key=lambda k: loss[k])
        chance = {k: math.exp(-loss[k]) / sum(math.exp(-x) for x in loss.values()) for k in names}
        second = sorted(chance.values())[-2]
        known = sum(c in counts[best] for c in got) / len(got)
        assert r.lang_pred == best and abs(r.score - chance[best]) < 1e-4
        assert abs(second - 0.5 * chance[best]) < 1e-3 or r.ambiguous == (second > 0.5 * chance[best])
        assert r.foreign == (len(got) >= 20 and known < 0.3)


def test_codewords_differ():
    for n in (1, 2, 3, 4, 5, 6, 20):
        code = language_id.codewords(n)
        assert len(code) == n and len({tuple(x) for x in code}) == n


def test_trigrams_stay_in_their_text():
    data = np.frombuffer("ab".encode() + "cd".encode(), np.uint8)
    one = language_id._trigrams(data, np.array([0, 2, 4]))[0]
    two = language_id._trigrams(data[2:], np.array([0, 2]))[0]
    assert (one[2:] == two).all()


def thue_morse(n, a="a", b="b"):
    """Two words on which every sum of letter values times powers of an odd number agrees modulo 2**64."""
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return "".join(np.where(bits, b, a)), "".join(np.where(bits, a, b))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_alike_to_polynomial_hashes(spark, size):
    from pyspark.sql import functions as F

    one, two = thue_morse(size)
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two), (5, f"{one} {two}"), (6, f"{two} {one}")]
    got = substring_dedup.cut_repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256))
    assert digest(got.collect()) == brute.cut_repeats(rows)
    assert digest(near_dedup.near_duplicates(table(spark, rows), 2).collect()) == brute.near_duplicates(rows, 2)


def test_window_hashes_tell_word_orders_apart():
    a, b = thue_morse(2048, "a ", "b ")
    data = np.frombuffer((a + b).encode(), np.uint8)
    for which in (0, 1):
        words = Words(data, np.array([0, len(a), len(data)]), NOT_SPACE)
        for k in (1, 2, 3, 13, 1024, 2048):
            at, found = words.windows(words.hashes(which), k, which)
            seen = {}
            for i, h in zip(at.tolist(), found.tolist(), strict=True):
                assert seen.setdefault(h, (a + b).split()[i : i + k]) == (a + b).split()[i : i + k]
            assert len(at) == 2 * (2048 - k + 1)


def test_negative_ids_remove_from_larger_ones(spark):
    """Among documents of one lot and across lots, negative ids are ids as any other."""
    rows = [(-5, "a b c d"), (-3, "x a b c d"), (-1, "a b c"), (4, "b c d"), (-7, "q r s")]
    want = {-5: 0, -3: 4, -1: 3, 4: 3, -7: 0}
    for parts in (1, 5):
        got = substring_dedup.cut_repeats(table(spark, rows).repartition(parts), 3).collect()
        assert {r.doc_id: r.n_removed for r in got} == want


def test_long_sets_are_signed_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5000, 3, 0, 900)]
    whole = near_dedup.superminhash(sets)
    monkeypatch.setattr(near_dedup, "CHUNK", 700)
    assert (near_dedup.superminhash(sets) == whole).all()


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    words = list({"".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(5000)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = Words(LOWER[data], np.array([0, len(data)]), NOT_SPACE)
    assert len(set(found.hashes().tolist())) == len(words) == len(found.start)
    twice = np.concatenate([data, [np.uint8(32)], data])
    both = Words(twice, np.array([0, len(twice)]), NOT_SPACE).hashes()
    assert (both[: len(words)] == both[len(words) :]).all()


def test_empty_tables(spark):
    empty = table(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert substring_dedup.cut_repeats(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert decontamination.benchmark_hits(empty, items).count() == 0
    some = table(spark, [(1, "a b c")])
    assert [r.n_hit for r in decontamination.benchmark_hits(some, items.limit(0)).collect()] == [0]
    docs = empty.withColumnRenamed("id", "lang")
    assert language_id.identify(docs).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
