"""Fill-in-the-middle, divergence of sources and word BPE against plain Python and the tokenizers library."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import divergence, fill_middle, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, ids string, n int, term string, _k0 string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, "x", 1, None, "kept") for d, t, lang, s in rows], SCHEMA)


def texts(spark, rows):
    return table(spark, [(d, t, "en", "a") for d, t in rows])


def test_checkpoints():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["\n", "a", "é", "你", "\U0001f600", "\r", "bc"], k=rng.randint(0, 60)))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        for every, block in ((1, 1), (3, 7), (256, 1 << 20)):
            marks = fill_middle.Checkpoints(text.encode(), every, block)
            assert marks.n == len(lines)
            assert len(marks.lines) == 1 + text.count("\n") // every
            for line in range(len(lines) + 1):
                before = "".join(lines[:line])
                assert marks.offsets(line) == (len(before.encode()), len(before))


def filled(doc_id, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:z]), "".join(lines[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(2)
    rows = [(None, "a\nb\nc"), (None, None), (1, None), (2, ""), (3, "\n"), (4, "x<M>y\nz"), (5, "<\n<P\nP>\n"), (6, "no end"), (6, "no end"), (6, "other\ntext\n"), (7, "\r\n\r\n\x00\n")]
    rows += [(d, "".join(rng.choices(["\n", "one ", "é", "你", "<", "S>"], k=rng.randint(1, 90)))) for d in range(8, 150)]
    rows.append((150, "line é\n" * 300_000))
    rows.append((151, "no line end " * 300_000))
    for fim, spm in ((100, 50), (40, 80)):
        got = fill_middle.fill_in_middle(texts(spark, rows).repartition(3), fim_percent=fim, spm_percent=spm, every=16, keep=("ids", "n"))
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "ids", "n"]
        got = got.toDF("doc_id", "n", "form", "p", "m", "output", "other", "one").withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        key = lambda x: (str(x[0]), *map(str, x[1:]))
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *filled(d, t, fim, spm)) for d, t in rows), key=key)
        assert Counter(r["restored"] for r in got) == Counter(t or "" for _, t in rows)
        assert {(r["other"], r["one"]) for r in got} == {("x", 1)}
    assert fill_middle.fill_in_middle(texts(spark, [])).count() == 0
    for markers in (("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(texts(spark, []), markers=markers)


def audited(rows, min_docs, top):
    term = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(term(text)))
        counts[lang, source].update(term(text))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:last], 1)}
    return out


def test_divergence(spark):
    rng = random.Random(4)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "É", "NASA", "nasa", "é", "Ünder"]
    rows = []
    for d in range(500):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "c", "é", None])
        words = rng.choices(vocab, weights=[1 / (1 + (i + len(source or "")) % 30) for i in range(len(vocab))], k=rng.randint(0, 30))
        rows.append((rng.choice([d, None, 1]), rng.choice([" ", "1", "\n", "_"]).join(words), lang, source))
    rows += [(1, None, "fr", "a"), (2, "", "fr", "b"), (3, "rare", "fr", "c"), (4, None, "it", "only"), (5, "wa " * 400_000, "en", "long"), (6, "12 34", "en", "digits")]
    for min_docs, top in ((5, 50), (40, 3), (10**6, 50)):
        got = divergence.audit(table(spark, rows).repartition(4), min_docs, top).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == audited(rows, min_docs, top)
    assert divergence.audit(table(spark, [])).count() == 0


def test_counts_in_parts(spark):
    """Tasks that hold few entries hand on more rows, with the same sums."""
    rows = table(spark, [(i, "a b c a " * (1 + i % 3), "en", f"s{i % 4}") for i in range(40)])
    few, many = (sorted(divergence.term_counts(rows, held).collect()) for held in (1, 1000))
    assert few == many and len(few) == 12


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(WORD_BPE)
    return found


def odd_texts(n=3000, seed=5):
    rng = random.Random(seed)
    parts = ["the", "ing", "'s", "'", "İ", "ß", "Σ", "é", "é", "̇", "1", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", " ", "　", "你", "가", "\U0001f600", "‍", "_", "...", "ﬁ", "Ǆ", "ŉ", "tion", "Q", "zz", "\x1f", "\x85", "\x00", "𐵐", "Ᲊ"]
    parts += [chr(c) for c in range(33, 0x250)]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(n)]


def test_word_bpe(spark):
    code = library()
    rows = list(enumerate(["", "  ", "It's the DAY'S <|endoftext|> 123, wasn't\tit?", "aaaa" * 50 + " " + "ab" * 700, "...!!!" * 40, "x" * 200_000, " " * 3_000_000, "\n a" * 300_000, *odd_texts()]))
    shown = texts(spark, [*rows, (None, None), (1, "again"), (1, "again")]).repartition(3)
    found = word_bpe.decode(word_bpe.encode(shown, WORD_BPE, keep=("n", "_k0")), WORD_BPE, to_col="text").collect()
    by_id = {r["doc_id"]: (r["ids"], r["text"]) for r in found if r["doc_id"] not in (None, 1)}
    for d, text in rows:
        if d != 1:
            want = code.encode(text, add_special_tokens=False).ids
            assert by_id[d] == (want, code.decode(want, skip_special_tokens=False)), ascii(text[:80])
    assert [(r["ids"], r["text"]) for r in found if r["doc_id"] is None] == [([], "")]
    assert sorted(len(r["ids"]) for r in found if r["doc_id"] == 1) == [0, 1, 1]
    assert {(r["n"], r["_k0"]) for r in found} == {(1, "kept")}
    assert word_bpe.encode(texts(spark, []), WORD_BPE).count() == 0


def test_decode_of_given_ids(spark):
    code = library()
    rows = [(1, [320, 49407, 0]), (2, []), (3, None)]
    got = {r["k"]: r["decoded"] for r in word_bpe.decode(spark.createDataFrame(rows, "k int, ids array<long>"), WORD_BPE).collect()}
    assert got == {1: code.decode([320, 49407, 0], skip_special_tokens=False), 2: "", 3: None}
    for wrong in (-1, 10**6):
        with pytest.raises(Exception, match="isn't in the vocabulary"):
            word_bpe.decode(spark.createDataFrame([(1, [wrong])], "k int, ids array<int>"), WORD_BPE).collect()
    with pytest.raises(Exception, match="not a tokenizer of lower-cased words"):
        word_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_pairs_of_tokens():
    """Tokens that fit are those that merging gives back."""
    known, rng = word_bpe.Vocabulary(WORD_BPE), random.Random(6)
    every = list(known.ids.values())
    body = [t for t in every if ord(known.text[t][-1]) < word_bpe.END]
    short = [t for t in body if len(known.text[t]) < 4]
    seen = set()
    for _ in range(20_000):
        a, b = rng.choice(rng.choice([body, short])), rng.choice(rng.choice([every, short]))
        fits = known.merged(known.text[a] + known.text[b]) == [a, b]
        assert known.fits(a, b) == fits
        seen.add(fits)
    assert seen == {True, False}


def test_shared_beginnings_are_encoded_once():
    known = word_bpe.Vocabulary(WORD_BPE)
    trie, asked = word_bpe.Trie(known), []
    plain = known.ending
    known.ending = lambda state: asked.append(state) or plain(state)
    end = lambda w: w[:-1] + chr(ord(w[-1]) + word_bpe.END)
    words = [end("inter" + x) for x in ("est", "ests", "ested", "esting", "nal", "nals")]
    out = trie.encode(words)
    assert len(trie.last) - 1 == len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a node for each beginning
    nodes = len(trie.last)
    assert trie.encode(words) == out and len(trie.last) == nodes
    assert out == {w: tuple(known.merged(w)) for w in words}


def test_a_full_memory_changes_nothing(monkeypatch):
    code = library()
    monkeypatch.setattr(word_bpe, "PIECES", 50)
    monkeypatch.setattr(word_bpe, "STEP", 300)
    mine = word_bpe.Encoder(WORD_BPE)
    for text in odd_texts(200, seed=8):
        assert mine.encode_long((text * 9).encode()).tolist() == code.encode(text * 9, add_special_tokens=False).ids


def test_long_words_take_linear_time():
    mine, rng = word_bpe.Encoder(WORD_BPE), random.Random(9)
    began = time.time()
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500_000))
    assert len(mine.encode_long(word.encode())) > 100_000
    assert time.time() - began < 60
    short = word[:20_000]
    assert mine.encode_long(short.encode()).tolist() == library().encode(short, add_special_tokens=False).ids


def test_pieces_are_learned_together(monkeypatch):
    """Pieces of letters alone are lowered in one step and added tokens looked for once; with them among the pieces, ids are the same."""
    mine, code = word_bpe.Encoder(WORD_BPE), library()
    cuts, cut = [], mine.cut
    monkeypatch.setattr(mine, "cut", lambda x: cuts.append(x) or cut(x))
    added = next(iter(mine.vocabulary.added)).decode()
    plain = "Alpha beta, GAMMA delta. a\x00b \x1fx don't x1y2 ÄÖ word " + " ".join(f"word{i}" for i in range(50))
    assert mine.encode_long(plain.encode()).tolist() == code.encode(plain, add_special_tokens=False).ids
    assert len(cuts) == 1
    for text in (f"New {added} Words{added}here x{added} beta", f"{added}", added * 3):
        assert mine.encode_long(text.encode()).tolist() == code.encode(text, add_special_tokens=False).ids
