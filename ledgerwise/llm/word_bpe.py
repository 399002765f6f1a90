"""Word-wise BPE by a trie of distinct words whose nodes hold the last token of their prefix's encoding.

The merges of BPE never undo one another, so a run of tokens is the encoding of its string exactly if every two
neighbours are the encoding of theirs. The encoding of a prefix therefore ends in the one token that fits behind
the encoding of what is before it, and a node of the trie needs no more than that token and the ancestor where it
begins. Nodes are visited depth-first; words with a common beginning share its nodes, so it is encoded once.
Candidates, the tokens that end at a node, come from an automaton over the vocabulary whose steps are made as needed.

A task keeps its trie, and what each piece between blanks is encoded as, until they reach a fixed size and are begun anew.
So only pieces that are new to it go through normalisation, split and trie; every occurrence in a text is a lookup.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import lean, text_slices

#: Pieces, their bytes and nodes of the trie that a task remembers, and bytes of text between two looks at how many there are.
PIECES, PIECE_BYTES, NODES, STEP = 150_000, 8 << 20, 350_000, 1 << 19
#: Symbols down to which nodes are kept; what longer words have in common beyond is rarely met again.
DEEP = 64
#: Normalisation and split of the tokenizer files that this module reads. Fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Added to the code of a word's last symbol, which makes it the symbol with the word's end.
END = 0x1000
#: Code points below this one are composed and lowered, letters and digits alike in all versions of Unicode.
SETTLED = 0x250
#: Bytes as the characters that stand for them in the file. Fixed values.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = str.maketrans({b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))})


#: A rank above all merges'.
NEVER = 1 << 40
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Vocabulary:
    """A tokenizer file's tokens as strings of symbols, which tokens may follow each other, and the automaton of their ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, self.suffix = found["model"], found["model"]["end_of_word_suffix"]
        steps = found["pre_tokenizer"].get("pretokenizers", [{}])
        if (found["normalizer"] or {}).get("normalizers") != NORMALIZERS or steps[0].get("pattern") != {"Regex": PATTERN} or not self.suffix or found["decoder"] or model["dropout"]:
            raise ValueError(f"not a tokenizer of lower-cased words with a mark at their end: {path}")
        if any(x[flag] for x in found["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their neighbours aren't known here")
        self.added = {x["content"].encode(): x["id"] for x in found["added_tokens"]}
        ids = model["vocab"]
        self.text = {i: self.symbols(name) for name, i in ids.items()}
        self.ids = {text: i for i, text in self.text.items()}
        self.sizes = {i: len(text) for i, text in self.text.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.made = {token: (rank, *pair) for pair, (rank, token) in self.merges.items()}
        if len(self.made) < len(self.merges):
            raise ValueError("a token that is made in two ways")
        self.begun = {"": 0}  # the automaton's states are beginnings of tokens, by number
        for text in self.ids:
            for k in range(1, len(text) + 1):
                self.begun.setdefault(text[:k], len(self.begun))
        self.states = list(self.begun)
        if not all(chr(ord(c) + more) in self.ids for c in SHOWN.values() for more in (0, END)):
            raise ValueError("a byte without a token")
        self.next, self.ends, self.follows, self.edges = {}, [None] * len(self.states), {}, {}

    def symbols(self, name: str) -> str:
        """A token as written in the file -> one character for each symbol."""
        if len(name) > len(self.suffix) and name.endswith(self.suffix):
            name = name[: -len(self.suffix)]
            return name[:-1] + chr(ord(name[-1]) + END)
        return name

    def merged(self, text: str) -> list[int]:
        """Encoding of a short string by merging: the pair of lowest rank first, of these the leftmost."""
        ids = [self.ids[c] for c in text]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (len(self.merges),))[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == len(self.merges):
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def fits(self, before: int, token: int) -> bool:
        """Do these two tokens stay as they are when they meet?

        They don't if two tokens that touch at some time merge, before either is taken into a larger one of its own side.
        """
        if len(self.follows) >= 1 << 19:
            self.follows.clear()
        left, right = self.edge(before, 2), self.edge(token, 1)
        i = j = 0
        found = True
        while found:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.merges.get((x, y), (NEVER,))[0]
            found = not (rank < until_x and rank <= until_y)  # of equal ranks, the one further left goes first
            if until_x == until_y == NEVER:
                break
            i, j = (i + 1, j) if until_x <= until_y else (i, j + 1)
        self.follows[before << 32 | token] = found
        return found

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that ends it) of what lies at a token's left (1) or right (2) edge while it is made."""
        key = token << 2 | side
        found = self.edges.get(key)
        if found is None:
            found, rank = [], NEVER
            while True:
                found.append((token, rank))
                if token not in self.made:
                    break
                rank, token = self.made[token][0], self.made[token][side]
            found.reverse()
            self.edges[key] = found
        return found

    def step(self, state: int, symbol: str) -> int:
        """The state of the longest beginning of a token that a state and one more symbol end in."""
        text = self.states[state] + symbol
        while text not in self.begun:
            text = text[1:]
        found = self.next[state << 16 | ord(symbol)] = self.begun[text]
        return found

    def ending(self, state: int) -> list[tuple[int, int]]:
        """(token, symbols) of all tokens that this state ends in and that encode themselves, the longest first."""
        text = self.states[state]
        tails = (text[k:] for k in range(len(text)))
        found = self.ends[state] = [(self.ids[t], len(t)) for t in tails if t in self.ids and self.merged(t) == [self.ids[t]]]
        return found


class Trie:
    """Words' beginnings as nodes, each with its symbol's edge from its parent, the automaton's state and the last token there."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child, self.state, self.last = {}, [0], [-1]  # the root is node 0

    def encode(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Inserts distinct words and gives their tokens.

        In sorted order, words are met depth-first: the path down to where a word leaves the one before stands. New
        nodes get their last token from those above; nodes deeper than DEEP aren't found again by later words.
        """
        known = self.vocabulary
        step, steps, ends, ending, follows, sizes = known.step, known.next.get, known.ends, known.ending, known.follows.get, known.sizes
        child, child_of, states, lasts = self.child, self.child.get, self.state, self.last
        out, before, path = {}, "", [0]  # path: nodes from the root to here
        for word in sorted(words):
            del path[_common(before, word) + 1 :]
            node = path[-1]
            for symbol in word[len(path) - 1 :]:
                below = child_of(node << 16 | ord(symbol))
                if below is None:  # and none below it
                    break
                node = below
                path.append(node)
            state = states[node]
            for symbol in word[len(path) - 1 :]:
                code = ord(symbol)
                at = steps(state << 16 | code)
                state = step(state, symbol) if at is None else at
                for token, size in ends[state] or ending(state):
                    start = lasts[path[-size]]  # the last token of what is before this one
                    if start < 0:
                        break
                    fits = follows(start << 32 | token)
                    if fits or (fits is None and known.fits(start, token)):
                        break
                else:
                    raise AssertionError("no token fits here")
                below = len(states)
                states.append(state)
                lasts.append(token)
                if len(path) <= DEEP:
                    child[node << 16 | code] = below
                node = below
                path.append(node)
            ids, at = [], len(path) - 1
            while at:
                token = lasts[path[at]]
                ids.append(token)
                at -= sizes[token]
            out[word] = tuple(ids[::-1])
            before = word
        return out


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # a[:lo] is common
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[lo:mid], lo) else (lo, mid - 1)
    return lo


class Encoder:
    """Texts to ids. It remembers the trie, words and pieces between blanks that it has met, until there are too many."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary, self.library = Vocabulary(path), Tokenizer.from_file(path)
        self.last = {c: chr(ord(c) + END) for c in SHOWN.values()}
        self.split = regex.compile(PATTERN).findall
        self.unsettled = re.compile(f"[^\x00-{chr(SETTLED - 1)}]").search
        self.blank = re.compile(rb"[ \t-\r]").search
        added = sorted(self.vocabulary.added, key=lambda x: (-len(x), x))
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, added)) + b")").split if added else (lambda x: [x])
        self.forget()

    def forget(self, everything: bool = True) -> None:
        """Begins pieces anew; words that were met since the last time are kept once more, unless everything goes."""
        self.known, self.size = {}, 0
        self.older, self.encoded = ({} if everything else self.encoded), {}
        if everything or len(self.trie.last) > NODES:
            self.vocabulary.next.clear()
            self.trie = Trie(self.vocabulary)
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, segment: bytes) -> list[str]:
        """Normalised and split words, as strings of bytes' characters."""
        letters = segment.rstrip(PUNCTUATION)
        if letters.isalpha():  # A-Z and a-z alone, then punctuation: two matches of the pattern
            text = segment.lower().decode()
            return [text[: len(letters)], text[len(letters) :]] if len(letters) < len(segment) else [text]
        text = segment.decode("utf-8", "replace")
        if self.unsettled(text):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        found = self.split(text.lower())
        return found if text.isascii() and text.isprintable() else [w.encode().decode("latin-1").translate(SHOWN) for w in found]

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces; their distinct new words go into the trie."""
        added, encoded, older, last, words = self.vocabulary.added, self.encoded, self.older, self.last, self.words
        # pieces of A-Z and a-z alone are a word each and are lowered together, unless they hold an added token
        plain = [piece for piece in pieces if piece.isalpha()]
        if whole := len(self.cut(b" ".join(pieces))) == 1:
            others = [piece for piece in pieces if not piece.isalpha()]
            parts = list(map(words, others))
        else:
            plain = [piece for piece in plain if len(self.cut(piece)) == 1]
            others = list(set(pieces).difference(plain))
            parts = [[w for x in self.cut(piece) for w in ([added[x]] if x in added else words(x))] for piece in others]
        alone = b" ".join(plain).lower().decode().split(" ") if plain else []
        new = {w for w in set(alone).union(*parts).difference(encoded) if isinstance(w, str)}
        seen = [w for w in new if w in older]
        encoded.update(zip(seen, map(older.__getitem__, seen), strict=True))
        new.difference_update(seen)
        shown = [w[:-1] + last[w[-1]] for w in new]
        encoded.update(zip(new, map(self.trie.encode(shown).__getitem__, shown), strict=True))
        ids = list(map(encoded.__getitem__, alone))
        if whole:
            ids += [encoded[part[0]] if len(part) == 1 else [i for w in part for i in encoded[w]] for part in parts]
        else:
            ids += [[i for w in part for i in (encoded[w] if isinstance(w, str) else (w,))] for part in parts]
        pieces = plain + others
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.size += sum(map(len, pieces))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        split = [text.split() for text in texts]
        if len(self.known) > PIECES or self.size > PIECE_BYTES or len(self.trie.last) > 2 * NODES:
            self.forget(everything=False)
        if new := set().union(*split).difference(self.known):
            self.learn(list(new))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        counts = self.counts[which]
        ends = np.cumsum(counts)
        place = np.repeat(self.starts[which] - ends + counts, counts) + np.arange(counts.sum())
        first = np.cumsum([0, *map(len, split)])
        return self.flat[place], np.diff(np.concatenate([[0], ends])[first])

    def encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text, some bytes at a time. No rule reaches over a blank, so steps end at blanks."""
        out, at = [np.zeros(0, np.int32)], 0
        while at < len(text):
            blank = self.blank(text, at + STEP)
            to = blank.start() if blank else len(text)
            out.append(self.encode([text[at:to]])[0])
            at = to
        return np.concatenate(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                if hi - lo == 1:
                    ids = code.encode_long(data.tobytes())
                    counts = np.array([len(ids)])
                else:
                    ids, counts = code.encode([data[a:z].tobytes() for a, z in zip(offsets, offsets[1:], strict=False)])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                out = [batch.column(0).slice(lo, hi - lo), listed, *(c.slice(lo, hi - lo) for c in batch.columns[2:])]
                yield pa.record_batch(out, [f"_{i}" for i in range(len(out))])
        code.forget()

    return lean(task)


@cache
def token_names(path: str) -> pa.Array:
    """The tokens' strings by id."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    ids = found["model"]["vocab"] | {x["content"]: x["id"] for x in found["added_tokens"]}
    of = {i: name for name, i in ids.items()}
    return pa.array([of.get(i) for i in range(max(of) + 1)])


def _decode_task(path: str, names: list[str], step: int = 1 << 18):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = token_names(path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + step, "right")))
                ids = batch.column(0).slice(at, to - at)
                flat = ids.flatten()
                known = flat.filter(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(shown))))
                if len(known) < len(flat):
                    raise ValueError("an id that isn't in the vocabulary")
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                words = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), shown.take(flat).cast(pa.large_string()))
                text = pc.if_else(ids.is_valid(), pc.binary_join(words, pa.scalar(" ", pa.large_string())), None).cast(pa.string())
                yield pa.record_batch([text, *(c.slice(at, to - at) for c in batch.columns[1:])], names)
                at = to

    return lean(task)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """documents -> (doc_id, ids, columns of `keep`), a row for each row.

    ids is what the tokenizers library gives for the text with this file, without special tokens around it; strings of
    added tokens in a text are those tokens. Every executor has the file at this path. A null text is an empty one: no
    ids. Repeated rows, and null or repeated ids, are encoded row by row; equal texts get equal ids. An empty table gives
    no rows. Columns not in `keep` are ignored, whatever they are called. Texts of any length are encoded whole: one is
    held at a time, with its ids, and cut for work at blanks alone, where no token reaches over. What a task remembers
    is bounded and changes no result.
    """
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)))
    kinds = [f.dataType.simpleString() for f in taken.schema]
    kinds = [kinds[0], "array<int>", *kinds[2:]]
    return taken.mapInArrow(_encode_task(tokenizer), ", ".join(f"_{i} {kind}" for i, kind in enumerate(kinds))).toDF("doc_id", "ids", *keep)


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """All columns and `to_col`: the tokens' strings as the file has them, with one blank between, as its decoder gives them.

    Null ids give null, no ids an empty string; an id that the file doesn't have is an error. A column that is
    called `to_col` already is replaced.
    """
    others = [c for c in tokens.columns if c != to_col]
    taken = tokens.select(F.col(ids_col).cast("array<int>").alias("_ids"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(others)))
    schema = ", ".join(["_text string", *(f"_c{i} {tokens.schema[c].dataType.simpleString()}" for i, c in enumerate(others))])
    found = taken.mapInArrow(_decode_task(tokenizer, ["_text", *(f"_c{i}" for i in range(len(others)))]), schema)
    return found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(others)), F.col("_text").alias(to_col))
