"""Language ID with error-correcting output codes over binary n-gram classifiers.

Each language has a codeword. Bit b has a classifier that tells the languages with a one from those with
a zero: hashed letter trigrams weigh the log ratio of their smoothed frequencies in the two groups. Trigram
counts come from all labelled documents, summed per task and language; the model has a fixed number of
rows. A text's margin per bit is its mean weight, in units of the margin expected of such texts. Decoding
takes the codeword with the least loss, each bit weighted by how well its groups can be told apart, and
flags a text as ambiguous when the second codeword is almost as near. The decoded language must also know
the text: `known` is the part of its trigrams that this language's training texts have. A language that
nobody taught has few of them, whatever codeword comes nearest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import LOWER, lean, text_slices

CELLS, BLOCK = 1 << 16, 1 << 12
SMOOTHING, STEEPNESS = 0.5, 3.0
#: A text is ambiguous if the second-best codeword gets more than this part of the best one's probability.
AMBIGUOUS = 0.5
UNKNOWN = "und"
#: A text with at least so many trigrams, of which the decoded language knows less than this part, is in none of the languages.
FOREIGN_GRAMS, FOREIGN_SHARE = 20, 0.3

#: Letters of any script (bytes from 0x80 are parts of other letters) as lower case, all else a space.
_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER], np.uint8)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, counts) for each byte: the trigram that ends there, within its text; three spaces don't count."""
    this = _LETTER[data]
    one, two = np.full(len(data), 32, np.uint8), np.full(len(data), 32, np.uint8)
    one[1:], two[2:] = this[:-1], this[:-2]
    begin = offsets[:-1][np.diff(offsets) > 0]
    one[begin] = two[begin] = 32
    second = offsets[:-1][np.diff(offsets) > 1] + 1
    two[second] = 32
    code = two.astype(np.uint32) << np.uint32(16) | one.astype(np.uint32) << np.uint32(8) | this
    mixed = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(7))
    return ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64), code != 0x202020


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, hi, data, offsets in text_slices(batch.column(0)):
            cell, real = _trigrams(data, offsets)
            lang_of = np.repeat(np.arange(hi - lo), np.diff(offsets))
            for lang in set(langs[lo:hi]):
                mine = (langs[lo:hi] == lang)[lang_of] & real
                held[lang] = held.get(lang, 0) + np.bincount(cell[mine], minlength=CELLS)
    for lang, counts in held.items():
        blocks = range(CELLS // BLOCK)
        packed = [counts[b * BLOCK : (b + 1) * BLOCK].astype(np.int64).tobytes() for b in blocks]
        yield pa.record_batch([pa.array([lang] * len(packed)), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["lang", "block", "counts"])


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[lang, block] = held.get((lang, block), 0) + np.frombuffer(counts, np.int64)
    for (lang, block), counts in held.items():
        yield pa.record_batch([pa.array([lang]), pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["lang", "block", "counts"])


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of up to five classes, else the widest apart of 200 fixed random codes."""
    if n <= 5:
        return np.array([[-1, *rest] for rest in itertools.product([-1, 1], repeat=n - 1)][1:], np.int8).T.reshape(n, -1)
    bits, best, apart = max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        gaps = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * bits
        if (np.abs(code.sum(axis=0)) < n).all() and gaps.min() > apart:
            best, apart = code, gaps.min()
    return best


class Model:
    """languages, their codewords, and for each bit a weight per cell, the margin's scale and the bit's weight."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages)) if self.languages else np.zeros((0, 0), np.int8)
        share = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * CELLS) for x in self.languages])
        weights, scales = [], []
        for bit in range(self.code.shape[1]):
            one, zero = (share[self.code[:, bit] == side].mean(axis=0) for side in (1, -1))
            ratio = np.log(one) - np.log(zero)
            weights.append(ratio.astype(np.float32))
            scales.append(((one - zero) * ratio).sum() / 2)
        self.weights = np.array(weights, np.float32).reshape(-1, CELLS)
        self.scales = np.maximum(np.array(scales), 1e-9)
        self.seen = np.array([counts[x] > 0 for x in self.languages]).reshape(-1, CELLS)
        self.trust = self.scales / self.scales.sum() * len(scales) if scales else np.zeros(0)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cell, real = _trigrams(data, offsets)
        seen = np.concatenate([[0], np.cumsum(real)])[offsets]
        cell, n = cell[real], np.maximum(np.diff(seen), 1)
        out = np.zeros((len(n), len(self.weights)))
        for bit, weight in enumerate(self.weights):
            total = np.concatenate([[0.0], np.cumsum(weight[cell], dtype=np.float64)])
            out[:, bit] = np.diff(total[seen]) / n / self.scales[bit]
        return out

    def familiar(self, data: np.ndarray, offsets: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, part of them that the language has) of each row; 1 for a row without any."""
        cell, real = _trigrams(data, offsets)
        hit = self.seen[np.repeat(best, np.diff(offsets)), cell] & real
        n, k = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (real, hit))
        return n, np.divide(k, n, out=np.ones(len(n)), where=n > 0)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, probability, ambiguous) of each row. Ties go to the first language by name."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
        loss = np.logaddexp(0, -STEEPNESS * margins[:, None, :] * self.code[None, :, :]) @ self.trust
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        top = np.sort(chance, axis=1)
        return best, top[:, -1], top[:, -2] > AMBIGUOUS * top[:, -1]


def train(labelled: DataFrame) -> Model:
    """labelled(text, lang): counts over all rows with a language; nothing is sampled."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    parts = rows.mapInArrow(lean(_count_task), "lang string, block int, counts binary")
    merged = parts.repartition("lang", "block").mapInArrow(lean(_sum_task), "lang string, block int, counts binary")
    counts: dict[str, np.ndarray] = {}
    for got in merged.toLocalIterator():  # CELLS counts for each language
        counts.setdefault(got["lang"], np.zeros(CELLS))[got["block"] * BLOCK : (got["block"] + 1) * BLOCK] = np.frombuffer(got["counts"], np.int64)
    return Model(counts)


def _predict_task(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                n = hi - lo
                known = letters[lo:hi]
                if found.languages:
                    best, chance, unsure = found.decode(found.margins(data, offsets))
                    grams, part = found.familiar(data, offsets, best)
                    foreign = (grams >= FOREIGN_GRAMS) & (part < FOREIGN_SHARE) & known
                else:
                    best, chance, unsure, known, foreign = np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
                names = [found.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(names, pa.string()), pa.array(np.where(known, chance, 0.0)), pa.array(unsure & known), pa.array(foreign), *(x.slice(lo, n) for x in batch.columns[4:])],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "foreign", *(f"keep{i}" for i in range(batch.num_columns - 4))])

    return lean(task)


def held_out(doc_id: Column) -> Column:
    """True for the documents, a fifth of all, that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame, train_on: Column | None = None, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), letter: str | None = None) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score, ambiguous, foreign, *keep), a row for each row.

    Learns from text and lang of the rows where train_on holds (default: not held_out) and lang isn't
    null; predicts from the text alone. A null text, or one without a letter, is `und` with score 0, and
    so is every text if there is nothing to learn from. With one language that is the answer, score 1.
    foreign: the decoded language doesn't know the text (see above); lang_pred is the nearest one nonetheless.
    Very long texts are read whole. A null id counts as held out. Repeated rows are rows as any other, in training
    too. An empty table gives an empty one. Columns named in keep are handed on; others are ignored.
    letter: name of one more column, true for texts with a letter whatever their label is.
    """
    train_on = ~held_out(F.col(id_col)) if train_on is None else train_on
    if model is None:
        model = train(docs.where(train_on).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    known = docs.sparkSession.sparkContext.broadcast(model)  # CELLS weights for each bit
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kept = {c: F.col(c) for c in keep} | ({letter: has_letter} if letter else {})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"), has_letter.alias("letter"), *(c.alias(f"keep{i}") for i, c in enumerate(kept.values())))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = "".join(f", keep{i} {rows.schema[f'keep{i}'].dataType.simpleString()}" for i in range(len(kept)))
    out = rows.mapInArrow(_predict_task(known), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean, foreign boolean{more}")
    return out.withColumnsRenamed({f"keep{i}": c for i, c in enumerate(kept)})
