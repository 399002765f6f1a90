"""Packing along a space-filling curve: neighbours on a Hilbert curve share sequences.

A document's words, hashed to signs, are projected to DIMS dimensions; the direction, in cells, gives its
place on a Hilbert curve. Documents are range-sorted by that key and laid end to end. A document's whole
sequences of `length` ids stand alone, numbered along the curve; the remainders form one stream that is
cut at every `length` ids. So only the very last sequence has padding, at most length - 1 ids in all.

Texts are tokenized once. The whole sequences' checksums are taken there and only the ids of remainders
are kept (two bytes each where the vocabulary allows), until their places are known.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textarrays import LOWER, NOT_SPACE, Words, lean, mix, text_slices

DIMS, CELL_BITS = 4, 12
#: White space in a row from which on a text is the tokenizers library's.
RUN = 1 << 14
#: Split of a text before the merges, as in the tokenizer file's byte-level step. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    """A byte-level BPE of a tokenizers file as a tiktoken encoding: the same ids, several times faster.

    Ids are the merges' ranks in such files. encode_ordinary takes strings of added tokens as text; see ids_of.
    """
    import tiktoken

    found = _file(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = added_tokens(path)
    ranks = {bytes(shown[c] for c in token): rank for token, rank in found["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@cache
def added_tokens(path: str) -> dict[str, int]:
    """The file's added tokens and their ids."""
    return {x["content"]: x["id"] for x in _file(path).get("added_tokens", [])}


def ids_of(path: str):
    """text -> ids, as the tokenizer gives them when loaded: an added token's string in a text is that token.

    Texts are split at added tokens, the longest first, and what lies between is split and merged alone. tiktoken's
    pattern overflows its stack on very long runs of white space; texts with a run of RUN go to the tokenizers library.
    """
    code, known = encoder(path), added_tokens(path)
    long_run = re.compile(r"\s{%d}" % RUN).search

    def library(text: str) -> list[int]:
        return _library(path).encode(text, add_special_tokens=False).ids

    if not known:
        return lambda text: library(text) if len(text) > RUN and long_run(text) else code.encode_ordinary(text)
    if any(x.get(flag) for x in _file(path)["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their neighbours aren't known here")
    cut = re.compile("|".join(map(re.escape, sorted(known, key=lambda x: (-len(x), x)))))

    def encode(text: str) -> list[int]:
        if len(text) > RUN and long_run(text):
            return library(text)
        ids, at = [], 0
        for found in cut.finditer(text):
            ids += code.encode_ordinary(text[at : found.start()])
            ids.append(known[found[0]])
            at = found.end()
        return ids + code.encode_ordinary(text[at:]) if at else code.encode_ordinary(text)

    return encode


def hilbert_key(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """(rows, dims) of integers below 2**bits -> each row's distance along a Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess rotations and reflections, from the coarsest level to the finest
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> bit & 1
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of the texts' hashed bags of words."""
    words = Words(LOWER[data], offsets, NOT_SPACE)
    hashes = mix(words.hashes() ^ np.uint64(0x2127599BF4325C37))
    place = np.zeros((len(words.count), DIMS))
    for dim in range(DIMS):
        sign = ((hashes >> np.uint64(7 * dim)) & np.uint64(1)).astype(np.int64) * 2 - 1
        place[:, dim] = np.diff(np.concatenate([[0], np.cumsum(sign)])[words.first])
    norm = np.linalg.norm(place, axis=1, keepdims=True)
    unit = np.divide(place, norm, out=np.zeros_like(place), where=norm > 0)
    return hilbert_key(np.minimum(((unit + 1) / 2 * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _token_task(path: str, end_id: int, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, encode = encoder(path), ids_of(path)
        kind = np.uint16 if max(code.n_vocab, end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                sizes, wholes, rests = [], [], []
                for a, z in zip(offsets, offsets[1:], strict=False):
                    ids = np.array([*encode(data[a:z].tobytes().decode("utf-8", "replace")), end_id], kind)
                    full = len(ids) // length
                    sizes.append(len(ids))
                    wholes.append([_crc(x) for x in ids[: full * length].reshape(full, length)])
                    rests.append(ids[full * length :].tobytes())
                n = hi - lo
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(curve_keys(data, offsets)), pa.array(sizes, pa.int64()), pa.array(wholes, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                    ["uid", "doc_id", "curve", "doc_tokens", "wholes", "rest"])

    return lean(task)


def _piece_task(length: int, streams: int, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, sizes, crcs, sequences, offsets = [], [], [], [], [], []
            for i, (size, wholes, rest, at, before) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for j, crc in enumerate(wholes):
                    for have, x in zip((row, starts, sizes, crcs, sequences, offsets), (i, j * length, length, crc, streams + before + j, 0), strict=True):
                        have.append(x)
                ids, start = np.frombuffer(rest, kind), len(wholes) * length
                while len(ids):
                    cut = min(len(ids), length - at % length)
                    for have, x in zip((row, starts, sizes, crcs, sequences, offsets), (i, start, cut, _crc(ids[:cut]), at // length, at % length), strict=True):
                        have.append(x)
                    ids, start, at = ids[cut:], start + cut, at + cut
            taken = pa.array(row, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(taken), long(starts), long(sizes), long(crcs), batch.column(1).take(taken), long(sequences), long(offsets)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return lean(task)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document is its text's ids by the tokenizer file, which every executor has at this path, and end_id.
    Strings of the file's added tokens in a text are those tokens, as in the tokenizer as loaded. A null text is an empty one: one id. Every id lies in exactly one piece, at `offset` of its sequence;
    sequence_id goes from 0 without gaps. Repeated rows and null or repeated ids are documents of their
    own. An empty table gives no pieces. Other columns are ignored. Texts of any length are read whole, one at
    a time; documents whose keys tie lie in the order of the table.
    """
    # the row numbers are written with the rows, so they hold whatever is read again
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tokens = written(rows.mapInArrow(_token_task(tokenizer, end_id, length), f"uid long, doc_id {kind}, curve long, doc_tokens long, wholes array<long>, rest binary"), "tokens")
    small = tokens.select("uid", "curve", (F.col("doc_tokens") % length).alias("r"), F.size("wholes").cast("long").alias("m"))
    line = written(small.repartitionByRange("curve", "uid").withColumn("part", F.spark_partition_id()), "line")
    parts = line.groupBy("part").agg(F.sum("r").alias("r"), F.sum("m").alias("m"))  # a row for each partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in "rm"), (F.col("r")).alias("total"))
    parts = written(parts, "parts")
    stream = parts.agg(F.sum("total")).first()[0] or 0
    within = Window.partitionBy("part").orderBy("curve", "uid").rowsBetween(Window.unboundedPreceding, -1)
    line = line.select("part", F.col("uid").alias("at_uid"), *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in "rm"))
    line = line.join(F.broadcast(parts), "part").select("at_uid", (F.col("r") + F.col("r0")).alias("at"), (F.col("m") + F.col("m0")).alias("before"))
    placed = tokens.join(line, tokens.uid == line.at_uid).select("doc_id", "doc_tokens", "wholes", "rest", "at", "before")
    wide = max(encoder(tokenizer).n_vocab, end_id + 1) > 1 << 16
    return placed.mapInArrow(_piece_task(length, -(-stream // length), wide), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
