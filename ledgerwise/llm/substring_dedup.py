"""Substring dedup: a count-min prefilter finds windows that may repeat, a second pass groups exactly those.

Pass 1 takes the fingerprint of every run of k words of every text, which is the least hash of the grams of
five words within it, and counts it once for each run of neighbouring windows that have it in common (about
a fifth of all windows). Each task sends the cells of two hash rows that it has hit once and more than once.
Merging adds the counts, saturated at two, so a cell never underestimates: windows of two documents that are
equal have equal fingerprints, counted twice, and always pass. Pass 2 hashes the windows again, sends those
whose cells are all at two or more, and groups them by two independent hashes of the words, of 64 and 32
bits. False positives form groups of one and vanish. Of every SETTLE windows that a task lets pass, each
different one is sent once, with its smallest document; larger documents among them are settled there, and
settled rows are groups of their own. So a window that a third of all documents share is one row of each
lot, a small part of any partition, and not a row for each document.

The sketch has a fixed bound: ROWS rows of at most 2**MAX_BITS one-bit cells after merging (128 MB). A
corpus too large for it passes more windows to the exact step; none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written
from .textarrays import NOT_SPACE, Words, lean, mix, text_slices
from .url_filter import bloom_blocks, blocked_bloom, possible_hits

ROWS, MIN_BITS, MAX_BITS, BLOCK_BITS = 2, 16, 29, 22
#: Words of the grams whose least hash is a window's fingerprint, and cells for each byte of text.
GRAM, CELLS_A_BYTE = 5, 0.12
#: Fingerprints a task gathers before it sends their cells.
FLUSH = 1 << 22
#: Windows that pass a task's filter before it settles what it can and sends the rest.
SETTLE = 1 << 19
NO_ID = np.iinfo(np.int64).max
_SALTS = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _gaps(sorted_cells: np.ndarray) -> bytes:
    """Increasing offsets as one byte a gap; 255 means 255 further and no cell yet."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=-1) - 1
    skips = gaps // 255
    out = np.full(len(gaps) + int(skips.sum()), 255, np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(skips)] = gaps % 255
    return out.tobytes()


def _ungaps(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).astype(np.int64)
    ends = steps != 255
    at = np.cumsum(np.where(ends, steps + 1, 255)) - 1
    return at[ends]


def _fingerprints(words: Words, plain: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For each window (by its first word) the least hash of its grams."""
    if not len(at):
        return np.zeros(0, np.uint64)
    least, done, span = words.runs(plain, min(GRAM, k)), 1, k - min(GRAM, k) + 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return least[at]


def _sketch_task(k: int, bits: int):
    block_bits = min(BLOCK_BITS, bits)

    def flush(hashes: list[np.ndarray]) -> pa.RecordBatch:
        rows, blocks, ones, twos = [], [], [], []
        every = np.concatenate(hashes)
        for row in range(ROWS):
            cell, n = np.unique(_cells(every, row, bits), return_counts=True)
            cuts = np.searchsorted(cell >> np.uint32(block_bits), np.arange((1 << (bits - block_bits)) + 1))
            for block, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < z:
                    offset = cell[a:z] & np.uint32((1 << block_bits) - 1)
                    rows.append(row)
                    blocks.append(block)
                    ones.append(_gaps(offset))
                    twos.append(_gaps(offset[n[a:z] > 1]))
        return pa.record_batch([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["row", "block", "ones", "twos"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets, NOT_SPACE)
                plain = words.hashes()
                at = words.windows(plain, k)[0]
                prints = _fingerprints(words, plain, at, k)
                new = np.ones(len(at), bool)  # of each row and each run of windows with one fingerprint
                new[1:] = (prints[1:] != prints[:-1]) | (at[1:] != at[:-1] + 1)
                held.append(prints[new])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return lean(task)


def _merge_task(bits: int):
    block_bits = min(BLOCK_BITS, bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row, block, ones, twos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, block) not in held:
                    held[row, block] = np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)
                once, twice = held[row, block]
                cells = _ungaps(ones)
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[_ungaps(twos)] = True
        for (row, block), (_, twice) in held.items():
            yield pa.record_batch([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["row", "block", "bits"])

    return lean(task)


def count_min(texts: DataFrame, text_col: str, k: int, bits: int) -> np.ndarray:
    """(ROWS, 2**bits / 8) bytes: bit 1 where a cell's count over all tasks is two or more."""
    parts = texts.select(text_col).mapInArrow(_sketch_task(k, bits), "row int, block int, ones binary, twos binary")
    tasks = min(64, max(1, ROWS << max(0, bits - BLOCK_BITS)))
    merged = parts.repartition(tasks, "row", "block").mapInArrow(_merge_task(bits), "row int, block int, bits binary")
    block_bytes = (1 << min(BLOCK_BITS, bits)) // 8
    sketch = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for got in merged.toLocalIterator():  # at most ROWS * 2**bits / 8 bytes in all, a partition at a time
        sketch[got["row"], got["block"] * block_bytes : (got["block"] + 1) * block_bytes] = np.frombuffer(got["bits"], np.uint8)
    return sketch


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _settle(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    """A row for each window and document: for each window its smallest document, and those settled by that one."""
    first, second, owner, part = (np.concatenate(x) for x in found)
    order = np.lexsort((part, owner, second, first))
    first, second, owner, part = first[order], second[order], owner[order], part[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.zeros(len(first), bool)  # the same window of the same document
    again[1:] = ~new[1:] & (owner[1:] == owner[:-1]) & (part[1:] == part[:-1])
    first, second, owner, part, least = first[~again], second[~again], owner[~again], part[~again], least[~again]
    return pa.record_batch([_signed(first), second, owner, part, pa.array(owner, mask=owner == least)], ["h1", "h2", "owner", "part", "settled"])


def _candidate_task(k: int, bits: int, sketch):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found, size = sketch.value, ([], [], [], []), 0
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, _, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets, NOT_SPACE)
                plain = words.hashes()
                at, first = words.windows(plain, k)
                passed, prints = np.ones(len(at), bool), _fingerprints(words, plain, at, k)
                for row in range(ROWS):
                    cell = _cells(prints, row, bits)
                    passed &= (table[row][cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 == 1
                if passed.any():
                    second = (words.windows(words.hashes(1), k, 1)[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    rows = lo + words.row_of(at[passed])
                    for have, x in zip(found, (first[passed], second[passed], ids[rows], parts[rows]), strict=True):
                        have.append(x)
                    size += int(passed.sum())
                if size >= SETTLE:
                    yield _settle(found)
                    found, size = ([], [], [], []), 0
        if size:
            yield _settle(found)

    return lean(task)


def _cut_task(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, copies = batch.column(0), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                own = marks.slice(lo, hi - lo)
                counts = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                gone = np.zeros(len(words.start), bool)
                if counts.sum():
                    at, hashes = words.windows(words.hashes(), k)
                    row = words.row_of(at).astype(np.uint64)
                    tell = lambda h, r: mix(h ^ mix(r + np.uint64(1)))
                    listed = tell(own.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(hi - lo, dtype=np.uint64), counts))
                    hit = at[np.isin(tell(hashes, row), listed)]
                    steps = np.bincount(hit, minlength=len(gone) + k + 1) - np.bincount(hit + k, minlength=len(gone) + k + 1)
                    gone = np.cumsum(steps)[: len(gone)] > 0
                gone |= np.repeat(copies[lo:hi] & (words.count >= k), words.count)
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[words.first[1:]] - removed[words.first[:-1]]
                start, end = words.start[~gone], words.end[~gone]
                size = end - start + 1
                stop = np.cumsum(size)
                spaced = np.append(data, np.uint8(32))[np.arange(int(size.sum())) - np.repeat(stop - size - start, size)]
                spaced[stop - 1] = 32
                kept = words.count - removed
                last = np.cumsum(kept)
                ends = np.concatenate([[0], stop])
                # each row's words with one space after each; the last space of a row is left out
                cut = [spaced[ends[b - n] : max(ends[b] - 1, ends[b - n])].tobytes() for b, n in zip(last, kept, strict=True)]
                # the text as it was, without the removed words and the space after them
                steps = np.zeros(len(data) + 1, np.int64)
                follow = np.minimum(np.append(words.start[1:], len(data)), np.repeat(offsets[1:], words.count))
                np.add.at(steps, words.start[gone], 1)
                np.add.at(steps, follow[gone], -1)
                stay = np.cumsum(steps[:-1]) == 0
                left = data[stay]
                place = np.concatenate([[0], np.cumsum(stay)])[offsets]
                trimmed = [left[a:z].tobytes() for a, z in zip(place, place[1:], strict=False)]
                more = batch.columns[4:]
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, pa.binary()).cast(pa.string()), pa.array(trimmed, pa.binary()).cast(pa.string()), *(x.slice(lo, hi - lo) for x in more)],
                    ["doc_id", "n_words", "n_removed", "kept_words", "text", *(f"keep{i}" for i in range(len(more)))])

    return lean(task)


def repeated_windows(texts: DataFrame, k: int) -> DataFrame:
    """texts(id, part, text) -> (owner, part, h1): the windows of each document that also start in one with a smaller id."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1.0, size * CELLS_A_BYTE)))))
    sketch = spark.sparkContext.broadcast(count_min(texts, "text", k, bits))
    rows = texts.select("id", "part", "text").mapInArrow(_candidate_task(k, bits, sketch), "h1 long, h2 int, owner long, part int, settled long")
    least = F.min("owner").over(Window.partitionBy("h1", "h2", "settled"))  # settled: null, or the owner
    return rows.withColumn("least", least).where("settled IS NOT NULL OR owner > least").select("owner", "part", "h1")


def _parts(often: DataFrame):
    """A function that adds a number `part` to rows of (id, key): 0, or for ids that may be in `often` one by the text's key."""
    n = often.count()
    if not n:
        return lambda rows: rows.withColumn("part", F.lit(0))
    blocks = bloom_blocks(n)
    bloom = blocked_bloom(often, "id", blocks)
    of_text = F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("int") + 1
    return lambda rows: possible_hits(rows, "id", bloom, blocks, keep=True).withColumn("part", F.when(F.col("maybe"), of_text).otherwise(F.lit(0))).drop("maybe")


def cut_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> (doc_id, n_words, n_removed, kept_words, text, *keep), a row for each row.

    A word goes if a window of k words that covers it also starts in a document with a smaller id;
    windows are judged on the input. kept_words has the kept words joined by one space; text is the
    input without the removed words and the white space after them. A null or empty text has no words.
    Rows with the same id don't remove from each other. A null id counts as larger than any other and
    removes nothing; negative ids are ids as any other. An empty table gives an empty one. Texts of any
    length are read whole, one at a time. Columns named in keep are handed on; others, whatever their
    names, are ignored.
    """
    more = [f"keep{i}" for i in range(len(keep))]
    kinds = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(more, keep, strict=True))
    texts = docs.select(*(F.col(c).alias(name) for name, c in zip(more, keep, strict=True)), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("key"))
    keys = written(texts.select("id", "key"), "keys")
    # of ids that many rows have (a null id, above all), each text is a part of its own: no row gathers the windows of all
    often = written(keys.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "often")
    parted = _parts(often)
    texts = parted(texts)
    firsts = written(keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first"), "firsts")
    copies = written(parted(keys.join(firsts, "key").where("id > first").select("id", "key").distinct()), "copies")
    blocks = bloom_blocks(copies.count())
    told = possible_hits(texts, "id", blocked_bloom(copies, "id", blocks), blocks, keep=True)
    rest = told.where("maybe").select("id", "part", "text", "key").join(copies, ["id", "part", "key"], "left_anti")
    first = told.where("NOT maybe").select("id", "part", "text").unionByName(rest.select("id", "part", "text"))

    marks = repeated_windows(first, k).withColumn("copy", F.lit(None).cast("binary"))
    marks = marks.unionByName(copies.select(F.col("id").alias("owner"), "part", F.lit(None).cast("long").alias("h1"), F.col("key").alias("copy")))
    # by distinct windows of one document, or of an often seen id's texts of one part: no more than these have words
    marks = written(marks.groupBy("owner", F.col("part").alias("of_part")).agg(F.collect_list("h1").alias("marks"), F.collect_set("copy").alias("copies")), "marks")
    dropped(keys, firsts)
    blocks = bloom_blocks(marks.count())
    told = possible_hits(texts, "id", blocked_bloom(marks, "owner", blocks), blocks, keep=True)
    none = F.lit(None).cast("array<bigint>")
    sure = told.where("NOT maybe").select("id", "text", none.alias("marks"), F.lit(False).alias("copy"), *more)
    cut = told.where("maybe").join(marks, (F.col("id") == F.col("owner")) & (F.col("part") == F.col("of_part")), "left")
    cut = cut.select("id", "text", "marks", F.coalesce(F.array_contains("copies", F.col("key")), F.lit(False)).alias("copy"), *more)
    schema = f"doc_id long, n_words long, n_removed long, kept_words string, text string{kinds}"
    out = sure.mapInArrow(_cut_task(k), schema).unionByName(cut.mapInArrow(_cut_task(k), schema))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID)))).withColumnsRenamed(dict(zip(more, keep, strict=True)))
