"""Words of an Arrow text column as numpy arrays: boundaries, 64-bit hashes and hashes of word windows.

All functions work on whole texts, in slices of a few MB, without a Python step per word. Words are
byte ranges of the UTF-8 text, so a word class is a table of 256 booleans.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of text that one step holds; a longer text is a step of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 12
#: Multipliers and seeds of two independent hashes.
BASES, SEEDS = (0x9E3779B97F4A7C17, 0xD1342543DE82EF97), (0x51ED270B, 0x2545F491)
#: Words of more bytes are hashed by BLAKE2b, shorter ones in steps of eight bytes.
LONG_WORD = 64

#: [^\x20\x09-\x0D]
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: The lowest n bytes of eight, for n from 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lean(task: Callable) -> Callable:
    """The task, after which its worker gives freed memory back: idle workers count as an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two rounds of shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(x: np.ndarray, y: np.ndarray, which: int) -> np.ndarray:
    """Hashes of two parts in this order, from the parts' hashes; no sum or product that could be undone by other parts."""
    return mix(x * np.uint64(BASES[which]) ^ y)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets of the rows) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, at + SLICE_ROWS, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """start, end: byte ranges of all words; first: index of each row's first word (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = is_word[data]
        lo, hi = offsets[:-1], offsets[1:]
        full = hi > lo
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[lo[full]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[hi[full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, chained through `mix`; nothing in it is linear in the bytes."""
        size = self.end - self.start
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), 0, (1,))  # at each byte
        out = mix(size.astype(np.uint64) * np.uint64(BASES[which]) + np.uint64(SEEDS[which]))
        here = np.flatnonzero(size <= LONG_WORD)
        at, left = self.start[here], size[here]
        while len(here):
            out[here] = mix(out[here] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
            more = left > 8
            here, at, left = here[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_WORD):
            word = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, salt=bytes([which]))
            out[i] = int.from_bytes(word.digest(), "little")
        return out

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within one row."""
        row_end = np.repeat(self.first[1:], self.count)
        at = np.flatnonzero(np.arange(len(hashes)) + k <= row_end)
        return at, self.runs(hashes, k, which)[at]

    def runs(self, hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """The hash of the k words from each word on, whatever rows they are in: joined from runs of 1, 2, 4 ... words."""
        n, part, size, out, done = len(hashes), hashes, 1, None, 0
        if n < k:
            return np.zeros(0, np.uint64)
        while True:
            if k & size:
                out = part if out is None else _pair(out[: n - done - size + 1], part[done:], which)
                done += size
            if done == k:
                return out
            part, size = _pair(part[:-size], part[size:], which), 2 * size

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row (within the slice) of each word index."""
        return np.searchsorted(self.first, at, "right") - 1
