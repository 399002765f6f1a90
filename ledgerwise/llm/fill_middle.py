"""Fill-in-the-middle: a text's lines are cut into prefix, middle and suffix, and laid out anew with markers between.

Lines are counted a block of bytes at a time. While that goes on, every `every` lines a checkpoint keeps the line
number and the byte and code-point offsets there: a sparse index, a few numbers for hundreds of lines. A cut at line
u is a binary search among the checkpoints and a short scan from the one before it, so there is no list of lines,
and only the scanned bytes are counted again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import lean, text_slices

#: Markers before prefix, suffix and middle. Fixed values.
MARKERS = ("<P>", "<S>", "<M>")
#: Lines from one checkpoint to the next, and bytes that one step counts.
EVERY, BLOCK = 256, 1 << 20


def _leads(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


class Checkpoints:
    """Number of lines `n` of a UTF-8 text, and the offsets of the start of every `every`-th line.

    A line ends behind its newline; what follows the last newline, if anything, is a line, too.
    """

    def __init__(self, text: bytes, every: int = EVERY, block: int = BLOCK):
        self.text, self.lines, self.bytes, self.chars = text, [0], [0], [0]
        lines = chars = 0
        for at in range(0, len(text), block):
            data = np.frombuffer(text, np.uint8, min(block, len(text) - at), at)
            starts = np.flatnonzero(data == 0x0A) + 1  # of the lines behind each newline
            skipped = (every - 1 - lines) % every
            marked = starts[skipped::every]
            if len(marked):
                self.lines += range(lines + skipped + 1, lines + len(starts) + 1, every)
                self.bytes += (marked + at).tolist()
                self.chars += (np.cumsum(_leads(data))[marked - 1] + chars).tolist()
            lines += len(starts)
            chars += int(np.count_nonzero(_leads(data)))
        self.n = lines + (text[-1:] not in (b"", b"\n"))

    def offsets(self, line: int) -> tuple[int, int]:
        """(bytes, code points) before this line; for line n, those of the whole text."""
        near = bisect_right(self.lines, line) - 1
        at = begin = self.bytes[near]
        for _ in range(line - self.lines[near]):
            at = self.text.find(b"\n", at) + 1
            if not at:  # the last line has no newline
                at = len(self.text)
        span = np.frombuffer(self.text[begin:at], np.uint8)
        return at, self.chars[near] + int(np.count_nonzero(_leads(span)))


def draws(seed: str, doc_id: object) -> list[int]:
    """Four numbers below 2**32 of a document: groups of its hash's hex digits. A null id counts as no digits."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def _rearrange(text: bytes, drawn: Sequence[int], markers: Sequence[bytes], every: int, fim_percent: int, spm_percent: int) -> tuple:
    """(n, form, code points of prefix and middle, output)."""
    marks = Checkpoints(text, every)
    one, two, whether, which = drawn
    if not text or any(m in text for m in markers) or whether % 100 >= fim_percent:
        return marks.n, "plain", None, None, text
    (a, a_chars), (z, z_chars) = (marks.offsets(cut) for cut in sorted((one % (marks.n + 1), two % (marks.n + 1))))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    p, s, m = markers
    if which % 100 < spm_percent:
        return marks.n, "spm", a_chars, z_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return marks.n, "psm", a_chars, z_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def _task(markers: Sequence[str], seed: str, every: int, fim_percent: int, spm_percent: int):
    coded = [m.encode() for m in markers]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                rows = [
                    _rearrange(data[a:z].tobytes(), draws(seed, i), coded, every, fim_percent, spm_percent)
                    for i, a, z in zip(ids.slice(lo, hi - lo).to_pylist(), offsets, offsets[1:], strict=False)
                ]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                out = [ids.slice(lo, hi - lo), *columns, *(c.slice(lo, hi - lo) for c in batch.columns[2:])]
                yield pa.record_batch(out, [f"_{i}" for i in range(len(out))])

    return lean(task)


def _apart(markers: Sequence[str]) -> None:
    """Markers can be told in an output if no end of one is the beginning of one, and none holds another."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and b in a) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"these markers can't be told apart: {markers}")


def fill_in_middle(
    docs: DataFrame, markers: Sequence[str] = MARKERS, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50, every: int = EVERY,
    id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """documents -> (doc_id, n, form, prefix_chars, middle_chars, output, columns of `keep`), a row for each row.

    n is the number of lines. Both cuts and the form come from a hash of seed and id. Form `psm` is prefix, suffix and
    middle, `spm` suffix, prefix and middle, each behind its marker; `plain` is the text as it is, with null in place of
    lengths. Plain are empty texts, texts that hold a marker, and all but `fim_percent` of a hundred.

    A null text is an empty one. A null id is hashed as no digits. Repeated rows and ids are judged row by row, so equal
    rows come out equal; nothing ties. An empty table gives no rows. Columns not in `keep` are ignored, whatever they
    are called. A text is held whole, with its output, by one task, and its index is 3 numbers for `every` lines.
    Where equally many lines are drawn twice, the middle is empty.
    """
    _apart(markers)
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)))
    kinds = [f.dataType.simpleString() for f in taken.schema]
    kinds = [kinds[0], "long", "string", "long", "long", "string", *kinds[2:]]
    found = taken.mapInArrow(_task(markers, seed, every, fim_percent, spm_percent), ", ".join(f"_{i} {kind}" for i, kind in enumerate(kinds)))
    return found.toDF("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *keep)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of `fill_in_middle` was made of, from output and form alone."""
    _apart(markers)
    # a text with a marker is plain, so the others' outputs hold each marker once
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers))
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
