"""Members of zip archives as lines, read a block at a time by the tasks, without unpacking anything anywhere."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import zero_filled

#: Bytes of a member in memory at once, besides one line.
BLOCK = 1 << 20
MEMBER = r"(?i)\.(csv|txt|tsv)$"


def _blocks(file, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first line, whole lines without their ends) of a stream; a line that no block holds whole is put together."""
    left, n = b"", 0
    while block := file.read(size):
        *lines, left = (left + block).split(b"\n")
        if lines:
            yield n, [x.removesuffix(b"\r") for x in lines]
            n += len(lines)
    if left:
        yield n, [left.removesuffix(b"\r")]


def _read_task(member: str, encoding: str):
    wanted = re.compile(member).search

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
                    name = next((x for x in archive.namelist() if wanted(x)), None)
                    if name is None:
                        raise ValueError(f"no member that fits in {path}")
                    with archive.open(name) as file:
                        for n, lines in _blocks(file):
                            text = [x.decode(encoding, "replace") for x in lines]
                            yield pa.record_batch([pa.array([path] * len(text)), pa.array([name] * len(text)), pa.array(range(n, n + len(text)), pa.int64()), pa.array(text)], ["path", "member", "n", "line"])

    return task


def zip_lines(spark: SparkSession, path: str, member: str = MEMBER, encoding: str = "ascii") -> DataFrame:
    """(path, member, n, line): the lines, from 0, of the first member of each archive whose name fits, a task for each archive.

    path: an archive, a folder or a pattern, in a store that pyarrow.fs opens in the tasks; its files are listed by Spark, which
    doesn't read them. Archives are read at places, so their directory is found at their end; a member is inflated as it
    is read. Bytes that aren't of the encoding come as the replacement character. An archive without such a member is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    paths = [r["path"] for r in files.collect()]  # names alone
    listed = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    return listed.repartitionByRange(max(1, len(paths)), "path").mapInArrow(_read_task(member, encoding), "path string, member string, n long, line string")


def pairs_of(lines: DataFrame, least: int = 11, keys: DataFrame | None = None) -> DataFrame:
    """Lines of shared-patient files, with or without a header -> (source, target, pairs, shared, same_day).

    A header is a line whose first field isn't a number; the columns are in this order either way. Ids get their
    leading zeros, numbers may have a point, a bad or missing same_day is 0, other bad rows go; so do loops, pairs
    below `least` shared patients, and ids that aren't in keys(npi), if given.
    """
    fields = F.from_csv("line", "source string, target string, pairs string, shared string, same_day string", {"mode": "PERMISSIVE"})
    rows = lines.select(fields.alias("f")).select(*(F.trim(f"f.{c}").alias(c) for c in ("source", "target", "pairs", "shared", "same_day")))
    rows = rows.where(F.col("source").rlike(r"^\d+$") & F.col("target").rlike(r"^\d+$"))  # a header has no number here
    whole = lambda c: F.floor(F.expr(f"try_cast({c} AS DOUBLE)")).cast("long")
    rows = rows.select(zero_filled("source").alias("source"), zero_filled("target").alias("target"), whole("pairs").alias("pairs"), whole("shared").alias("shared"), F.coalesce(whole("same_day"), F.lit(0)).alias("same_day"))
    rows = rows.where((F.col("source") != F.col("target")) & F.col("pairs").isNotNull() & (F.col("shared") >= least))
    if keys is None:
        return rows
    known = keys.select("npi").distinct()
    return rows.join(known.withColumnRenamed("npi", "source"), "source", "left_semi").join(known.withColumnRenamed("npi", "target"), "target", "left_semi")


def write_zips(lines: DataFrame, folder: str, member: str = "pairs.csv", line_col: str = "line", header: str | None = None) -> DataFrame:
    """(path, lines): an archive under folder for each partition that has lines, deflated as they come, the header first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        out, n, name = None, 0, f"{uuid.uuid4().hex}.zip"
        for batch in batches:
            if batch.num_rows and out is None:
                raw = fs.open_output_stream(f"{at}/{name}", compression=None)
                archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                out = archive.open(member, "w", force_zip64=True)
                if header is not None:
                    out.write(header.encode() + b"\n")
            for line in batch.column(0).to_pylist():
                out.write((line or "").encode() + b"\n")
                n += 1
        if out is not None:
            out.close()
            archive.close()
            raw.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "lines"])

    return lines.select(line_col).mapInArrow(task, "path string, lines long")
