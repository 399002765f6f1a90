"""WARC archives written by tasks, and read back as a table of chunks.

A record is a gzip member of its own. Equal payloads are stored once: the other records are revisits that
name the digest and the record they refer to. Readers stream: they hold one block of the file and one
chunk of a payload, carry a running SHA-1 from chunk to chunk, and never build a whole record.
Each task writes files with names of its own, and only those that its result lists are read, so a task
that runs twice or is lost leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, new_path, written
from .textarrays import text_slices
from .url_filter import bloom_blocks, blocked_bloom, possible_hits

BLOCK_BYTES, CHUNK_BYTES, FILE_BYTES = 1 << 18, 1 << 16, 1 << 27
DATE = "2000-01-01T00:00:00Z"
CHUNKS = "page_id long, chunk_no int, chunk binary, running_sha1 string, bytes_so_far long, is_last boolean, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string"


def digest(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def _head(kind: str, page_id, url, sha: str, refers_to, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {re.sub('[\x00-\x20]+', '%20', url)}"] if url else []
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _write_task(folder: str):
    """(page_id, url, payload, refers_to, size, sha): a revisit has no payload here, but its size and hexadecimal SHA-1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            ids, urls, refers, sizes, shas = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
            for lo, _, data, offsets in text_slices(batch.column(2)):
                for i in range(len(offsets) - 1):
                    payload = memoryview(data)[offsets[i] : offsets[i + 1]]
                    row, body = lo + i, len(payload)
                    kind = "response" if refers[row] is None else "revisit"
                    sha = digest(hashlib.sha1(payload).digest() if kind == "response" else bytes.fromhex(shas[row]))
                    http = _http(body if kind == "response" else sizes[row])
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, records, size = fs.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                    member = zlib.compressobj(3, wbits=31)
                    size += out.write(member.compress(_head(kind, ids[row], urls[row], sha, refers[row], len(http) + body) + http))
                    for a in range(0, body, BLOCK_BYTES):
                        size += out.write(member.compress(payload[a : a + BLOCK_BYTES]))
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            path, records, size = zip(*done, strict=True)
            yield pa.record_batch([pa.array(path), pa.array(records, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"])

    return task


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages -> (path, records, bytes), a row for each archive written under folder (default: in the shared one).

    A record for each row; a null payload is an empty one. Of equal payloads of at least least_bytes bytes,
    that with the largest id is the response and the others revisit it. Rows with that id are all
    responses. Rows with a null id and a payload that others have revisit those, if any has an id. Payloads
    are equal if their size and SHA-256 are. Urls of any length are kept whole, with %20 for control
    characters and spaces. No pages give no archives; other columns, whatever their names, are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "key": F.unhex(F.sha2("payload", 256))})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 AND original IS NOT NULL").select("key", "original"), "groups")
    blocks = bloom_blocks(groups.count())
    told = possible_hits(rows, "key", blocked_bloom(groups, "key", blocks), blocks, keep=True)
    no_ref, no_sha = F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("sha")
    alone = told.where("NOT maybe").select("page_id", "url", "payload", no_ref, "size", no_sha)
    # rows that may have equals are decided without their payloads
    maybe = told.where("maybe")
    small = maybe.select("page_id", "url", "size", "key", F.sha1(F.encode("payload", "utf-8")).alias("sha")).join(groups, "key", "left")
    small = written(small, "decided")
    revisits = small.where("original IS NOT NULL AND NOT (original <=> page_id)")
    revisits = revisits.select("page_id", "url", F.lit(None).cast("string").alias("payload"), F.col("original").alias("refers_to"), "size", "sha")
    # and only payloads of responses among them are shuffled
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex("key")).alias("name")
    needed = written(small.where("original IS NULL OR original <=> page_id").select(name).distinct(), "needed")
    blocks = bloom_blocks(needed.count())
    full = possible_hits(maybe.drop("maybe").withColumn("name", name), "name", blocked_bloom(needed, "name", blocks), blocks)
    full = full.join(needed, "name", "left_semi").select("page_id", "url", "payload", no_ref, "size", no_sha)
    both = alone.unionByName(revisits).unionByName(full)
    out = written(both.mapInArrow(_write_task(folder or new_path(pages.sparkSession, "warc")), "path string, records long, bytes long"), "archives")
    dropped(groups, small, needed)
    return out


class _Members:
    """The bytes of a file of gzip members, a block at a time."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held, self.more = stream, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        while True:
            if self.inflate.eof:
                self.more, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.more:
                self.more = self.stream.read(BLOCK_BYTES)
                if not self.more:
                    return False
            got = self.inflate.decompress(self.more, BLOCK_BYTES)
            self.more = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True

    def head(self) -> tuple[str, dict[str, str]] | None:
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.held) - 3)
            if not self.fill():
                if self.held:
                    raise ValueError("a record is cut off")
                return None
        first, *lines = self.held[:end].decode().split("\r\n")
        del self.held[: end + 4]
        return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError("a record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _records(path: str) -> Iterator[tuple]:
    """Rows of CHUNKS, in the order of the file; the digest and size of the full payload are in the last chunk's row."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as stream:
        file = _Members(stream)
        while (head := file.head()) is not None:
            warc = head[1]
            page, refers, uri = _page(warc["warc-record-id"]), _page(warc.get("warc-refers-to")), warc.get("warc-target-uri")
            kind, sha = warc["warc-type"], hashlib.sha1()
            http = file.head()[1]
            size = int(http["content-length"])
            if kind == "revisit":
                yield page, 0, b"", None, 0, True, kind, refers, size, warc["warc-payload-digest"].removeprefix("sha1:"), uri
            else:
                chunks = max(1, -(-size // CHUNK_BYTES))
                for n in range(chunks):
                    part = file.take(min(CHUNK_BYTES, size - n * CHUNK_BYTES))
                    sha.update(part)
                    last = n == chunks - 1
                    running = digest(sha.copy().digest())
                    if last and running != warc["warc-payload-digest"].removeprefix("sha1:"):
                        raise ValueError(f"the payload of page {page} doesn't have its digest")
                    yield page, n, part, running, min(size, (n + 1) * CHUNK_BYTES), last, kind, None, size if last else None, running if last else None, uri
            if file.take(4) != b"\r\n\r\n":
                raise ValueError("no end of a record")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("running_sha1", pa.string()), ("bytes_so_far", pa.int64()), ("is_last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target_uri", pa.string())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            held, size = [], 0
            for row in _records(path):
                held.append(row)
                size += len(row[2]) + 200
                if size >= 1 << 22:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """archives(path) -> CHUNKS: each record's payload as numbered chunks of CHUNK_BYTES with a running digest.

    A revisit is one row without bytes; its size and digest are those of the payload it refers to. An
    empty payload is one empty chunk. Files and chunks of any size are streamed; a file cut off, or a
    payload that doesn't have its digest, is an error. A header is held whole: it is as long as its url.
    """
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(_read_task, CHUNKS)
