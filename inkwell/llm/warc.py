"""WARC archives: a writer, and a sequential reader that frames gzip members and records itself.

An archive has one gzip member per record. A task writes one archive into the folder through pyarrow's file systems
(local, HDFS or object stores, by the folder's URI) under a name of its own attempt; only the names of tasks that
succeeded are reported, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import attach
from inkwell.session import Scratch, load, qualified, scratch_path

VERSION, BREAK = b"WARC/1.1", b"\r\n"
#: Payloads of so many bytes or more are told apart by digest; smaller ones are always stored.
LEAST_REVISIT = 1000
CHUNK = 1 << 16
#: Records and bytes that are read before they are handed on.
ROWS, HELD = 512, 1 << 23


def digest32(data: bytes) -> str:
    """A digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def target(url: str) -> str:
    """A URL as a header can carry it: control characters, blanks and all beyond ASCII percent-encoded, "%" kept."""
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~-._")


def record(kind: str, rid: str, url: str, payload: bytes | None, refers_to: str | None, date: str, size: int | None = None, sha1: str | None = None) -> bytes:
    """One WARC record. A revisit has no payload: size and sha1 (hex) are those of the full one, which its headers carry."""
    size = len(payload) if size is None else size
    told = digest32(payload) if sha1 is None else "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": date, "WARC-Target-URI": target(url),
        "WARC-Payload-Digest": told, "WARC-Block-Digest": digest32(block), "X-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", b""]
    return BREAK.join(lines) + block + BREAK * 2


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """The inflated bytes of one gzip member after another, from a stream read chunk by chunk."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""

    def _more(self) -> bytes:
        return self.ahead or self.stream.read(CHUNK)

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while True:
            self.ahead = bytes(self._more())
            if not self.ahead:
                return
            yield self._inflate()

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            data = bytes(self._more())
            self.ahead = b""
            if not data:
                raise ValueError("the archive ends within a gzip member")
            out = z.decompress(data, CHUNK * 4)
            while True:
                if out:
                    yield out
                if z.eof or not z.unconsumed_tail:
                    break
                out = z.decompress(z.unconsumed_tail, CHUNK * 4)
        self.ahead = z.unused_data


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record. Framing by Content-Length; a record that is cut off, is not followed by two
    line breaks or has another block digest than its header says is an error."""
    for member in Members(stream):
        data = bytearray()
        for part in member:
            data += part
        head, gap, rest = bytes(data).partition(BREAK * 2)
        lines = head.split(BREAK)
        if not gap or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC header")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers["content-length"])
        if rest[size:] != BREAK * 2:
            raise ValueError("Content-Length does not frame the block")
        block = rest[:size]
        if headers.get("warc-block-digest", digest32(block)) != digest32(block):
            raise ValueError("block digest differs")
        yield headers, block


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record_kinds(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The rows that are stored, with their payloads, and those that are revisits, without: id, url, html, bytes, sha1,
    record_type, refers_to.

    Only digests, ids and urls are compared; a digest that many pages share is joined by broadcast. Payloads of fewer than
    LEAST_REVISIT bytes stay where they are read; of the others each moves once, by its own id and digest, and those
    of revisits are not written.
    """
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    told = pages.select(F.col(id_col).alias("id"), "url", F.col(payload_col).alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("sha1"))
    long = told.where(F.col("bytes") >= LEAST_REVISIT)
    narrow = scratch.keep(long.select("id", "url", "bytes", "sha1"), "digests")
    heads = narrow.groupBy("sha1").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = scratch.keep(heads, "heads")
    away = attach(narrow, heads, "sha1").where(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head")))
    away = scratch.keep(away.select("id", "url", F.lit(None).cast("string").alias("html"), "bytes", "sha1", F.lit("revisit").alias("record_type"), F.col("head").alias("refers_to")), "revisits")
    keys = away.select(F.col("id").alias("gone"), F.col("sha1").alias("told")).distinct()
    stay = long.join(keys, F.col("id").eqNullSafe(F.col("gone")) & (F.col("sha1") == F.col("told")), "left_anti")
    stay = stay.unionByName(told.where(F.col("bytes") < LEAST_REVISIT))
    return stay.select("*", F.lit("response").alias("record_type"), F.lit(None).cast(narrow.schema["id"].dataType).alias("refers_to")), away


def _urn(i) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"page-{i}").urn


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes rows of record_kinds as archives, one a task; returns (path, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _open_folder(folder)
        c = TaskContext.get()
        name, n, out = f"{root}/pages-{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0, None
        for b in batches:
            for i, url, html, size, sha1, kind, ref in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                payload = (html or "").encode() if kind == "response" else None
                data = record(kind, f"{_urn(i)}#{i}", url or "", payload, None if ref is None else f"{_urn(ref)}#{ref}", date, size, sha1)
                out.write(gzip_member(data))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return pages.mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives (path): record_id, url, record_type, payload_bytes, payload_digest (lower-case
    hex), refers_to, payload (null for a revisit). Payload digests of responses are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_folder(folder)
        names = ("record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=CHUNK) as stream:
                    for h, block in read_records(stream):
                        payload = block.partition(BREAK * 2)[2] if h["warc-type"] == "response" else None
                        if payload is not None and digest32(payload) != h["warc-payload-digest"]:
                            raise ValueError(f"payload digest differs in {path}")
                        ref = h.get("warc-refers-to")
                        size = int(h["x-payload-length"]) if payload is None else len(payload)
                        rows.append((h["warc-record-id"].strip("<>"), h["warc-target-uri"], h["warc-type"], size, base64.b32decode(h["warc-payload-digest"][5:]).hex(), ref and ref.strip("<>"), payload))
                        held += len(block)
                        if len(rows) >= ROWS or held >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select("path").mapInArrow(run, "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def warc_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """Writes every row of pages as a WARC record below folder and reads all archives back, one task an archive.

    A null html counts as empty; of equal payloads of LEAST_REVISIT bytes or more the largest id is the response; rows
    that repeat an id give a record each, all responses or all revisits; rows with a null id are stored as responses
    unless an equal payload has an id; a null url is empty, and what a header cannot carry of one is percent-encoded;
    payloads of any length are whole, with ROWS records or HELD bytes of them in memory; other columns are not read; an empty table gives no archive and an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    stay, away = record_kinds(pages, scratch, id_col)
    archives = scratch.keep(write_archives(stay, folder).union(write_archives(away, folder)), "archives")
    n = max(1, archives.count())
    scratch.drop("digests", "heads", "revisits")
    return read_archives(archives.repartition(n), folder)


def op10_warc(spark, sf_dir):
    """All pages."""
    folder = scratch_path(spark, "warc")
    out = warc_round_trip(load(spark, sf_dir, "pages"), folder)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, '#', -1) as bigint)")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> head THEN head END AS refers_to FROM h
"""
