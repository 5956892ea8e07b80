"""WARC archives: written, normalised to one gzip member a record, indexed, and read back.

Writing: each task streams its records through one gzip stream (a monolithic file, as crawlers leave them). Normalising: that
file is inflated once, from front to end, record by record; every record becomes a gzip member of its own, and a sidecar index
gets its key, offset and length. The monolithic file then goes. Reading: entries of the sidecar indexes are dealt in blocks, so
that many tasks share a large archive; a record is found through its entry and inflated alone.

Records with equal payloads of at least `min_bytes` bytes: the one with the largest page id is the response, the others revisit
it. Digests, not payloads, meet in the aggregation: each task adds its own largest id a digest first, so a payload that a third of
all pages share moves as one row a task. The table of shared digests has a row a digest and is joined back; the pages of a
digest with very many stand on one side only, so adaptive execution splits them over tasks by size, whatever their ids.

A task that runs again, or twice at once, may get its rows in another order, so archives and sidecars keep the name of the attempt
that wrote them; the index table, whose commit picks one attempt, says which ones count. Others lie unread.

Defined results: a null html is an empty payload; an empty payload counts as any other (min_bytes 0); a null page id is written
without a number and reads back as null, after all others in order; rows that repeat a page id each get a record, and all that
repeat the largest id of a payload are responses; an empty table gives no rows. Extra input columns, also of clashing names, are
ignored. A very long page is one record, held in memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import filesystem, fresh_dir, materialize, quoted, reducers, slices

BLOCK = 1 << 20
#: Bytes of a sidecar's entry, and entries that are read back together.
ENTRY, ENTRIES = 32, 1024
DATE = "2000-01-01T00:00:00Z"  # records carry no clock, so that a task that runs again writes the same bytes
INDEX = "file string, page_id long, page_null boolean, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the length and digest of the payload but not its bytes.

    The payload is the page alone, without an HTTP exchange, and the type says response as the contract of the query has it.
    """
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{kind}|{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|response|{digest}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _safe(url: str) -> str:
    """A header value stays on its line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


class Inflated:
    """The inflated bytes of a gzip file of one or more members, read forward once."""

    def __init__(self, file: BinaryIO):
        self.file, self.z, self.held, self.ended = file, zlib.decompressobj(31), b"", False
        self.begun = False

    def _more(self) -> bool:
        while not self.ended:
            if self.z.eof:
                rest = self.z.unused_data or self.file.read(BLOCK)
                if not rest:
                    self.ended = True
                    return False
                self.z = zlib.decompressobj(31)
            else:
                rest = self.z.unconsumed_tail or self.file.read(BLOCK)
            got = self.z.decompress(rest, 4 * BLOCK)  # of no input, too: output may be waiting
            if not got and not rest and not self.z.eof:
                if not self.begun:  # an empty file
                    self.ended = True
                    return False
                raise ValueError("the gzip stream ends inside a member")
            self.begun = True
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; None at the end."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("a record is cut off")
                return None
        return self.exactly(at + len(mark))

    def exactly(self, n: int) -> bytes:
        parts, need = [], n
        while need > len(self.held):
            parts.append(self.held)
            need -= len(self.held)
            self.held = b""
            if not self._more():
                raise ValueError("a record is cut off")
        parts.append(self.held[:need])
        self.held = self.held[need:]
        return b"".join(parts)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a gzip file, whether one member or many."""
    stream = Inflated(file)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        headers = parse_headers(head)
        yield headers, head + stream.exactly(int(headers["content-length"]) + 4)


def normalise(source: BinaryIO, out: BinaryIO) -> Iterator[tuple[dict[str, str], int, int]]:
    """Rewrite every record of source as its own member of out; yields (headers, offset, length)."""
    at = 0
    for headers, record in records(source):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        out.write(member)
        yield headers, at, len(member)
        at += len(member)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def with_types(pages: DataFrame, id_col: str, html_col: str, url_col: str, min_bytes: int) -> DataFrame:
    """(page, url, html, refers_to): refers_to is null for responses."""
    base = pages.select(quoted(id_col).cast("long").alias("page"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.select("*", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("size"))
    shared = base.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n")
    return base.join(shared, "sha", "left").select("page", "url", "html", F.when((F.col("page").isNull() & F.col("largest").isNotNull()) | (F.col("page") != F.col("largest")), F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write, normalise and index; returns the index, a row per record: (file, page_id, offset, length, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        whole, own, name = f"{root}/.{part:05d}-{mark}.mono.gz", f"{root}/.{part:05d}-{mark}.warc.gz", f"part-{part:05d}-{mark}.warc.gz"
        n = 0
        with fs.open_output_stream(whole, compression=None) as out:
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            for b in slices(batches, "html", 4 << 20):
                for page, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "refers_to")), strict=True):
                    payload = html.encode()
                    kind = "response" if refers_to is None else "revisit"
                    out.write(z.compress(_record(kind, page, url or "", payload, digest32(payload), refers_to)))
                    n += 1
            out.write(z.flush())
        if not n:
            fs.delete_file(whole)
            return
        rows = []
        with fs.open_input_stream(whole, compression=None) as source, fs.open_output_stream(own, compression=None) as out:
            for h, offset, length in normalise(source, out):
                page = _number(h["x-page-id"])
                rows.append((name, page, page is None, offset, length, h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), _number(h.get("x-refers-to-page-id"))))
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(index_bytes(rows))
        fs.move(own, f"{root}/{name}")
        fs.move(f"{own}.idx", f"{root}/{name}.idx")
        fs.delete_file(whole)
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) if i not in (1, 8) else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows[at : at + 10_000], strict=True))], names=[c.split()[0] for c in INDEX.split(", ")])

    typed = with_types(pages, id_col, html_col, url_col, min_bytes)
    return materialize(typed.mapInArrow(run, INDEX), "warc-index")


def index_bytes(rows: list[tuple]) -> bytes:
    """The sidecar: ascending by page id, as (page id, is null, offset, length) of 64 bits each."""
    out = io.BytesIO()
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[3])):
        out.write(struct.pack("<qqqq", r[1] or 0, int(r[2]), r[3], r[4]))
    return out.getvalue()


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read every record back through the sidecar indexes: (page_id, url, html, payload_digest, record_type, payload_bytes, refers_to).

    html is null for revisits; payload_bytes and payload_digest of responses are taken from the payload that was read.
    """
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for name, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    f.seek(block * ENTRY * ENTRIES)
                    entries = np.frombuffer(f.read(ENTRY * ENTRIES), "<i8").reshape(-1, 4)
                with fs.open_input_file(f"{root}/{name}") as f:
                    for at in range(0, len(entries), 256):
                        rows = [_read(f, *e) for e in entries[at : at + 256].tolist()]
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "html", "payload_digest", "record_type", "payload_bytes", "refers_to"])

    sizes = index.groupBy("file").agg(F.count("*").alias("n"))
    blocks = sizes.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ENTRIES))).alias("block"))
    dealt = blocks.repartition(reducers(spark, 0), "file", "block")  # by a number, which adaptive execution keeps
    return dealt.mapInArrow(run, "page_id long, url string, html string, payload_digest string, record_type string, payload_bytes long, refers_to long")


def _read(file: BinaryIO, page: int, null: int, offset: int, length: int) -> tuple:
    file.seek(offset)
    headers, record = next(records(io.BytesIO(file.read(length))))
    if _number(headers["x-page-id"]) != (None if null else page):
        raise ValueError("the index points to another record")
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    url, kind = headers["warc-target-uri"], headers["warc-type"]
    if kind == "revisit":
        return None if null else page, url, None, digest, kind, size, _number(headers["x-refers-to-page-id"])
    n = int(headers["content-length"])
    payload = record[len(record) - 4 - n : len(record) - 4]
    if len(payload) != size or digest32(payload) != digest:
        raise ValueError("the payload does not have the digest of its header")
    return None if null else page, url, payload.decode(), digest, kind, len(payload), None


def warc_digest(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read them back: (id_col, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    read = read_archives(write_archives(pages, folder, id_col, html_col, url_col, min_bytes), folder)
    return read.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
