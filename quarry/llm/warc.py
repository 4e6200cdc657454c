"""WARC 1.1 archives: one gzip member a record, written and read in order.

The writer gives every row a response record, or a revisit record where an
equal payload is kept elsewhere; archives are cut at ``archive_bytes``.  A task
that is run again writes other files, and only the files that its successful
attempt lists in the manifest are ever read.  The reader inflates a member block
by block and frames and digests the record, by its Content-Length, as the blocks
come, so a record of any length is read in little memory.

The folder is reached through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; a null or empty url becomes the
record's own id; line breaks in a url are percent-encoded; equal payloads of
fewer than ``least`` bytes are all responses; rows that repeat a page_id and its
html are all responses or all revisits; rows that repeat a page_id with other
html are records of one record id, each read back; a payload of any length is
one record; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._text import lean
from quarry.llm._cluster import fresh_dir, small_batches, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def number(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d*)>", record_id)
    if not found:
        raise ValueError(f"not a page's record: {record_id}")
    return int(found[1]) if found[1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; with ``refers_to`` a revisit, whose HTTP header still tells the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip() or name(page_id)[1:-1]
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def inflated(source) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether a member ends with them) of the gzip members of a binary stream; no more than BLOCK bytes are inflated at a time."""
    rest = b""
    while rest or (rest := source.read(BLOCK)):
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not rest and not (rest := source.read(BLOCK)):
                raise ValueError("the archive ends within a member")
            data = inflate.decompress(rest, BLOCK)
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            yield data, inflate.eof


def members(source) -> Iterator[bytes]:
    """The inflated gzip members of a binary stream, one after the other."""
    parts = []
    for data, last in inflated(source):
        parts.append(data)
        if last:
            yield b"".join(parts)
            parts = []


def _named(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields of a header; names are in lower case."""
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Framed:
    """A record that is framed by its Content-Length and digested as its bytes come; its payload is kept if asked for."""

    def __init__(self, keep: bool = True):
        self.head, self.fields, self.left, self.tail = b"", None, 0, b""
        self.http_head, self.http, self.size = b"", None, 0
        self.block, self.payload, self.parts = hashlib.sha1(), hashlib.sha1(), [] if keep else None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if (cut := self.head.find(b"\r\n\r\n")) < 0:
                return
            version, self.fields = _named(self.head[:cut])
            if not version.startswith("WARC/1."):
                raise ValueError(f"not a record: {version[:40]!r}")
            self.left, data, self.head = int(self.fields["content-length"]), self.head[cut + 4 :], b""
        own, after = data[: self.left], data[self.left :]
        self.left -= len(own)
        self.block.update(own)
        if own:
            self._http(own)
        self.tail += after
        if len(self.tail) > 4:
            raise self._broken()

    def _http(self, own: bytes) -> None:
        if self.http is None:
            self.http_head += own
            if (cut := self.http_head.find(b"\r\n\r\n")) < 0:
                return
            self.http, own, self.http_head = _named(self.http_head[:cut])[1], self.http_head[cut + 4 :], b""
        self.payload.update(own)
        self.size += len(own)
        if self.parts is not None:
            self.parts.append(own)

    def _broken(self) -> ValueError:
        return ValueError(f"{(self.fields or {}).get('warc-record-id')}: the block doesn't have its Content-Length")

    def end(self) -> bool:
        """Whether the digests hold, once all of the record has come."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n" or self.http is None:
            raise self._broken()
        named = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        return named(self.block) == self.fields["warc-block-digest"] and (self.fields["warc-type"] == "revisit" or named(self.payload) == self.fields["warc-payload-digest"])


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes, bool]:
    """(WARC fields, HTTP fields, payload, whether the digests hold) of one record; names are in lower case."""
    record = Framed()
    record.feed(raw)
    ok = record.end()
    return record.fields, record.http, b"".join(record.parts), ok


def framed(source, keep: bool = False) -> Iterator[tuple[Framed, bool]]:
    """The records of an archive and whether their digests hold, one at a time; but for payloads that are asked for, a block at a time is in memory."""
    record = Framed(keep)
    for data, last in inflated(source):
        record.feed(data)
        if last:
            yield record, record.end()
            record = Framed(keep)


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest page_id with an equal payload of at least ``least`` bytes, null on that row and on small ones."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= least).select("page_id", "key")
    kept = stored(large.groupBy("key").agg(F.max("page_id").alias("kept")), "kept")  # a table: a join of plain exchanges, which Spark may split where a payload is frequent
    other = (F.octet_length("html") >= least) & (F.col("kept") != F.coalesce("page_id", F.col("kept") - 1))
    return rows.join(kept, "key", "left").select("page_id", "url", "html", F.when(other, F.col("kept")).alias("refers_to"))


def write(planned: DataFrame, folder: str, archive_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of ``plan`` into ``folder`` and returns the manifest (path, records, bytes), itself a stored table."""
    small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = gz.compress(record(page_id, url, html.encode(), refers_to, date)) + gz.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(planned.mapInArrow(lean(run), "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row a record of the listed archives: page_id, url, payload_bytes, payload_digest (hexadecimal), record_type, refers_to, verified and, if asked for, payload (null for revisits)."""
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for record, ok in framed(source, payloads):
                        fields, kind, size = record.fields, record.fields["warc-type"], int(record.http["content-length"])
                        ok = ok and (kind == "revisit" or size == record.size)
                        hexed = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = fields.get("warc-refers-to")
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], size, hexed, kind, number(refers) if refers else None, ok, b"".join(record.parts) if payloads and kind == "response" else None))
                        if len(rows) >= 500:
                            yield _batch(rows, payloads)
                            rows = []
                yield _batch(rows, payloads)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
    return manifest.select("path").repartition(max(1, min(n, 10_000))).mapInArrow(lean(run), kinds + ", payload binary" * payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())]
    kinds = kinds if payloads else kinds[:-1]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])


def round_trip(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes the pages and reads the archives back; a record whose digests fail, or a revisit whose digest isn't its response's, ends the query."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    back = stored(read(write(plan(pages, **how), folder), folder), "records")
    revisits = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest")
    lost = revisits.join(back.where("record_type = 'response'").select("page_id", "payload_digest"), ["page_id", "payload_digest"], "left_anti").first()
    if lost:
        raise ValueError(f"page {lost[0]}: a revisit's payload isn't that of its response")
    return back.where(F.coalesce("verified", F.lit(False)) | F.raise_error(F.concat(F.lit("digest of page "), F.col("page_id").cast("string"))).cast("boolean")).drop("verified")
