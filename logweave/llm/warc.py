"""WARC archives in seekable Zstandard bundles.

A bundle holds whole records in independent Zstandard frames of about FRAME bytes each, then a skippable frame with the
sizes of the frames and the footer of the Zstandard seekable format.  An index maps each record to its frame and to its
offset and length inside the unpacked frame, so a record is read by unpacking one frame.

Bundles and indexes are rows of a table that Spark writes and reads; export_files() gives each bundle a file.  Payloads are told apart by SHA-256; of equal ones
of at least `least` bytes, the record with the smallest page_id is the response and the others revisit it.

Digests are counted before they are shuffled.  A task holds one bundle.  Null html is an empty payload; null page_ids
come after all others, and if a payload has no other they are all responses, as are repeated rows of the smallest
page_id; a null url is the empty URI; html of any length is one record; no pages give no bundles; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Bytes of records in a frame and in a bundle; Zstandard's level.
FRAME, BUNDLE, LEVEL = 256 << 10, 8 << 20, 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>"


class Seekable:
    """Packs byte strings into frames; add() says where each went."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.held and self.size + len(data) > FRAME:
            self._end_frame()
        at = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)
        return at

    def _end_frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(b"".join(self.held))
        self.frames.append(packed)
        self.table.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> bytes:
        if self.held:
            self._end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(where it begins, packed size, unpacked size) of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    first = len(bundle) - 9 - n * width
    if struct.unpack_from("<II", bundle, first - 8) != (SKIPPABLE, n * width + 9):
        raise ValueError("the seek table's frame is damaged")
    out, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, first + k * width)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(size, 1))


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, by its place in the index."""
    return read_frame(bundle, seek_table(bundle)[frame])[offset : offset + length]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    uri = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    """(first line, fields by lower-case name, where the block begins)."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, end + 4


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at `at`, and where it ends."""
    version, fields, begin = headers(data, at)
    if not version.startswith("WARC/1."):
        raise ValueError(f"no record at {at}")
    end = begin + int(fields["content-length"])
    _, http, body = headers(data, begin)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end")
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or -1) if x != "<urn:page:>" else None
    refers = fields.get("warc-refers-to")
    out = {"page_id": page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_bytes": int(http["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "refers_to": page(refers) if refers else None, "payload": data[body:end]}
    return out, end + 4


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    bundle, index = Seekable(), []

    def flush() -> pa.RecordBatch:
        nonlocal bundle, index, n
        kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        out = pa.RecordBatch.from_arrays([pa.array([task << 32 | n]), pa.array([bundle.close()], pa.binary()), pa.array([index], kind)], names=["bundle", "bytes", "records"])
        bundle, index, n = Seekable(), [], n + 1
        return out

    for b in batches:
        for k in range(b.num_rows):
            page_id, url, html, digest, refers_to = (x[k].as_py() for x in b.columns)
            frame, offset, length = bundle.add(record(page_id, url, (html or "").encode(), digest, refers_to))
            index.append({"page_id": page_id, "frame": frame, "offset": offset, "length": length})
            if bundle.total >= BUNDLE:
                yield flush()
    if index:
        yield flush()


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle long, frame int, offset long, length long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in READ.split(", ")]
    for b in batches:
        for number, data, records in zip(*(b.column(x) for x in ("bundle", "bytes", "records")), strict=True):
            data, records, rows, k = data.as_py(), records.as_py(), [], 0
            for f, frame in enumerate(seek_table(data)):
                text, at = read_frame(data, frame), 0
                while at < len(text):
                    r, end = parse(text, at)
                    if records[k] != {"page_id": r["page_id"], "frame": f, "offset": at, "length": end - at}:
                        raise ValueError(f"the index of bundle {number} does not match its records")
                    if r["record_type"] == "response" and (len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()) != (r["payload_bytes"], r["payload_digest"]):
                        raise ValueError(f"page {r['page_id']} is damaged")
                    rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"], number.as_py(), f, at, end - at))
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_bundles(pages: DataFrame, *, least: int = 100) -> DataFrame:
    """A table (bundle, bytes, records) of pages(page_id, url, html), written to the shared folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = pages.withColumn("large", F.when(F.octet_length("html") >= least, F.col("digest")))
    # Counted before it is shuffled; the html of a digest that very many pages have is dealt to all tasks.
    copies = large.where("large is not null").groupBy("large").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    told = c.attach(large, c.stored(copies, "copies"), "large", salt=["page_id", "digest"], width=128)
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return c.stored(c.map_arrow(told.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")), _write, f"bundle long, bytes binary, records {RECORDS}"), "warc")


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """(bundle, file, size): every bundle as a file <bundle>.warc.zst below a folder that all executors reach.

    Any Zstandard reader unpacks such a file to plain WARC records; its seek table is a frame that readers skip.  A file is
    written under another name first and then renamed, so a task that is run again leaves whole files only.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = [], []
            for number, data in zip(b.column("bundle").to_pylist(), b.column("bytes"), strict=True):
                name, part = f"{root}/{number:016d}.warc.zst", f"{root}/.{number:016d}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                fs.move(part, name)
                names.append(name)
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([b.column("bundle"), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["bundle", "file", "size"])

    return c.map_arrow(bundles.select("bundle", "bytes"), kernel, "bundle long, file string, size long")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, unpacked frame by frame, checked against the index and its digest."""
    return c.map_arrow(bundles.select("bundle", "bytes", "records"), _read, READ)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
