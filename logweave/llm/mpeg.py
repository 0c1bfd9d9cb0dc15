"""MPEG audio columns: byte payloads in Layer III streams, and a reader of such streams.

Writer: an ID3v2 tag with the payload's length, a frame with a Xing table, then frames of MPEG-1 Layer III, mono, each
with a checksum, silent side information and the payload as ancillary bytes; the last frame has the smallest bitrate
that holds the rest.  The media are a column of a table that Spark writes and reads.

Reader: skips ID3v2 and ID3v1 tags, finds the first header that is followed by another of its kind, and goes from
header to header; where one does not follow, it looks for the next that does.  It parses Xing, Info and VBRI tables,
verifies checksums, and gives exact durations in samples and the byte offset of every frame.

A row's media take its text's bytes and a fortieth more, and a text of any length is one row's.  Null text is empty;
repeated rows and equal texts get equal media; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version (1, or 2 and 2.5) and layer, Hz by version.
BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
SIDE = 17
UNIT = 64
KEY = b"payload-bytes"


@lru_cache(1 << 14)
def checksum(data: bytes) -> int:
    """CRC-16 of polynomial 0x8005 from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(1 << 12)
def header(data: bytes) -> tuple | None:
    """(version, layer, protected, bitrate, rate, mono, size, samples) of four bytes, or None."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(data[1] >> 3 & 3), 4 - (data[1] >> 1 & 3)
    index, rate, padding = data[2] >> 4, data[2] >> 2 & 3, data[2] >> 1 & 1
    if version is None or layer == 4 or rate == 3 or not 0 < index < 15:
        return None
    kbits = BITRATES[min(int(version + 0.5), 2) if version != 1 else 1, layer][index - 1]
    hertz = RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    return version, layer, not data[1] & 1, kbits, hertz, data[3] >> 6 == 3, size, samples


def frame(kbits_index: int, protected: bool, body: bytes) -> bytes:
    """A frame of MPEG-1 Layer III at 44.1 kHz, mono, filled up with zeros."""
    head = bytes([0xFF, 0xFA if protected else 0xFB, kbits_index << 4, 0xC0])
    side = bytes(SIDE)
    crc = checksum(head[2:] + side).to_bytes(2, "big") if protected else b""
    return (head + crc + side + body).ljust(header(head)[6], b"\0")


ROOM = [header(bytes([0xFF, 0xFA, i << 4, 0xC0]))[6] - 6 - SIDE for i in range(1, 15)]


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(text: bytes) -> bytes:
    """The media of a payload."""
    payload = text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")
    full = frame(14, True, b"")[: 6 + SIDE]
    cut = len(payload) // ROOM[-1] * ROOM[-1]
    frames = [full + payload[i : i + ROOM[-1]] for i in range(0, cut, ROOM[-1])]
    if rest := payload[cut:]:
        frames.append(frame(next(i for i, room in enumerate(ROOM, 1) if room >= len(rest)), True, rest))
    value = b"\x03" + KEY + b"\0" + f"{len(text)}/{len(payload)}".encode()
    tag = b"TXXX" + synchsafe(len(value)) + b"\0\0" + value
    sizes = np.array([len(x) for x in frames])
    lead = header(bytes([0xFF, 0xFB, 0x50, 0xC0]))[6]
    total = lead + int(sizes.sum())
    at = lead + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    toc = (at[np.arange(100) * len(frames) // 100] * 256 // total).astype(np.uint8).tobytes()
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"ID3\x04\0\0" + synchsafe(len(tag)) + tag + frame(5, False, xing) + b"".join(frames)


def tags(data: bytes) -> tuple[dict[bytes, bytes], int]:
    """(TXXX values of ID3v2 tags, where audio begins)."""
    found, at, end = {}, 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        major, flags = data[at + 3], data[at + 5]
        size = sum((data[at + 6 + k] & 0x7F) << s for k, s in enumerate((21, 14, 7, 0)))
        x, stop = at + 10, at + 10 + size
        if flags & 0x40:
            x += int.from_bytes(data[x : x + 4], "big") + (4 if major == 3 else 0) if major == 3 else sum((data[x + k] & 0x7F) << s for k, s in enumerate((21, 14, 7, 0)))
        while x + 10 <= stop and data[x]:
            n = sum((data[x + 4 + k] & 0x7F) << s for k, s in enumerate((21, 14, 7, 0))) if major == 4 else int.from_bytes(data[x + 4 : x + 8], "big")
            if data[x : x + 4] == b"TXXX":
                name, _, value = data[x + 11 : x + 10 + n].partition(b"\0")
                found[name] = value
            x += 10 + n
        at = stop + (10 if flags & 0x10 else 0)
    return found, at


def at_end(data: bytes, at: int) -> bool:
    """Whether nothing, or only an ID3v1 tag, is left.  Such a tag's letters inside a frame are part of the frame."""
    return at == len(data) or at == len(data) - 128 and data[at : at + 3] == b"TAG"


def follows(data: bytes, at: int, end: int, kind: tuple | None) -> tuple | None:
    """The header at `at`, if it is of that kind and its frame ends at the end or at another such header."""
    h = header(data[at : at + 4])
    if h is None or at + h[6] > end or kind and (h[0], h[1], h[4]) != kind:
        return None
    if at_end(data, at + h[6]):
        return h
    n = header(data[at + h[6] : at + h[6] + 4])
    return h if n and (n[0], n[1], n[4]) == (h[0], h[1], h[4]) else None


def table_of(data: bytes, at: int, h: tuple) -> tuple[str, int | None, int | None, bytes] | None:
    """(name, frames, bytes, table of contents) of a Xing, Info or VBRI header in a frame."""
    side = (17 if h[5] else 32) if h[0] == 1 else (9 if h[5] else 17)
    x = at + 4 + (2 if h[2] else 0) + side
    if (name := data[x : x + 4]) in (b"Xing", b"Info"):
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out: list = [name.decode(), None, None, b""]
        for k, n in ((1, 4), (2, 4), (3, 100)):
            if flags >> k - 1 & 1:
                out[k] = data[x : x + n] if k == 3 else int.from_bytes(data[x : x + n], "big")
                x += n
        return tuple(out)
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        size, frames, entries, _, width = struct.unpack_from(">IIHHH", data, x + 10)
        return "VBRI", frames, size, data[x + 26 : x + 26 + entries * width]
    return None


def decode(data: bytes) -> dict:
    """What a stream holds: frames, samples, rate, seek offsets, checksums, table, bytes skipped, and ancillary bytes."""
    (found, at), end = tags(data), len(data)
    begin, kind, table, skipped = at, None, None, 0
    seek: list[int] = []
    good = bad = samples = kbits = 0
    body: list[bytes] = []
    while at + 4 <= end and not at_end(data, at):
        h = header(data[at : at + 4])
        if h is None or at + h[6] > end or kind is None and not follows(data, at, end, None) or kind and (h[0], h[1], h[4]) != kind:
            at, skipped = at + 1, skipped + 1
            while at + 4 <= end and not at_end(data, at):  # look for the next header that another one follows
                x = data.find(b"\xff", at, end)
                x = end if x < 0 else x
                at, skipped = x, skipped + x - at
                if x >= end or follows(data, x, end, kind):
                    break
                at, skipped = at + 1, skipped + 1
            continue
        kind = kind or (h[0], h[1], h[4])
        if not seek and table is None and h[1] == 3 and (table := table_of(data, at, h)):
            at += h[6]
            continue
        side = ((17 if h[5] else 32) if h[0] == 1 else (9 if h[5] else 17)) if h[1] == 3 else 0
        x = at + 4
        if h[2]:
            if h[1] == 3:
                same = checksum(data[at + 2 : at + 4] + data[x + 2 : x + 2 + side]) == int.from_bytes(data[x : x + 2], "big")
                good, bad = good + same, bad + (not same)
            x += 2
        body.append(data[x + side : at + h[6]])
        seek.append(at)
        samples += h[7]
        kbits += h[3]
        at += h[6]
    n_bytes, _, padded = found.get(KEY, b"0/0").partition(b"/")
    return {
        "n_bytes": int(n_bytes), "payload": b"".join(body)[: int(padded)], "frames": len(seek), "samples": samples, "rate": kind[2] if kind else 0, "seek": seek, "good": good, "bad": bad,
        "skipped": skipped + (0 if at_end(data, at) else end - at), "table": table, "kind": kind, "mean_kbits": kbits // max(len(seek), 1), "audio_bytes": end - begin,
    }


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = c.utf8(b.column(1))
        for i, j in c.slices(at):
            media = [encode(data[x:y].tobytes()) for x, y in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(media, pa.binary())], names=["doc_id", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, seek_offsets array<long>"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    for b in batches:
        for i in range(0, b.num_rows, 500):
            rows = []
            for id_, media in zip(b.column(0).slice(i, 500).to_pylist(), b.column(1).slice(i, 500).to_pylist(), strict=True):
                x = decode(media)
                table = x["table"]
                offsets = zlib.crc32(np.array(x["seek"], dtype="<i8").tobytes())
                feature = f"v{x['kind'][0]} layer {x['kind'][1]}, {x['rate']} Hz, {x['frames']} frames, {x['samples']}/{x['rate']} s, {x['mean_kbits']} kbit/s, checksums {x['good']} good {x['bad']} bad, {table[0] if table else 'no table'} {table[1] if table else ''}, {x['skipped']} skipped, seek {offsets:08x}" if x["kind"] else "no audio"
                p = x["payload"]
                rows.append((id_, x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["samples"], x["rate"], x["seek"]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_media(docs: DataFrame) -> DataFrame:
    """A table (doc_id, media) of docs(doc_id, text), written to the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return c.stored(c.map_arrow(docs, _encode, "doc_id long, media binary"), "media")


def read_media(media: DataFrame) -> DataFrame:
    """Payload digests, exact durations and seek offsets of every row of media(doc_id, media)."""
    return c.map_arrow(media.select("doc_id", "media"), _features, FEATURES)
