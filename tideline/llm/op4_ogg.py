"""Media columns: texts stored losslessly as 8-bit samples in Ogg, verified and read back.

Writing makes two logical streams in one physical stream, pages interleaved: the samples in
packets of PACKET bytes, and a small stream of marks (one packet with the running sample count
for each sample page). A page carries at most 255 lacing values; a packet that ends on a
multiple of 255 is closed by a lacing value 0. Granule positions count samples.

Reading trusts nothing: it checks capture pattern, version, page checksum, page sequence and
the continued flag, reassembles packets from the lacing values, sorts them by serial number,
and takes timestamps from granule positions. A damaged stream raises OggError.

Null and empty texts give 64 bytes 0. Everything derives from the text alone, so equal texts
have equal values. Only ``doc_id`` and ``text`` are read, so clashing names of other columns
don't matter; empty tables give empty results; long texts become more pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

RATE = 8000
BLOCK = 64
PACKET = 4096
SAMPLES, MARKS = 1, 2
BEGIN, END, CONTINUED = 2, 4, 1
NO_PACKET_ENDS = (1 << 64) - 1
HEAD = struct.Struct("<4sBBqIIIB")

#: Bits of every byte in reverse: the page checksum is zlib's polynomial read the other way round.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start 0, no final inversion."""
    low_first = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    serial: int
    number: int
    flags: int
    granule: int
    lacing: bytes
    body: bytes

    def pack(self) -> bytes:
        raw = bytearray(HEAD.pack(b"OggS", 0, self.flags, self.granule if self.granule != NO_PACKET_ENDS else -1, self.serial, self.number, 0, len(self.lacing)))
        raw += self.lacing
        raw += self.body
        raw[22:26] = checksum(bytes(raw)).to_bytes(4, "little")
        return bytes(raw)


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class StreamWriter:
    """Pages of one logical stream; ``packets`` come as (bytes, granule position at their end)."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], flags: int = 0, last: bool = False) -> list[Page]:
        lacing, body, ends = bytearray(), bytearray(), []
        for data, granule in packets:
            lacing += lace(len(data))
            body += data
            ends.append((len(lacing), granule))
        out, at, pos, k = [], 0, 0, 0
        while at < len(lacing):
            part = bytes(lacing[at : at + 255])
            size = sum(part)
            granule = NO_PACKET_ENDS
            while k < len(ends) and ends[k][0] <= at + len(part):
                granule = ends[k][1]
                k += 1
            fl = flags if not out else 0
            if at and lacing[at - 1] == 255:
                fl |= CONTINUED
            at += len(part)
            if last and at >= len(lacing):
                fl |= END
            out.append(Page(self.serial, self.number, fl, granule, part, bytes(body[pos : pos + size])))
            self.number += 1
            pos += size
        return out


def write(payload: bytes) -> bytes:
    """The physical stream of a payload of 8-bit samples."""
    samples, marks = StreamWriter(SAMPLES), StreamWriter(MARKS)
    out = samples.pages([(b"PCM8" + struct.pack("<BIQ", 1, RATE, len(payload)), 0)], BEGIN)
    out += marks.pages([(b"MARK" + struct.pack("<B", 1), 0)], BEGIN)
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    per_page = 255 // (PACKET // 255 + 1)
    for i in range(0, len(packets), per_page):
        group = packets[i : i + per_page]
        end = i + per_page >= len(packets)
        out += samples.pages(group, last=end)
        out += marks.pages([(struct.pack("<Q", group[-1][1]), group[-1][1])], last=end)
    return b"".join(p.pack() for p in out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Seconds at the end of each page on which a packet ends.
    timestamps: list[float] = field(default_factory=list)
    pages: int = 0
    granule: int = 0
    ended: bool = False
    _open: bytearray | None = None


def read(media: bytes, rate: int = RATE) -> dict[int, LogicalStream]:
    """Logical streams by serial number."""
    streams: dict[int, LogicalStream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if at + 27 > len(media):
            raise OggError("the last page is cut short")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if at + size > len(media):
            raise OggError("the last page is cut short")
        raw = bytearray(view[at : at + size])
        raw[22:26] = b"\0\0\0\0"
        if checksum(bytes(raw)) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & BEGIN:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = LogicalStream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != (s._open is not None):
            raise OggError(f"stream {serial} lost a part of a packet")
        body, pos, ended = at + 27 + n, 0, False
        for x in lacing:
            s._open = s._open if s._open is not None else bytearray()
            s._open += view[body + pos : body + pos + x]
            pos += x
            if x < 255:
                s.packets.append(bytes(s._open))
                s._open, ended = None, True
        if ended:
            if granule < s.granule:
                raise OggError(f"granule positions of stream {serial} fall")
            s.granule = granule
            s.timestamps.append(granule / rate)
        s.pages += 1
        s.ended = bool(flags & END)
        at += size
    for s in streams.values():
        if s._open is not None or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def samples(streams: dict[int, LogicalStream]) -> bytes:
    """The samples, checked against the header and the marks."""
    s, marks = streams[SAMPLES], streams[MARKS]
    head = s.packets[0]
    _, rate, total = struct.unpack_from("<BIQ", head, 4)
    out = b"".join(s.packets[1:])
    if head[:4] != b"PCM8" or len(out) != total or s.granule != total or struct.unpack("<Q", marks.packets[-1])[0] != total:
        raise OggError("sample counts differ")
    return out


def features(streams: dict[int, LogicalStream], payload: bytes) -> str:
    """Duration and levels of the samples, taken as unsigned 8-bit around 128."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    level = np.arange(256, dtype=np.int64) - 128
    total, square = int((counts * level).sum()), int((counts * level * level).sum())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    s = streams[SAMPLES]
    return f"duration={s.timestamps[-1]:.6f};packets={len(s.packets)};pages={sum(v.pages for v in streams.values())};mean={total / len(x):.6f};rms={(square / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.flatnonzero(counts)[-1])}"


def pad(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8")
    return len(raw), raw + bytes((-len(raw)) % BLOCK if raw else BLOCK)


def media_table(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """(doc_id, n_bytes, digests, feature[, media binary]) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if keep_media:
        names, types, schema = [*names, "media"], [*types, pa.binary()], f"{schema}, media binary"

    def make():
        def one(text: str) -> tuple:
            n, payload = pad(text)
            media = write(payload)
            streams = read(media)
            back = samples(streams)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(streams, back))
            return (*row, media) if keep_media else row

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return C.records(names, [b.column(0), *zip(*map(one, C.texts_of(b)))], types)

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, schema)


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(C.read(spark, sf_dir, "documents"), keep_media=False)
