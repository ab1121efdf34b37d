"""Media columns: Ogg bitstreams in a binary column.

``demux`` verifies each page's checksum, finds the streams that are multiplexed in one file, puts packets together from
the lacing values across pages, and turns granule positions into seconds by the stream's codec. ``mux`` writes such files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import map_batches, pick, table

CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, most significant bit first, no inversions) by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    """granule is that of the page on which the packet is the last to end, else None; gap: data is missing before it."""

    serial: int
    number: int
    payload: bytes
    granule: int | None
    gap: bool


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


@dataclass
class Stream:
    sequence: int | None = None
    partial: list[bytes] | None = None
    packets: int = 0
    gap: bool = False
    bad: bool = False
    header: bytes = field(default=b"")


def pages(data: bytes) -> Iterator[Page | None]:
    """The intact pages of data; None for each stretch of bytes that isn't one (the reader then seeks the next capture)."""
    at, lost = 0, False
    while at < len(data):
        if data[at : at + 4] == b"OggS" and at + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if not version and len(lacing) == n and end <= len(data):
                if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc:
                    if lost:
                        yield None
                    yield Page(flags, granule, serial, sequence, lacing, data[at + 27 + n : end])
                    at, lost = end, False
                    continue
        lost = True
        after = data.find(b"OggS", at + 1)
        at = len(data) if after < 0 else after
    if lost:
        yield None


def packets(data: bytes) -> Iterator[Packet]:
    """Packets of all streams, in the order in which they end."""
    streams: dict[int, Stream] = {}
    for page in pages(data):
        if page is None:
            continue
        s = streams.setdefault(page.serial, Stream())
        if s.sequence is not None and page.sequence != (s.sequence + 1) & 0xFFFFFFFF or s.sequence is None and not page.flags & FIRST:
            s.partial, s.gap = None, True
        s.sequence = page.sequence
        skip = False
        if page.flags & CONTINUED:
            # What was begun on a lost page can't be completed.
            skip = s.partial is None
            s.gap |= skip
        elif s.partial is not None:
            s.partial, s.gap = None, True
        at, ends = 0, []
        piece = 0
        for value in page.lacing:
            piece += value
            if value < 255:
                whole = page.body[at : at + piece]
                at, piece = at + piece, 0
                if skip:
                    skip = False
                    continue
                ends.append(b"".join([*(s.partial or ()), whole]))
                s.partial = None
        if page.lacing and page.lacing[-1] == 255 and not skip:
            s.partial = [*(s.partial or ()), page.body[at : at + piece]]
        for k, payload in enumerate(ends):
            granule = page.granule if k == len(ends) - 1 and page.granule >= 0 else None
            yield Packet(page.serial, s.packets, payload, granule, s.gap)
            s.packets, s.gap = s.packets + 1, False


@dataclass(frozen=True)
class Codec:
    """How granule positions count: ``rate`` units a second after ``skip``, or frames since a key frame below ``shift`` bits."""

    name: str
    rate: float = 0.0
    skip: int = 0
    shift: int = 0

    def units(self, granule: int | None) -> int | None:
        if granule is None or not self.rate:
            return None
        return (granule >> self.shift) + (granule & ((1 << self.shift) - 1)) if self.shift else granule - self.skip

    def seconds(self, granule: int | None) -> float | None:
        units = self.units(granule)
        return None if units is None else max(0, units) / self.rate


def codec(header: bytes) -> Codec:
    """By the first packet of a stream."""
    try:
        if header[:8] == b"OpusHead":
            return Codec("opus", 48000.0, struct.unpack_from("<H", header, 10)[0])
        if header[:7] == b"\x01vorbis":
            return Codec("vorbis", float(struct.unpack_from("<I", header, 12)[0]))
        if header[:7] == b"\x80theora":
            above, below = struct.unpack_from(">II", header, 22)
            return Codec("theora", above / below if below else 0.0, 0, (struct.unpack_from(">H", header, 40)[0] >> 5) & 31)
        if header[:8] == b"Speex   ":
            return Codec("speex", float(struct.unpack_from("<I", header, 36)[0]))
        if header[:5] == b"\x7fFLAC":
            return Codec("flac", float(int.from_bytes(header[27:30], "big") >> 4))
    except struct.error:
        pass
    return Codec("unknown")


def mux(streams: dict[int, list[tuple[bytes, int]]], segments: int = 16) -> bytes:
    """One file of several streams of (packet, granule): a page for each first packet, then pages in turn."""
    queues: list[list[bytes]] = []
    for serial, items in streams.items():
        made: list[bytes] = []
        lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST

        def flush(last: bool) -> None:
            nonlocal lacing, body, granule, flags
            head = _HEADER.pack(b"OggS", 0, flags | (LAST if last else 0), granule, serial, len(made), 0, len(lacing))  # noqa: B023
            page = head + bytes(lacing) + bytes(body)
            made.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])  # noqa: B023
            flags = CONTINUED if lacing and lacing[-1] == 255 else 0
            lacing, body, granule = bytearray(), bytearray(), -1

        for k, (payload, end) in enumerate(items):
            values = [255] * (len(payload) // 255) + [len(payload) % 255]
            at = 0
            for v in values:
                if len(lacing) == segments:
                    flush(False)
                lacing.append(v)
                body += payload[at : at + v]
                at += v
            granule = end
            if k == 0 and len(items) > 1:
                flush(False)
        if items:
            flush(True)
        queues.append(made)
    out = []
    for turn in range(max(map(len, queues), default=0)):
        out += [q[turn] for q in queues if turn < len(q)]
    return b"".join(out)


OPUS = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0)
VORBIS = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 44100, 0, 64000, 0, 0xB8, 1)


def wrap(text: str, size: int = 1200) -> bytes:
    """A file of two streams that carry the text's bytes in packets of ``size``, in turn: 20 ms Opus, 1024-sample Vorbis."""
    data = text.encode()
    chunks = [data[k : k + size] for k in range(0, len(data), size)]
    opus = [(OPUS, 0)] + [(c, 312 + 960 * (k + 1)) for k, c in enumerate(chunks[0::2])]
    vorbis = [(VORBIS, 0)] + [(c, 1024 * (k + 1)) for k, c in enumerate(chunks[1::2])]
    return mux({1: opus, 2: vorbis})


SCHEMA = "doc_id bigint, serial bigint, codec string, packet int, granule bigint, seconds double, gap boolean, payload binary"


def packet_rows(data: bytes) -> list[list]:
    """Packets with their codec; the first packet of a stream, if it is there, names it.

    A page's granule position is the time of its last packet; those that end before it on the page lie evenly between it
    and the position before.
    """
    kinds: dict[int, Codec] = {}
    known: dict[int, int | None] = {}
    waiting: dict[int, list[int]] = {}
    out: list[list] = []
    for p in packets(data):
        if p.serial not in kinds:
            kinds[p.serial] = codec(p.payload) if not p.gap else Codec("unknown")
        kind = kinds[p.serial]
        wait = waiting.setdefault(p.serial, [])
        if p.gap:
            known[p.serial] = None
            wait.clear()
        wait.append(len(out))
        out.append([p.serial, kind.name, p.number, p.granule, None, p.gap, p.payload])
        units = kind.units(p.granule)
        if units is not None:
            before = known.get(p.serial)
            for k, row in enumerate(wait, 1):
                if before is not None or k == len(wait):
                    at = units if k == len(wait) else before + (units - before) * k / len(wait)
                    out[row][4] = max(0, at) / kind.rate
            known[p.serial] = units
            wait.clear()
    return out


def _rows(ids: pa.Array, files: list[bytes | None]) -> pa.RecordBatch:
    at, out = [], []
    for i, data in enumerate(files):
        for row in packet_rows(data or b""):
            at.append(i)
            out.append(row)
    cols = list(zip(*out, strict=True)) or [()] * 7
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.binary())
    names = ["doc_id", "serial", "codec", "packet", "granule", "seconds", "gap", "payload"]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)


def apply(media: DataFrame, column: str = "media") -> DataFrame:
    """(doc_id, serial, codec, packet, granule, seconds, gap, payload): every whole packet of every row's Ogg file.

    Damaged pages are left out and the next packet of the stream has gap = true; packets that they cut go with them.
    granule is that of the packet that ends a page last, null for others. seconds is its time; for the packets before it
    on the page, the time evenly between it and the last known one, which is exact where packets last equally long; null
    where that is lost, and for unknown codecs. Null, empty and foreign bytes have no packet and so no row. A file, and a
    packet of however many segments and pages, is worked on whole. Repeated rows repeat their packets; null ids stay null;
    an empty table gives an empty result. Other columns are ignored.
    """
    return map_batches(pick(media, doc_id="doc_id", media=column), lambda b: _rows(b.column(0), b.column(1).to_pylist()), SCHEMA, 200)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Ogg files and back: the tables hold no media, so each text is wrapped first.

    Of every 97 files one has a byte flipped in the middle, so that its page must fail the checksum.
    """

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = None if text is None else wrap(text)
            if data and doc is not None and doc % 97 == 3:
                data = data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 1]) + data[len(data) // 2 + 1 :]
            files.append(data)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return apply(map_batches(docs, both, "doc_id bigint, media binary", 200))
