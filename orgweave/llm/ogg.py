"""Ogg media columns: mux, demux and features.

The container is written and read from its page layout: capture pattern, granule position, serial and sequence number, checksum,
lacing values. The payload is stored as 8-bit mono samples in one logical stream; a second stream carries a header packet that says how many bytes
of it are text. Pages of the two streams are interleaved. Reading verifies every page's checksum and sequence number, joins
packets from lacing values (over page ends too), sorts them out by serial number and derives each packet's start and end from the granule positions of
the pages: a page's position is the end of the last packet that it completes, and the packets before that one end where their successors begin.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import small_batches

PAD_TO = 192
RATE = 8000
PACKET = 4096
SAMPLES_SERIAL, HEADER_SERIAL = 0x53414D50, 0x48454144
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_PAGE = "<4sBBqIIIB"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A stream that breaks the container's rules."""


def page_checksum(page: bytes) -> int:
    """CRC-32, polynomial 0x04C11DB7, most significant bit first, from 0, nothing inverted.

    That is zlib's CRC of the bit-reversed bytes, bit-reversed, with its inversions undone.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _lacing(size: int) -> list[int]:
    return [255] * (size // 255) + [size % 255]


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: list[int], body: bytes) -> bytes:
    head = struct.pack(_PAGE, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
    whole = head + body
    return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); -1 marks a page on which no packet ends."""
    segments: list[tuple[int, bytes, int]] = []
    for data, granule in packets:
        at = 0
        sizes = _lacing(len(data))
        for i, size in enumerate(sizes):
            segments.append((size, data[at : at + size], granule if i == len(sizes) - 1 else -1))
            at += size
    out = []
    for sequence, lo in enumerate(range(0, len(segments), 255)):
        part = segments[lo : lo + 255]
        flags = (_CONTINUED if lo and segments[lo - 1][2] == -1 else 0) | (_FIRST if lo == 0 else 0) | (_LAST if lo + 255 >= len(segments) else 0)
        ends = [g for _, _, g in part if g != -1]
        out.append(_page(serial, sequence, flags, ends[-1] if ends else -1, [s for s, _, _ in part], b"".join(b for _, b, _ in part)))
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, spaces appended up to a positive multiple of `PAD_TO`; and its unpadded length."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (max(1, -(-len(raw) // PAD_TO)) * PAD_TO - len(raw)), len(raw)


def mux(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of the payload's samples and the header stream."""
    header = struct.pack("<8sIQQ", b"ORGWAV01", RATE, n_bytes, len(payload))
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples = _pages(SAMPLES_SERIAL, packets)
    first, *rest = _pages(HEADER_SERIAL, [(header, 0), (struct.pack("<Q", len(payload)), len(payload))])
    # beginning-of-stream pages come first
    return b"".join([samples[0], first, *samples[1:], *rest])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Of each page on which packets end: its granule position and how many end there.
    ends: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    open: bytes | None = None
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number; `OggError` if a page is damaged, missing or out of place."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27:
            raise OggError("a page's header is cut off")
        magic, version, flags, granule, serial, sequence, checksum, n = struct.unpack_from(_PAGE, media, at)
        if magic != b"OggS" or version:
            raise OggError("no capture pattern")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("a page is cut off")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise OggError("checksum differs")
        if bool(flags & _FIRST) != (serial not in streams):
            raise OggError("a stream begins twice or without its first page")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or sequence != s.pages or bool(flags & _CONTINUED) != (s.open is not None):
            raise OggError("a page is missing or out of place")
        s.pages += 1
        p, before = at + 27 + n, len(s.packets)
        for size in lacing:
            s.open = (s.open or b"") + media[p : p + size]
            p += size
            if size < 255:
                s.packets.append(s.open)
                s.open = None
        if (granule != -1) != (len(s.packets) > before):
            raise OggError("a granule position without a packet's end, or the other way round")
        if granule != -1:
            s.ends.append((granule, len(s.packets) - before))
        s.ended = bool(flags & _LAST)
        at = end
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def packet_times(stream: Stream, samples: Callable[[bytes], int] = len) -> list[tuple[int, int]]:
    """(start, end) of each packet, in samples, from the pages' granule positions; `samples` says how many a packet holds. Positions that fall back, or
    that a page's packets reach beyond, raise.

    Where a page's packets hold fewer samples than its position has gone on, the first of them starts late: there is a hole before it.
    """
    out: list[tuple[int, int]] = []
    last = at = 0
    for granule, n in stream.ends:
        end, mine = granule, []
        for packet in reversed(stream.packets[at : at + n]):
            mine.append((end - samples(packet), end))
            end -= samples(packet)
        if end < last:
            raise OggError("packets overlap in time")
        out += reversed(mine)
        last, at = granule, at + n
    return out


def read_payload(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """The stored payload, its unpadded length, and the streams."""
    streams = demux(media)
    if set(streams) != {SAMPLES_SERIAL, HEADER_SERIAL}:
        raise OggError("not the two streams expected")
    magic, _, n_bytes, size = struct.unpack("<8sIQQ", streams[HEADER_SERIAL].packets[0])
    payload = b"".join(streams[SAMPLES_SERIAL].packets)
    times = packet_times(streams[SAMPLES_SERIAL])
    if magic != b"ORGWAV01" or len(payload) != size or times[-1][1] != size or any(a != b for (_, a), (b, _) in pairwise([(0, 0), *times])):
        raise OggError("header, granule positions and samples disagree")
    return payload, n_bytes, streams


def feature_of(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration, the last packet's start and a checksum of all packets' times, from granule positions; page and packet counts; level figures of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean())
    rms = float(np.sqrt(np.square(x.astype(np.float64) - 128).mean()))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    s = streams[SAMPLES_SERIAL]
    times = packet_times(s)
    spans = f"seconds={times[-1][1] / RATE:.6f};last_packet={times[-1][0] / RATE:.6f};times_crc32={zlib.crc32(np.array(times, '<i8').tobytes())}"
    return f"{spans};pages={sum(t.pages for t in streams.values())};packets={len(s.packets)};mean={mean:.4f};rms={rms:.4f};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an Ogg file. Null texts count as empty; equal texts give equal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [mux(*payload_of(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "media"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """One row per row of (doc_id, media) with what was read back, and null figures where media is null. A damaged file raises `OggError`."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 7
        payload, n_bytes, streams = read_payload(media)
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, streams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[one(m.as_py()) for m in batch.column(1)], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
