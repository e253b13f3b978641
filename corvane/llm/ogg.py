"""Ogg media columns: payloads stored in an Ogg physical stream and read back from its bytes.

Writing: two logical streams are multiplexed, pages interleaved: 8-bit samples in packets of
`PACKET` bytes (any bytes, so the payload is kept exactly), and a small description. Pages follow RFC
3533: lacing values, continued packets, granule positions, checksums.

Reading: every page's checksum is verified, packets are put together from lacing values over page
borders, logical streams are told apart by serial number, and the time of every page's last packet is
derived from its granule position and the sample rate. The features are computed from the samples
that were read.

The Ogg checksum (CRC-32, unreflected) is computed with the reflected one of zlib on bit-reversed
bytes, so it runs at memory speed.

How it scales: a map over rows, nothing is shuffled or broadcast; one document at a time is in memory.

Defined results: null text counts as empty (64 zero bytes); equal texts give equal values; a broken
stream (checksum, order, missing end) raises OggError in read(); repeated rows are separate rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, PACKET, UNIT = 8000, 8192, 64
_REVERSE = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes aren't a whole, unbroken Ogg stream."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, start 0, nothing reflected, as Ogg has it."""
    reflected = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSE), "big")


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream. Each packet comes with the granule position at its end; the first stands alone."""
    segments: list[tuple[bytes, int | None, bool]] = []  # bytes, granule position if a packet ends, packet starts
    out: list[bytes] = []

    def flush(last: bool) -> None:
        if not segments and not last:
            return
        ends = [g for _, g, _ in segments if g is not None]
        flags = (0 if not segments or segments[0][2] else _CONTINUED) | (0 if out else _FIRST) | (_LAST if last else 0)
        body = b"".join(s for s, _, _ in segments)
        head = _HEAD.pack(b"OggS", 0, flags, ends[-1] if ends else -1, serial, len(out), 0, len(segments)) + bytes(len(s) for s, _, _ in segments)
        page = head + body
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        segments.clear()

    for n, (packet, granule) in enumerate(packets):
        for at in range(0, len(packet) + 1, 255):
            segment = packet[at : at + 255]
            segments.append((segment, granule if len(segment) < 255 else None, at == 0))
            if len(segments) == 255 and not (n == len(packets) - 1 and len(segment) < 255):
                flush(False)
        if n == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return out


def write(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """`payload` as 8-bit samples, with a second logical stream that describes them."""
    audio = [(b"\x80raw8" + struct.pack("<IQ", rate, len(payload)), 0)]
    audio += [(payload[at : at + packet], min(at + packet, len(payload))) for at in range(0, len(payload), packet)]
    about = [(b"\x81text", 0), (f"samples={len(payload)};rate={rate};bits=8".encode(), 1)]
    a, b = pages_of(audio, 1), pages_of(about, 2)
    return b"".join([a[0], b[0], *(p for i in range(max(len(a), len(b)) - 1) for s in (a, b) for p in s[i + 1 : i + 2])])


class Logical:
    """One logical stream as read: packets, and (seconds, page number) of pages on which a packet ends."""

    def __init__(self):
        self.packets: list[bytes] = []
        self.granules: list[int] = []
        self.part: list[bytes] = []
        self.next_page, self.ended = 0, False


def read(media: bytes) -> dict[int, Logical]:
    """The logical streams by serial number; OggError if anything is broken."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(media):
            raise OggError("a page is cut off")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"page {number} of stream {serial} has a wrong checksum")
        if flags & _FIRST and serial in streams or not flags & _FIRST and serial not in streams:
            raise OggError(f"stream {serial} doesn't start once")
        s = streams.setdefault(serial, Logical())
        if number != s.next_page or s.ended:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & _CONTINUED) != bool(s.part):
            raise OggError(f"page {number} of stream {serial} doesn't continue the last")
        pos, run, complete = at + 27 + n, 0, False
        for value in lacing:
            run += value
            if value < 255:
                s.part.append(media[pos : pos + run])
                s.packets.append(b"".join(s.part))
                s.part, pos, run, complete = [], pos + run, 0, True
        if run or (lacing and lacing[-1] == 255):
            s.part.append(media[pos : pos + run])
        if complete:
            s.granules.append(granule)
        elif granule != -1 and n:
            raise OggError(f"page {number} of stream {serial} has a granule position but ends no packet")
        s.next_page, s.ended = number + 1, bool(flags & _LAST)
        at = end
    if any(not s.ended or s.part for s in streams.values()):
        raise OggError("a stream doesn't end")
    return streams


def payload_of(media: bytes) -> tuple[bytes, int, list[float]]:
    """The samples, their rate, and the end times in seconds of the pages that hold them."""
    for s in read(media).values():
        if s.packets and s.packets[0].startswith(b"\x80raw8"):
            rate, n = struct.unpack_from("<IQ", s.packets[0], 6 - 1)
            payload = b"".join(s.packets[1:])
            if len(payload) != n or s.granules[-1] != n:
                raise OggError("samples are missing")
            return payload, rate, [g / rate for g in s.granules]
    raise OggError("no stream of samples")


def feature(samples: bytes, times: list[float]) -> str:
    """Length, level, loudest, sign changes and spread of levels of the samples taken as unsigned 8-bit sound."""
    x = np.frombuffer(samples, np.uint8)
    total = np.bincount(x, minlength=256).astype(np.int64)
    v = np.arange(256) - 128
    n = len(x)
    level = float(np.sqrt((total * v * v).sum() / n))
    mean = float((total * v).sum() / n)
    high = x >= 128
    changes = int((high[1:] != high[:-1]).sum())
    p = total[total > 0] / n
    return f"seconds={times[-1]:.6f};pages={len(times)};mean={mean:.4f};rms={level:.4f};peak={int(np.abs(v[total > 0]).max())};crossings={changes};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def payload_from(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the text's own length in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            payload, n = payload_from(text)
            media = write(payload)
            back, _, times = payload_of(media)
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, times)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def store(documents: DataFrame) -> DataFrame:
    """doc_id and the media itself (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [write(payload_from(text)[0]) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, media binary")


def digests(documents: DataFrame) -> DataFrame:
    """Stores every text, reads it back, and returns what was found: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
