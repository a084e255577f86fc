"""Ogg media columns: texts stored as 8-bit samples, and a reader that checks, reassembles, demultiplexes and times them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

RATE = 8000
#: Samples in a packet, and serial numbers of the two streams: the samples, and a check value for each packet of them.
PACKET, SAMPLES, CHECKS = 8192, 1, 2
#: First bytes of the header packets of the two.
PCM, CRC = b"\x01pcm-u8\0", b"\x01crc32\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class BadMedia(ValueError):
    """The bytes are no sound Ogg stream."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 04c11db7, unreflected, from 0. zlib's is the same with all bits mirrored, so bytes and result are mirrored around it."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule of the first packet that ends there or after, page) in order: the first packet alone, then as many as 255 lacing values hold; a packet may go on on the next page.

    A page has the granule of the last packet that ends on it, or -1 where none does.
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, waits, goes_on = bytearray(), bytearray(), -1, None, False

    def flush(last: bool, more: bool) -> None:
        nonlocal lacing, body, granule, waits, goes_on
        kind = (CONTINUED if goes_on else 0) | (FIRST if not out else 0) | (LAST if last else 0)
        page = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, len(out), 0) + bytes([len(lacing)]) + lacing + body
        out.append((waits, page[:22] + struct.pack("<I", page_crc(page)) + page[26:]))
        lacing, body, granule, waits, goes_on = bytearray(), bytearray(), -1, None, more

    for k, (data, end) in enumerate(packets):
        segments, at, last = b"\xff" * (len(data) // 255) + bytes([len(data) % 255]), 0, k == len(packets) - 1
        while at < len(segments):
            part = segments[at : at + 255 - len(lacing)]
            waits = end if waits is None else waits
            lacing += part
            body += data[at * 255 : at * 255 + sum(part)]
            at += len(part)
            if at == len(segments):
                granule = end
            if len(lacing) == 255 and not (last and at == len(segments)):
                flush(False, at < len(segments))
        if k == 0 and lacing or last:
            flush(last, False)
    return out


def encode(payload: bytes) -> bytes:
    """Two multiplexed streams: header pages first, then data pages by granule position."""
    chunks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(c) for c in chunks]).tolist()
    samples = pages_of(SAMPLES, [(PCM + struct.pack("<IIQ", RATE, 1, len(payload)), 0), *zip(chunks, ends)])
    checks = pages_of(CHECKS, [(CRC, 0), *((struct.pack("<I", zlib.crc32(c)), e) for c, e in zip(chunks, ends))])
    rest = sorted([(g, 0, i, p) for i, (g, p) in enumerate(samples[1:])] + [(g, 1, i, p) for i, (g, p) in enumerate(checks[1:])])
    return b"".join([samples[0][1], checks[0][1], *(x[3] for x in rest)])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule, packets up to there, whether the stream ends) of each page on which a packet ends.
    marks: list[tuple[int, int, bool]] = field(default_factory=list)
    pages: int = 0  # number of the next page
    ended: bool = False
    open: list[bytes] = field(default_factory=list)
    lost_pages: int = 0

    def times(self, duration: Callable[[bytes], int]) -> list[int]:
        """The position at the end of each packet. A page's granule is that of the last packet that ends on it; those before it are timed back from there by their durations, but on the last page, which may cut the end off, forwards from what came before."""
        out: list[int] = []
        for granule, upto, last in self.marks:
            sizes = [duration(p) for p in self.packets[len(out) : upto]]
            if last and (out or sum(sizes) > granule):
                ends = [min(granule, (out[-1] if out else 0) + n) for n in accumulate(sizes)]
            else:
                ends = [granule - n for n in accumulate([0, *reversed(sizes[1:])])][::-1]
            out += ends
        return out


def page_at(media: bytes, at: int) -> tuple[int, int, int, int, bytes, int, int]:
    """(kind, granule, serial, number, lacing, first byte of the body, first byte after the page)."""
    if media[at : at + 4] != b"OggS" or len(media) < at + 27:
        raise BadMedia(f"no page at byte {at}")
    _, version, kind, granule, serial, number, crc, segments = struct.unpack_from("<4sBBqIIIB", media, at)
    lacing = media[at + 27 : at + 27 + segments]
    start = at + 27 + segments
    end = start + sum(lacing)
    if version or end > len(media) or len(lacing) < segments:
        raise BadMedia(f"bad page at byte {at}")
    if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
        raise BadMedia(f"checksum of the page at byte {at}")
    return kind, granule, serial, number, lacing, start, end


def demultiplex(media: bytes, strict: bool = True) -> list[Stream]:
    """The logical streams in the order of their first pages; streams may be multiplexed and chained, and a serial number may come again after its stream has ended.

    Checks capture pattern, version, checksum, page order and continuation. strict=False goes on after damage: bytes up to
    the next sound page are skipped, packets of which a part is missing go, and lost_pages counts the gaps in the numbers.
    """
    streams: list[Stream] = []
    live: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        try:
            kind, granule, serial, number, lacing, body, end = page_at(media, at)
        except BadMedia:
            if strict:
                raise
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        at = end
        s = live.get(serial)
        if kind & FIRST or s is None:
            if strict and (not kind & FIRST or s is not None and not s.ended):
                raise BadMedia(f"start of stream {serial}")
            if s is None or kind & FIRST:
                s = live[serial] = Stream(serial)
                streams.append(s)
                if not kind & FIRST:
                    s.lost_pages = s.pages = number
        elif strict and s.ended:
            raise BadMedia(f"page {number} of stream {serial} after its end")
        whole = number == s.pages and bool(kind & CONTINUED) == bool(s.open)
        if strict and not whole:
            raise BadMedia(f"page {number} of stream {serial} is out of order")
        if not whole:
            s.lost_pages += max(0, number - s.pages)
            s.open = []
        skip = bool(kind & CONTINUED) and not s.open  # the rest of a packet whose start is missing
        s.pages, s.ended = number + 1, bool(kind & LAST)
        size, before = 0, len(s.packets)
        for n in lacing:
            size += n
            if n < 255:
                if not skip:
                    s.packets.append(b"".join([*s.open, media[body : body + size]]))
                s.open, skip = [], False
                body, size = body + size, 0
        if len(s.packets) > before:
            s.marks.append((granule, len(s.packets), s.ended))
        if size and not skip:
            s.open.append(media[body : body + size])
    if strict and not all(s.ended and not s.open for s in streams):
        raise BadMedia("a stream has no end")
    return streams


def opus_samples(packet: bytes) -> int:
    """Samples at 48 kHz of an Opus packet, from its first bytes."""
    config, frames = packet[0] >> 3 if packet else 0, {0: 1, 1: 2, 2: 2}.get(packet[0] & 3 if packet else 0, packet[1] & 63 if len(packet) > 1 else 0)
    size = (480, 960, 1920, 2880)[config % 4] if config < 12 else (480, 960)[config % 2] if config < 16 else 120 << config % 4
    return frames * size


@dataclass
class Decoded:
    payload: bytes
    rate: int
    timestamps: list[float]  # seconds at the end of each packet
    pages: int


def positions(s: Stream) -> tuple[int, list[int]]:
    """Rate and the number of samples up to the end of each packet but the headers; (0, []) for a codec that is not known here."""
    head = s.packets[0] if s.packets else b""
    if head.startswith(PCM):
        rate, headers, duration, skip = struct.unpack_from("<I", head, len(PCM))[0], 1, len, 0
    elif head.startswith(b"OpusHead"):
        rate, headers, duration, skip = 48_000, 2, opus_samples, struct.unpack_from("<H", head, 10)[0]
    else:
        return 0, []
    own = Stream(s.serial, s.packets[headers:], [(g, n - headers, last) for g, n, last in s.marks if n > headers])
    return rate, [max(0, t - skip) for t in own.times(duration)]


def timestamps(s: Stream) -> tuple[int, list[float]]:
    """Rate and seconds at the end of each packet but the headers; (0, []) for a codec that is not known here."""
    rate, ends = positions(s)
    return rate, [n / rate for n in ends]


def decode(media: bytes) -> Decoded:
    """What encode has stored, all checked: one stream of samples and one of their check values."""
    streams = demultiplex(media)
    samples, checks = ([s for s in streams if s.packets and s.packets[0].startswith(head)] for head in (PCM, CRC))
    if len(samples) != 1 or len(checks) != 1 or len(streams) != 2:
        raise BadMedia("unknown streams")
    samples, checks = samples[0], checks[0]
    length = struct.unpack_from("<Q", samples.packets[0], len(PCM) + 8)[0]
    data = samples.packets[1:]
    if [struct.pack("<I", zlib.crc32(p)) for p in data] != checks.packets[1:]:
        raise BadMedia("the check stream disagrees")
    rate, ends = positions(samples)
    payload = b"".join(data)
    if len(payload) != length or ends != list(accumulate(map(len, data))):  # whole numbers: seconds times the rate need not give them again
        raise BadMedia("granule positions disagree with the samples")
    return Decoded(payload, rate, [n / rate for n in ends], samples.pages + checks.pages)


def features(d: Decoded) -> str:
    """Duration, pages, level, mean, crossings of the middle and peak of the samples that were read."""
    x = np.frombuffer(d.payload, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"seconds={d.timestamps[-1]:.6f};pages={d.pages};rms={np.sqrt((x * x).mean()):.4f};mean={x.mean():.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))


FIELDS = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
STREAMS = {"streams": "array<string>", "damage": "string"}


def digest(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * len(FIELDS)
    d = decode(media)
    return len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(d)


def media_columns(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and media: the Ogg bytes of every whole text; a null text counts as empty. Equal texts get equal bytes; an empty table gives no rows."""
    return map_texts(docs, keep, text_col, {"media": "binary"}, lambda texts: [[encode(padded(t)) for t in texts]])


def media_digest(stored: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The kept columns and FIELDS of a media column that media_columns made, read back page by page.

    A null medium has null FIELDS; damaged bytes fail the task. Null ids and repeated rows are read like any other row, and
    equal bytes have equal values; an empty table gives no rows.
    """
    return map_texts(stored, keep, media_col, FIELDS, lambda media: [list(c) for c in zip(*map(digest, media))], kind="binary")


def summary(media: bytes | None) -> tuple[list[str] | None, str | None]:
    if media is None:
        return None, None
    try:
        streams, damage = demultiplex(media), None
    except BadMedia as e:
        streams, damage = demultiplex(media, strict=False), str(e)
    out = []
    for s in streams:
        rate, times = timestamps(s)
        out.append(f"serial={s.serial};packets={len(s.packets)};bytes={sum(map(len, s.packets))};lost_pages={s.lost_pages};rate={rate};seconds={times[-1] if times else 0:.6f}")
    return out, damage


def read_streams(stored: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The kept columns and STREAMS of any Ogg column: a line for each logical stream with its packets, and what is wrong with the bytes, or null. What damage leaves is read; a null medium has nulls."""
    return map_texts(stored, keep, media_col, STREAMS, lambda media: [list(c) for c in zip(*map(summary, media))], kind="binary")


#: The columns of a digest that do not depend on the container, in DuckDB's SQL; the checksum is worked out byte by byte.
SQL = """
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crcs),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, hex(encode(coalesce(text, ''))) AS raw FROM documents),
p AS (SELECT doc_id, n_bytes, raw || repeat('00', (64 * greatest(1, (n_bytes + 63) // 64) - n_bytes)::INT) AS payload FROM d),
h AS (SELECT doc_id, n_bytes, length(payload)::BIGINT // 2 AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, right(payload, 128) AS tail FROM p)
SELECT doc_id, n_bytes, payload_bytes, payload_sha256,
  xor(list_reduce(list_transform(range(64), lambda i: ('0x' || substr(tail, (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS tail_crc32
FROM h, k"""
