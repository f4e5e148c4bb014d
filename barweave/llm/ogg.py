"""Ogg containers: writing, verifying, demultiplexing and timing (RFC 3533).

`read_container` checks every page's checksum and sequence number, puts packets together from
the lacing values, separates the logical streams by serial number and derives times from granule
positions. `write_container` is its inverse. `ogg_features` applies the reader to a binary column
and `document_media` stores texts as two-channel 8-bit samples and reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, zipped

CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_INTRO = struct.Struct("<8sIBB")  # magic, rate, channel, bits
MAGIC = b"PCM8MONO"
RATE = 8000
PACKET = 4096
BLOCK = 192
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a sound Ogg container."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, not reflected, no inversion).

    It is zlib's reflected CRC of the bit-reversed bytes, with both inversions taken back.
    """
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    """One logical stream: whole packets, and the granule position at each packet's end (or None)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: bytearray | None = None

    def times(self, rate: int, samples) -> list[float | None]:
        """Seconds at each packet's end.

        A page states the position of the last packet that ends on it; earlier packets' ends follow
        by taking off the samples of those after them.
        """
        out: list[float | None] = [None] * len(self.packets)
        at = None
        for i in range(len(self.packets) - 1, -1, -1):
            at = self.granules[i] if self.granules[i] is not None else at
            out[i] = None if at is None else at / rate
            at = None if at is None else at - samples(self.packets[i])
        return out


def read_container(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of appearance; raises OggError on any damage."""
    streams: dict[int, Stream] = {}
    at, n, view = 0, len(data), memoryview(data)
    while at < n:
        if n - at < 27:
            raise OggError("truncated page header")
        magic, version, kind, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        body = at + 27 + count
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if len(lacing) < count or end > n:
            raise OggError("truncated page")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"checksum of page {number} of stream {serial}")
        s = streams.get(serial)
        if (s is None) != bool(kind & FIRST):
            raise OggError(f"stream {serial} begins wrongly")
        if s is None:
            s = streams[serial] = Stream(serial)
        if s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} out of sequence")
        if bool(kind & CONTINUED) != (s.part is not None):
            raise OggError(f"packet of stream {serial} broken off")
        s.pages += 1
        piece, done = body, 0
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                chunk = bytes(view[piece : piece + size])
                if s.part is not None:
                    s.part += chunk
                    chunk, s.part = bytes(s.part), None
                s.packets.append(chunk)
                s.granules.append(None)
                piece, size, done = piece + size, 0, done + 1
        if count and lacing[-1] == 255:
            s.part = (s.part or bytearray()) + view[piece : piece + size]
        if done:
            if granule < 0:
                raise OggError("a page that ends a packet has no position")
            s.granules[-1] = granule
        s.ended = bool(kind & LAST)
        at = end
    for s in streams.values():
        if not s.ended or s.part is not None:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream: the first packet alone, then at most 255 segments a page."""
    number = 0

    def page(lacing: bytes, body: bytes, granule: int, kind: int) -> bytes:
        head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
        return head[:22] + checksum(head).to_bytes(4, "little") + head[26:]

    groups = [packets[:1], packets[1:]] if len(packets) > 1 else [packets]
    for g, group in enumerate(groups):
        lacing, ends = bytearray(), []
        for packet, granule in group:
            lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            ends.append((len(lacing), granule))
        body = b"".join(p for p, _ in group)
        at = used = e = 0
        while at < len(lacing):
            take = lacing[at : at + 255]
            granule = -1
            while e < len(ends) and ends[e][0] <= at + len(take):
                granule, e = ends[e][1], e + 1
            kind = (CONTINUED if at and lacing[at - 1] == 255 else 0) | (0 if number else FIRST)
            if g == len(groups) - 1 and at + len(take) == len(lacing):
                kind |= LAST
            size = sum(take)
            yield page(bytes(take), body[used : used + size], granule, kind)
            number += 1
            at, used = at + len(take), used + size


def write_container(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """Multiplex logical streams, each a list of (packet, granule position at its end).

    First pages stand first, as the format asks; the other pages take turns.
    """
    made = [list(_pages(serial, packets)) for serial, packets in streams.items()]
    out = [p[0] for p in made]
    for i in range(1, max(map(len, made), default=0)):
        out += [p[i] for p in made if i < len(p)]
    return b"".join(out)


def store_samples(payload: bytes, channels: int = 2, rate: int = RATE) -> bytes:
    """8-bit samples dealt to `channels` logical streams, one per channel."""
    streams = {}
    for c in range(channels):
        own = payload[c::channels]
        packets = [(_INTRO.pack(MAGIC, rate, c, 8), 0)]
        packets += [(own[i : i + PACKET], min(i + PACKET, len(own))) for i in range(0, len(own), PACKET)]
        streams[c + 1] = packets
    return write_container(streams)


def load_samples(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload that `store_samples` was given, from the container's own bytes."""
    streams = read_container(media)
    by_channel = {}
    for s in streams.values():
        magic, _, channel, bits = _INTRO.unpack(s.packets[0])
        if magic != MAGIC or bits != 8:
            raise OggError("not 8-bit samples")
        by_channel[channel] = b"".join(s.packets[1:])
    out = np.empty(sum(map(len, by_channel.values())), np.uint8)
    for c, own in by_channel.items():
        out[c :: len(by_channel)] = np.frombuffer(own, np.uint8)
    return out.tobytes(), streams


def sample_feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """Counts, playing time and level of the stored samples, as text."""
    rate = _INTRO.unpack(next(iter(streams.values())).packets[0])[1]
    last = max(t for s in streams.values() for t in s.times(rate, lambda p: 0 if p[:8] == MAGIC else len(p)) if t is not None)
    x = np.frombuffer(payload, np.uint8)
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};"
        f"packets={sum(len(s.packets) for s in streams.values())};seconds={last:.6f};"
        f"mean={int(x.sum(dtype=np.int64)) / len(x):.4f};peak={int(x.max())};crossings={crossings}"
    )


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as Ogg samples, read it back, and describe both.

    A null text counts as empty; an empty text is stored as one block of spaces. Repeated rows give
    repeated results, an empty table an empty result, and other columns are not read. With
    `keep_media` the containers themselves come along in the binary column `media`. One map over
    the rows without a shuffle; memory is that of one text.
    """
    fields = MEDIA_SCHEMA + (", media binary" if keep_media else "")
    made = arrow_schema(fields)

    def run(batches):
        for batch in batches:
            out = {name: [] for name in made.names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                padded = raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)
                media = store_samples(padded)
                back, streams = load_samples(media)
                row = [
                    doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
                    len(media), hashlib.sha256(media).hexdigest(), sample_feature(back, streams), media,
                ]
                for name, value in zip(out, row):
                    out[name].append(value)
            yield zipped(made, **out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, fields)


FEATURE_SCHEMA = "serial long, pages long, packets long, bytes long, end_granule long, error string"


def ogg_features(df: DataFrame, media_col: str, id_cols: list[str]) -> DataFrame:
    """One row per logical stream of each container: pages, packets, bytes, last granule position.

    A damaged container gives one row whose `error` says why, with nulls elsewhere; a null one gives
    none; an empty one gives none. `id_cols` are carried along.
    """
    picked = df.select(*id_cols, F.col(media_col).alias("__media"))
    ids = picked.drop("__media").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ids] + [FEATURE_SCHEMA])

    made = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows, source = [], []
            for i, media in enumerate(batch.column(batch.num_columns - 1)):
                data = media.as_py()
                if data is None:
                    continue
                try:
                    found = [(s.serial, s.pages, len(s.packets), sum(map(len, s.packets)), next((g for g in reversed(s.granules) if g is not None), None), None) for s in read_container(data).values()]
                except OggError as e:
                    found = [(None, None, None, None, None, str(e))]
                rows += found
                source += [i] * len(found)
            carried = {f.name: batch.column(k).take(pa.array(source, pa.int64())) for k, f in enumerate(ids)}
            names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
            yield zipped(made, **carried, **{k: [r[j] for r in rows] for j, k in enumerate(names)})

    return picked.mapInArrow(run, schema)
