"""MPEG audio as a media column: frames, tags, tables, checksums, exact durations and seek offsets.

``parse`` walks a stream frame by frame. Where no frame header stands it resynchronises: it takes the next
position whose header is valid and is followed, one frame length on, by a header of the same kind (or by the
end of the audio). ``pack`` writes a payload as a stream of its own: an ID3v2 tag, an ``Info`` frame with
frame count, byte count and seek table, then silent Layer III frames that carry 576 payload bytes each, one
per sample, in the ancillary bytes behind the side information. ``unpack`` gives the payload back.

Everything works row by row on whole values, so a task needs memory for one Arrow batch and no shuffle occurs.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import as_bytes, bound_batches, stage

# Fixed values of the format: kbit/s by (version 1, layer) and (later versions, layer), and sample rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool
    mode: int
    extension: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[self.version == 1.0, self.mono]


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none, or of free or forbidden bit rate."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, padding = BITRATES[1 if version == 1.0 else 2, layer][bits], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1.0 else 576
    slot = 4 if layer == 1 else 1
    length = (samples // 8 // slot * kbps * 1000 // hz + padding) * slot
    mode = four[3] >> 6
    return Header(version, layer, not four[1] & 1, kbps, hz, length, samples, mode == 3, mode, four[3] >> 4 & 3)


def _crc_table() -> tuple[int, ...]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
        table.append(value)
    return tuple(table)


CRC_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 ^ CRC_TABLE[value >> 8 ^ byte]) & 0xFFFF
    return value


def checksum(frame: bytes, head: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None without one, and for Layer II, whose protected
    part depends on its allocation tables."""
    if not head.protected or head.layer == 2 or len(frame) < 6:
        return None
    if head.layer == 3:
        covered = head.side
    else:
        bound = 32 if head.mode != 1 else 4 * head.extension + 4
        covered = 16 if head.mono else (bound * 8 + (32 - bound) * 4) // 8
    return crc16(frame[2:4] + frame[6 : 6 + covered]) == int.from_bytes(frame[4:6])


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _string(raw: bytes) -> str:
    """Text of an ID3v2 frame: its first byte names the encoding."""
    if not raw:
        return ""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(codec, "replace").rstrip("\0")


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag at the start, its text fields); (0, {}) without a tag. A cut tag ends with the data."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    major, flags, size = data[3], data[5], _synchsafe(data[6:10])
    end, at, fields = min(len(data), 10 + size), 10, {}
    if flags & 0x40 and major >= 3 and end >= 14:
        at += _synchsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14])
    wide = 3 if major == 2 else 4
    while at + (6 if wide == 3 else 10) <= end and data[at] != 0:
        name = data[at : at + wide].decode("latin-1")
        raw = data[at + wide : at + 2 * wide]
        length = _synchsafe(raw) if major == 4 else int.from_bytes(raw)
        start = at + (6 if wide == 3 else 10)
        if name[0] == "T":
            text = _string(data[start : min(end, start + length)])
            if name in ("TXXX", "TXX"):
                key, _, text = text.partition("\0")
                name = f"{name}:{key}"
            fields.setdefault(name, text)
        at = start + length
    return min(len(data), 10 + size + (10 if flags & 0x10 else 0)), fields


def id3v1(data: bytes) -> dict[str, str]:
    """The fields of a 128-byte tag at the end; {} without one."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    cuts = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    return {k: data[-128 + a : -128 + b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in cuts.items()}


def rate_table(frame: bytes, head: Header) -> dict | None:
    """A frame that holds no audio but a table of the whole stream: Xing, Info or VBRI."""
    at = 4 + 2 * head.protected + head.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out, flags, at = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8]), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 4:
            out["toc"], at = list(frame[at : at + 100]), at + 100
        if flags & 8:
            out["quality"] = int.from_bytes(frame[at : at + 4])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width]) * scale for i in range(0, len(raw), max(1, width))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": step}
    return None


@dataclass
class Stream:
    """What a stream holds. ``offsets``: where each audio frame starts, in bytes; ``starts``: in samples."""

    tag: dict = field(default_factory=dict)
    tag1: dict = field(default_factory=dict)
    table: dict | None = None
    heads: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    duration: Fraction = Fraction(0)
    samples: int = 0
    checked: int = 0
    broken: int = 0
    resyncs: int = 0
    skipped: int = 0
    cut: bool = False

    def seek(self, seconds: Fraction | float) -> int | None:
        """Offset of the frame that sounds at a time; None outside the stream."""
        if not self.heads or not 0 <= seconds < self.duration:
            return None
        at = int(Fraction(seconds) * self.heads[0].rate)
        return self.offsets[int(np.searchsorted(self.starts, at, side="right")) - 1]


def parse(data: bytes | None) -> Stream:
    """Reads a whole stream. Null or empty data and data without any frame give a stream of no frames."""
    out, data = Stream(), data or b""
    at, out.tag = id3v2(data)
    out.tag1 = id3v1(data)
    end, first = len(data) - 128 * bool(out.tag1), True
    last = None
    while at + 4 <= end:
        head = header(data[at : at + 4])
        if head is None or (last and head.kind != last):
            start = at
            at = _resync(data, at + 1, end)
            out.resyncs += 1
            out.skipped += at - start
            last = None
            continue
        if at + head.length > end:
            out.cut, out.skipped = True, out.skipped + end - at
            break
        frame, last = data[at : at + head.length], head.kind
        table = rate_table(frame, head) if first else None
        first = False
        if table:
            out.table = table
        else:
            good = checksum(frame, head)
            out.checked, out.broken = out.checked + (good is not None), out.broken + (good is False)
            out.heads.append(head)
            out.offsets.append(at)
            out.starts.append(out.samples)
            out.samples += head.samples
        at += head.length
    by_rate: dict[int, int] = {}
    for head in out.heads:
        by_rate[head.rate] = by_rate.get(head.rate, 0) + head.samples
    out.duration = sum((Fraction(n, hz) for hz, n in by_rate.items()), Fraction(0))
    return out


def _resync(data: bytes, at: int, end: int) -> int:
    while 0 <= (at := data.find(b"\xff", at, end)) and at + 4 <= end:
        head = header(data[at : at + 4])
        if head:
            after = at + head.length
            follow = header(data[after : after + 4]) if after + 4 <= end else None
            if after == end or follow and follow.kind == head.kind:
                return at
        at += 1
    return end


#: The packed form: version 2, Layer III, 144 kbit/s, 16 kHz, mono, protected; 576 samples and 648 bytes a frame.
UNIT = 576
_HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_SIDE = bytes(9)
_PREFIX = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2) + _SIDE
_FRAME = header(_HEAD).length


def _text_frame(name: bytes, text: str) -> bytes:
    raw = b"\x03" + text.encode()
    size = bytes(len(raw) >> s & 127 for s in (21, 14, 7, 0))
    return name + size + b"\0\0" + raw


def pack(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries ``payload``, a positive multiple of 576 bytes; ``n_bytes`` of them count."""
    count, spare = divmod(len(payload), UNIT)
    if spare or not count:
        raise ValueError("the payload is no positive multiple of 576 bytes")
    frames = np.zeros((count, _FRAME), dtype=np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, dtype=np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(count, UNIT)
    size = (count + 1) * _FRAME
    toc = bytes(min(255, (1 + count * i // 100) * _FRAME * 256 // size) for i in range(100))
    table = b"Info" + struct.pack(">III", 7, count, min(size, 0xFFFFFFFF)) + toc
    info = (_PREFIX + table).ljust(_FRAME, b"\0")
    fields = _text_frame(b"TXXX", f"payload bytes\0{n_bytes}")
    tag = b"ID3\x04\0\0" + bytes(len(fields) >> s & 127 for s in (21, 14, 7, 0)) + fields
    return tag + info + frames.tobytes()


def unpack(media: bytes, stream: Stream | None = None) -> tuple[bytes, int]:
    """(payload, bytes of it that count) of a packed stream."""
    stream = stream or parse(media)
    skip = len(_PREFIX)
    payload = b"".join([media[at + skip : at + skip + UNIT] for at in stream.offsets])
    return payload, int(stream.tag.get("TXXX:payload bytes", len(payload)))


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, media binary): every whole text packed as a stream. A null text counts as empty; no row is lost,
    repeated rows give equal streams, other columns are left out."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [pack(padded(raw or b""), len(raw or b"")) for raw in as_bytes(batch.column(1))]
            yield pa.record_batch({"id": batch.column(0), "media": pa.array(media, pa.binary())})

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, media binary")


def stage_media(docs: DataFrame, **columns: str) -> DataFrame:
    """``store_text`` written as a table in the shared folder and read back."""
    return stage(store_text(docs, **columns), "mpeg-media")


FEATURES = (
    "n_frames long, n_samples long, sample_rate int, duration_num long, duration_den long, kbps_min int, kbps_max int, "
    "table string, checked long, broken long, resyncs long, skipped long, cut boolean, tag string, seek array<long>"
)


def features(media: DataFrame, payload: bool = False, seek_step: int = 100) -> DataFrame:
    """(id, media) -> id and the columns of ``FEATURES``; ``seek`` has the offset of every ``seek_step``-th frame.

    With ``payload`` the packed payload's figures are added. Null, empty and broken media give zeros."""
    bound_batches(media.sparkSession)
    more = ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    schema = f"id {dict(media.dtypes)['id']}, {FEATURES}" + more * payload

    def row(data: bytes) -> dict:
        s = parse(data)
        kbps = [h.kbps for h in s.heads]
        out = {
            "n_frames": len(s.heads), "n_samples": s.samples, "sample_rate": s.heads[0].rate if s.heads else 0,
            "duration_num": s.duration.numerator, "duration_den": s.duration.denominator,
            "kbps_min": min(kbps, default=0), "kbps_max": max(kbps, default=0), "table": s.table and s.table["kind"],
            "checked": s.checked, "broken": s.broken, "resyncs": s.resyncs, "skipped": s.skipped, "cut": s.cut,
            "tag": json.dumps(s.tag | s.tag1, ensure_ascii=False, sort_keys=True), "seek": s.offsets[::seek_step],
        }
        if payload:
            raw, n_bytes = unpack(data, s)
            out |= {
                "n_bytes": n_bytes, "payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(),
                "tail_crc32": zlib.crc32(raw[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
            }
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x or b"") for x in batch.column(1).to_pylist()]
            columns = {name: [r[name] for r in rows] for name in (rows[0] if rows else ())}
            if rows:
                out = {"id": batch.column(0), **{k: pa.array(v, ARROW[k]) for k, v in columns.items()}}
                yield pa.record_batch(out)

    return media.select("id", "media").mapInArrow(run, schema)


#: Arrow's types of the columns of ``features``.
ARROW = {
    name: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[kind]
    for name, kind in (
        x.strip().split(" ")
        for x in (FEATURES + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string").split(",")
    )
}
