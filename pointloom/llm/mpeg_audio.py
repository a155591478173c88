"""MPEG audio columns: MPEG-1 layer III streams that carry a byte payload losslessly, and their reader.

A stream is an ID3v2.4 tag (user text frames with the payload's length), a
frame with a variable-bitrate table (frame and byte counts, 100 seek points)
and audio frames at 44.1 kHz mono, each with a checksum. An audio frame's side
information is all zero, so it plays as silence, and its main data area holds
the payload as ancillary data; the bitrate of each frame is the highest, and of the
last ones the lowest that holds what is left, so that the rate varies.

The reader skips the tag, finds headers again after damage (a header counts
if it is valid and its checksum holds, or another header or the end follows its frame), verifies
each checksum, reads the table, and gives exact durations (samples over the
rate) and every frame's offset.

Edges: a null payload is stored as an empty one; empty payloads give a
stream of tag and table without audio frames; a null or foreign stream reads
as no frames; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, only, store, table, texts_of

# Fixed values of the format (ISO/IEC 11172-3, layer III): kbit/s by bitrate index, Hz by rate index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE_MONO, SIDE_STEREO = 17, 32
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

_HEAD = 4 + 2 + SIDE_MONO


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ CRC_POLYNOMIAL if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()
_crc_memory: dict[bytes, int] = {}


def frame_crc(covered: bytes) -> int:
    """CRC-16 over the header's last two bytes and the side information."""
    found = _crc_memory.get(covered)
    if found is None:
        found = CRC_START
        for b in covered:
            found = ((found << 8) ^ _CRC[(found >> 8) ^ b]) & 0xFFFF
        if len(_crc_memory) > 10_000:
            _crc_memory.clear()
        _crc_memory[covered] = found
    return found


def _length(index: int, rate: int, padding: int = 0) -> int:
    return 144 * BITRATES[index] * 1000 // rate + padding


def _opening(index: int) -> bytes:
    """Header, checksum and empty side information of a mono frame at 44.1 kHz."""
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    side = bytes(SIDE_MONO)
    return head + struct.pack(">H", frame_crc(head[2:] + side)) + side


_OPENINGS = {i: _opening(i) for i in range(1, len(BITRATES))}
_ROOM = {i: _length(i, RATES[0]) - _HEAD for i in _OPENINGS}
_TOP = max(_OPENINGS)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _tag(texts: dict[str, str]) -> bytes:
    frames = b""
    for k, v in texts.items():
        body = b"\x03" + k.encode() + b"\0" + v.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def encode(payload: bytes) -> bytes:
    """The stream that carries ``payload``."""
    frames, at, n = [], 0, len(payload)
    top, opening = _ROOM[_TOP], _OPENINGS[_TOP]
    while n - at >= top:
        frames.append(opening + payload[at : at + top])
        at += top
    if at < n:
        i = next(i for i in sorted(_ROOM) if _ROOM[i] >= n - at)
        frames.append(_OPENINGS[i] + payload[at:].ljust(_ROOM[i], b"\0"))
    lengths = [len(f) for f in frames]
    i = next(i for i in sorted(_ROOM) if _ROOM[i] >= 120)
    total = _length(i, RATES[0]) + sum(lengths)
    toc, k, reached = bytearray(100), 0, _length(i, RATES[0])
    for p in range(100):  # at p hundredths of the duration, the offset in 256ths of the length
        while k < len(frames) and k * 100 < p * len(frames):
            reached += lengths[k]
            k += 1
        toc[p] = min(255, reached * 256 // total)
    table = b"Xing" + struct.pack(">III", 0b111, len(frames), total) + bytes(toc)
    first = _OPENINGS[i] + table.ljust(_ROOM[i], b"\0")
    return _tag({"payload_bytes": str(n)}) + first + b"".join(frames)


@dataclass
class Stream:
    """What a stream says of itself."""

    payload: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    skipped_bytes: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    kbits: set[int] = field(default_factory=set)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _header(data: bytes, at: int) -> tuple[int, int, int, bool, int] | None:
    """Length, kbit/s, Hz, whether a checksum follows, and side information bytes of the frame header at ``at``."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b, mode = data[at + 2], data[at + 3] >> 6
    index, rate = b >> 4, (b >> 2) & 3
    if not 0 < index < len(BITRATES) or rate > 2:
        return None
    return _length(index, RATES[rate], (b >> 1) & 1), BITRATES[index], RATES[rate], not data[at + 1] & 1, SIDE_MONO if mode == 3 else SIDE_STEREO


def _checksum_holds(data: bytes, at: int, header: tuple[int, int, int, bool, int]) -> bool:
    _, _, _, checked, side = header
    return checked and frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == data[at + 4] << 8 | data[at + 5]


def _read_tag(data: bytes, tags: dict[str, str]) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0

    def size(b: bytes) -> int:
        return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]

    end, at = 10 + size(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at]:
        n = size(data[at + 4 : at + 8])
        if data[at : at + 4] == b"TXXX":
            k, _, v = data[at + 11 : at + 10 + n].partition(b"\0")
            tags[k.decode("utf-8", "replace")] = v.decode("utf-8", "replace")
        at += 10 + n
    return end


def decode(data: bytes | None) -> Stream:
    out, data = Stream(), data or b""
    at, bodies, first = _read_tag(data, out.tags), [], True
    n = len(data)
    while at < n:
        h = _header(data, at)
        if h is None or at + h[0] > n or not (at + h[0] == n or _header(data, at + h[0]) or _checksum_holds(data, at, h)):
            to = data.find(b"\xff", at + 1)
            out.skipped_bytes += (to if to >= 0 else n) - at
            at = to if to >= 0 else n
            continue
        length, kbit, rate, checked, side = h
        begin = at + 4 + 2 * checked
        if checked and not _checksum_holds(data, at, h):
            out.bad_checksums += 1
        body = data[begin + side : at + length]
        if first and body[:4] == b"Xing":
            flags, out.table_frames, out.table_bytes = struct.unpack(">III", body[4:16])
            out.toc = body[16:116] if flags & 4 else b""
        else:
            out.frames += 1
            out.samples += SAMPLES
            out.rate = rate
            out.kbits.add(kbit)
            out.offsets.append(at)
            bodies.append(body)
        first = False
        at += length
    out.payload = b"".join(bodies)
    if out.tags.get("payload_bytes", "").isdigit():
        out.payload = out.payload[: int(out.tags["payload_bytes"])]
    return out


def encode_column(df: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """key and media (binary) of each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x.as_py() or b"") for x in batch.column(1)], pa.binary())], names=[key, "media"])

    return map_arrow(only(df, key, payload), run, f"`{key}` {df.schema[key].dataType.simpleString()}, media binary")


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """key, n_bytes and media of each text in UTF-8, padded by bytes 0 to a positive multiple of ``unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for x in texts_of(batch.column(1)).cast(pa.binary()):
                b = x.as_py()
                sizes.append(len(b))
                media.append(encode(b.ljust(max(unit, -(-len(b) // unit) * unit), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return map_arrow(only(df, key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


_READ = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "frames": pa.int64(), "samples": pa.int64(), "duration_us": pa.int64(), "bad_checksums": pa.int64(), "skipped_bytes": pa.int64(), "seek_offsets": pa.list_(pa.int64())}


def decode_column(df: DataFrame, key: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests, exact durations and frame offsets read back from stored streams. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _READ}
            for x in batch.column(1):
                data = x.as_py() or b""
                s = decode(data)
                offsets = hashlib.sha256(struct.pack(f"<{len(s.offsets)}q", *s.offsets)).hexdigest()[:16]
                row = {
                    "payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "tail_crc32": zlib.crc32(s.payload[-64:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                    "feature": f"frames={s.frames};table={s.table_frames};samples={s.samples};rate={s.rate};us={s.duration_us};kbit={min(s.kbits, default=0)}-{max(s.kbits, default=0)};bad={s.bad_checksums};skipped={s.skipped_bytes};toc={zlib.crc32(s.toc):08x};offsets={offsets}",
                    "frames": s.frames, "samples": s.samples, "duration_us": s.duration_us, "bad_checksums": s.bad_checksums, "skipped_bytes": s.skipped_bytes, "seek_offsets": s.offsets,
                }
                for k, v in row.items():
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], *[pa.array(out[k], t) for k, t in _READ.items()]], names=[key, *keep, *_READ])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    declared = [f"`{c}` {kinds[c]}" for c in (key, *keep)] + [f"{k} {'array<long>' if pa.types.is_list(t) else 'string' if t == pa.string() else 'long'}" for k, t in _READ.items()]
    return map_arrow(only(df, key, media, *keep), run, ", ".join(declared))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(encode_texts(table(spark, sf_dir, "documents")))
    return decode_column(stored, keep=("n_bytes",))
