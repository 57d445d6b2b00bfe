"""Operator 10: MPEG audio columns.

`pack` stores bytes losslessly in a stream of MPEG-1 Layer III frames (48 kHz, mono, CRC-protected): every frame's side
info is silent (all its fields zero), so the payload lies in the frames' ancillary bytes and a player hears silence.
An ID3v2.4 tag names the exact payload size, and a first frame carries a variable-bitrate table ("Xing": frames, bytes,
100 seek points). `scan` reads any MPEG-1/2/2.5 Layer I-III stream: it skips and parses tags, finds frame headers,
resynchronises after damage (a header counts where the next one follows it, or the stream ends there), parses the
variable-bitrate table, verifies CRC-16 checksums, and gives the exact duration in samples and each frame's offset.
Both work on one row at a time, with numpy over a row's frames: memory follows the longest row.

Defined cases: null text counts as empty; an empty payload is one block of blanks; bytes with no frame at all give no
frames, zero samples and null payload; damaged frames are reported (`crc_bad`), never skipped silently: `media_features`
fails where a stream gives fewer payload bytes than its tag names. The last 128 bytes are an ID3v1 tag only where they
start with `TAG` and a frame ends right before them, so a payload that holds these letters is never cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.llm.words import buffer_of

# Fixed values of the MPEG audio format (ISO/IEC 11172-3, 13818-3).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

UNIT = 192
_SIDE = 17  # bytes of side info of a mono MPEG-1 Layer III frame
_HEAD = 4 + 2 + _SIDE
_FIT = [(k, 144 * 1000 * k // 48000 - _HEAD) for k in KBPS[1, 3][1:]]  # kbit/s and payload bytes of a frame
_FULL = _FIT[-1][1]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of a byte matrix (polynomial 0x8005, start 0xFFFF)."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for j in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ rows[:, j]]
    return crc


def _header(kbps: int) -> bytes:
    return bytes([0xFF, 0xFA, KBPS[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])  # MPEG-1 Layer III with CRC, 48 kHz, mono


def _frame(kbps: int, body: bytes) -> bytes:
    head, side = _header(kbps), bytes(_SIDE)
    checked = np.frombuffer(head[2:] + side, np.uint8)[None]
    return head + struct.pack(">H", int(crc16(checked)[0])) + side + body


_FULL_HEAD = np.frombuffer(_frame(320, b""), np.uint8)


def _sync(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def payload_of(text: bytes) -> bytes:
    """The text with blanks appended up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def pack(payload: bytes) -> bytes:
    """The payload as a tagged MPEG audio stream."""
    whole, rest = divmod(len(payload), _FULL)
    body = np.empty((whole, _HEAD + _FULL), np.uint8)
    body[:, :_HEAD] = _FULL_HEAD
    body[:, _HEAD:] = np.frombuffer(payload, np.uint8, whole * _FULL).reshape(whole, _FULL)
    tail = b""
    if rest:
        kbps, room = next(x for x in _FIT if x[1] >= rest)
        tail = _frame(kbps, payload[whole * _FULL :] + bytes(room - rest))
    frames, first = whole + bool(rest), 3 * 64
    size = first + body.size + len(tail)
    ends = first + np.minimum(np.arange(100) * (frames + 1) // 100 * (_HEAD + _FULL), body.size + len(tail))
    table = b"Xing" + struct.pack(">III", 7, frames, size) + bytes(np.minimum(255, ends * 256 // size).astype(np.uint8))
    lead = _frame(64, table + bytes(first - _HEAD - len(table)))
    note = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _sync(len(note)) + b"\x00\x00" + note
    return b"ID3\x04\x00\x00" + _sync(len(tag)) + tag + lead + body.tobytes() + tail


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  #: byte offset of each audio frame: the seek table
    sizes: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    samples: int = 0  #: of all audio frames; with `rate` the exact duration
    rate: int = 0
    channels: int = 0
    version: int = 0
    layer: int = 0
    protected: int = 0
    crc_bad: int = 0
    skipped: int = 0  #: bytes passed over while looking for a header
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  #: frames, bytes and seek points of a variable-bitrate table
    payload: bytes | None = None

    @property
    def stored(self) -> int | None:
        """The payload's size, where a tag names one; what else other writers put there is no size."""
        size = self.tags.get("TXXX:payload_bytes", "")
        return int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _parse(data: bytes, at: int) -> tuple[int, int, int, int, int, int, int] | None:
    """version bits, layer, protected, kbit/s, rate, channels and size of the frame whose header is at `at`."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    rate_index, rate_bits = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or rate_bits == 3 or rate_index in (0, 15):
        return None
    kind = (1 if version == 3 else 2, layer)
    kbps, rate, pad = KBPS[kind][rate_index], RATES[version][rate_bits], data[at + 2] >> 1 & 1
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else SAMPLES[kind] // 8 * 1000 * kbps // rate + pad
    return version, layer, 1 - (data[at + 1] & 1), kbps, rate, 1 if data[at + 3] >> 6 == 3 else 2, size


def _id3(data: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag's text frames; gives the offset after the tag."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    unsync = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at = 10 + unsync(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        size = unsync(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        value = data[at + 10 : at + 10 + size]
        if name[0] == "T" and value:
            text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")
            key, _, rest = text.partition("\0")
            out.tags[f"TXXX:{key}" if name == "TXXX" else name] = rest.rstrip("\0") if name == "TXXX" else text.rstrip("\0")
        at += 10 + size
    return end


def _side_bytes(version: int, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)


def _alike(buffer: np.ndarray, size: int) -> int:
    """How many frames from the start have the first one's header, looking ahead twice as far each time, so that frames
    which all differ cost no look over the rest of the stream."""
    most, run, look = len(buffer) // size, 1, 8
    while run < most:
        some = min(look, most - run)
        same = (buffer[run * size : (run + some) * size].reshape(some, size)[:, :4] == buffer[:4]).all(axis=1)
        if not same.all():
            return run + int(np.argmin(same))
        run, look = run + some, 2 * look
    return run


def scan(data: bytes) -> Stream:
    """Parses a stream of MPEG audio."""
    out = Stream()
    at, end = _id3(data, out), len(data)
    tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else -1  # an ID3v1 tag only where a frame ends
    bodies, sure, buffer = [], False, np.frombuffer(data, np.uint8)
    while at + 4 <= end:
        if at == tag and (sure or not out.skipped):
            end = at
            break
        head = _parse(data, at)
        if head and not sure:  # a lone pattern of sync bits is no frame: another must follow, or the end
            after = at + head[6]
            head = head if after in (end, tag) or after < end and _parse(data, after) else None
        if not head or at + head[6] > end:
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at, sure = found if found >= 0 else end, False
            continue
        sure = True
        version, layer, protected, kbps, rate, channels, size = head
        side = _side_bytes(version, channels) if layer == 3 else 0
        body = at + 4 + 2 * protected + side
        # frames with the same four header bytes lie end to end: take the whole run at once
        run = _alike(buffer[at:end], size) if layer == 3 else 1
        if protected and layer == 3:
            grid = buffer[at : at + run * size].reshape(run, size)
            want = grid[:, 4].astype(np.uint32) << 8 | grid[:, 5]
            out.crc_bad += int((crc16(np.concatenate([grid[:, 2:4], grid[:, 6 : 6 + side]], axis=1)) != want).sum())
            out.protected += run
        if not out.offsets and out.table is None and data[body : body + 4] in (b"Xing", b"Info"):
            out.table = _vbr(data, body, at + size)
            out.version, out.layer, out.rate, out.channels = version, layer, rate, channels
            at += size
            continue
        out.version, out.layer, out.rate, out.channels = version, layer, rate, channels
        out.offsets += range(at, at + run * size, size)
        out.sizes += [size] * run
        out.kbps += [kbps] * run
        out.samples += run * SAMPLES[1 if version == 3 else 2, layer]
        bodies.append(buffer[at : at + run * size].reshape(run, size)[:, body - at :].tobytes())
        at += run * size
    out.skipped += max(0, end - at)
    if bodies and (size := out.stored) is not None:
        out.payload = b"".join(bodies)[:size]
    return out


def _vbr(data: bytes, at: int, end: int) -> dict:
    flags, found = struct.unpack_from(">I", data, at + 4)[0], {}
    at += 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit and at + 4 <= end:
            found[name] = struct.unpack_from(">I", data, at)[0]
            at += 4
    if flags & 4 and at + 100 <= end:
        found["seek"] = list(data[at : at + 100])
    return found


MEDIA = "n_bytes long, media binary"
FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, samples long, seconds double, frames long, seek_offsets array<long>, crc_checked long, crc_bad long"
)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored form of each text: the media column."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            media = [pack(payload_of(data[a:b].tobytes())) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {MEDIA}")


def media_features(media: DataFrame) -> DataFrame:
    """Reads each stored stream back: payload digests, exact duration, seek offsets and checks."""

    def run(batches):
        for batch in batches:
            rows = [_features(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", "))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def _features(doc_id: int | None, n_bytes: int, media: bytes) -> tuple:
    s = scan(media)
    payload = s.payload or b""
    if len(payload) < (s.stored or 0):
        raise ValueError(f"doc_id {doc_id}: {len(payload)} payload bytes read, {s.stored} stored")
    by_rate = ",".join(f"{k}x{s.kbps.count(k)}" for k in sorted(set(s.kbps)))
    feature = f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[s.version] }-l{s.layer};{s.rate}Hz;ch{s.channels};frames={len(s.offsets)};samples={s.samples};kbps={by_rate};crc_ok={s.protected - s.crc_bad}/{s.protected};skipped={s.skipped};vbr={(s.table or {}).get('frames')}"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, n_bytes, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), feature,
        s.samples, s.seconds, len(s.offsets), s.offsets, s.protected, s.crc_bad,
    )
