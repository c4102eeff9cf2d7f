"""Media columns: MPEG audio.

``parse`` reads a stream of any MPEG version (1, 2, 2.5) and layer (I, II, III), free format too: it reads the text
fields of an ID3v2 tag (2.2 to 2.4, unsynchronised or with an extended header) and of an ID3v1 tag, finds frame headers
and resynchronises over junk (a header counts if the next one follows where it says, agrees in version, layer and rate, or
the stream ends there), reads a Xing/Info or VBRI table with its seek points, verifies the CRC-16 of protected frames of
all layers, and returns exact durations (samples over rate) and the byte offset of every frame for seeking. ``pack``
stores bytes losslessly in the ancillary part of variable-bitrate Layer III frames and ``payload`` reads them back. The
query writes the media column as a table in shared storage and reads the streams from there.

Defined results: a null text is the empty text, stored as 64 zero bytes; a very long text is one stream; bytes that hold
no frame give 0 frames and a duration of 0; rows that repeat are stored alike; columns beside id and text are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sparkfold.llm.common import map_rows, stored, table

# Fixed values of the format: kbit/s by (version 1 or not, layer) and samples a second by version bits.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: (last subband, bits of an allocation) of each run of subbands, by table; the low rates' table is "l".
ALLOCATIONS = {"a": ((11, 4), (23, 3), (27, 2)), "b": ((11, 4), (23, 3), (30, 2)), "c": ((2, 4), (8, 3)), "d": ((2, 4), (12, 3)), "l": ((4, 4), (11, 3), (30, 2))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SLOTS = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


@dataclass
class Header:
    version: int
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int
    bound: int
    pad: int


def header(word: int) -> Header | None:
    """The fields of a 32-bit frame header; None if it isn't one. A frame of free format has length 0.

    ``bound``: the first subband that joint stereo codes once for both channels. ``pad``: bytes of padding.
    """
    if word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate_at, kbits_at = word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate_at == 3 or kbits_at == 15 or word & 3 == 2:
        return None
    one = version == 3
    rate, kbits, pad = RATES[version][rate_at], KBITS[one, layer][kbits_at], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = 0 if not kbits else (12000 * kbits // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + pad
    mode = word >> 6 & 3
    mono = mode == 3
    bound = 4 + 4 * (word >> 4 & 3) if mode == 1 else 32
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbits, rate, mono, length, samples, side if layer == 3 else 0, bound, pad * (4 if layer == 1 else 1))


_HEADERS: dict[int, Header | None] = {}


def _header(word: int) -> Header | None:
    if word not in _HEADERS:
        if len(_HEADERS) > 65536:
            _HEADERS.clear()
        _HEADERS[word] = header(word)
    return _HEADERS[word]


def _bits(data: bytes, at: int, n: int) -> int:
    """n bits from bit ``at`` on; those beyond the data are 0."""
    first, last = at >> 3, at + n + 7 >> 3
    chunk = data[first:last]
    return int.from_bytes(chunk + bytes(last - first - len(chunk)), "big") >> (last << 3) - at - n & (1 << n) - 1


def covered_bits(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum of a protected frame it covers."""
    channels, at = 1 if h.mono else 2, 48
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        bound = 32 if h.mono else h.bound
        return 4 * (bound * channels + 32 - bound)
    each = h.kbits // channels
    name = "l" if h.version != 3 else ("d" if h.rate == 32000 else "c") if 0 < each <= 48 else "a" if h.rate == 48000 or 0 < each <= 80 else "b"
    subband = chosen = 0
    for last, width in ALLOCATIONS[name]:
        for sb in range(subband, last):
            shared = sb >= h.bound or h.mono
            for _ in range(1 if shared else 2):
                # A shared allocation has scale factor selections for each channel.
                chosen += (_bits(frame, at, width) != 0) * (channels if shared else 1)
                at += width
        subband = last
    return at - 48 + 2 * chosen


def checksum_holds(frame: bytes, h: Header) -> bool:
    n = covered_bits(frame, h)
    crc = crc16(frame[6 : 6 + n // 8], crc16(frame[2:4]))
    for i in range(n // 8 * 8, n):
        bit = _bits(frame, 48 + i, 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc == int.from_bytes(frame[4:6], "big")


def _free_length(data: bytes, at: int, h: Header, end: int) -> int:
    """Bytes of a free-format frame without padding: the distance to the first header like it that a third confirms, or
    that is where the stream ends; 0 if there is none."""
    seek = at + 4 + 2 * h.protected + h.side
    while True:
        seek = data.find(b"\xff", seek + 1, end)
        if seek < 0:
            return 0
        two = _header(int.from_bytes(data[seek : seek + 4], "big")) if seek + 4 <= end else None
        if two is not None and (two.version, two.layer, two.rate, two.kbits) == (h.version, h.layer, h.rate, 0):
            length = seek - at - h.pad
            after = seek + length + two.pad
            three = _header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            if after == end or three is not None and (three.version, three.layer, three.rate, three.kbits) == (h.version, h.layer, h.rate, 0):
                return length


@dataclass
class Stream:
    rate: int = 0
    layer: int = 0
    channels: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)
    bitrates: set[int] = field(default_factory=set)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    #: Byte offsets of a VBRI table's entries.
    points: list[int] = field(default_factory=list)
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _decoded(body: bytes) -> str:
    return body[1:].decode("utf-8" if body[0] == 3 else "utf-16" if body[0] == 1 else "utf-16-be" if body[0] == 2 else "latin-1", "replace")


def _id3v2(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    end = min(len(data), 10 + _synchsafe(data[6:10]))
    tag = data[10:end]
    if flags & 128 and version < 4:
        tag = tag.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64 and version > 2 and len(tag) >= 4:
        # The size of version 2.3's extended header leaves out its own four bytes.
        at = _synchsafe(tag[:4]) if version > 3 else 4 + int.from_bytes(tag[:4], "big")
    width, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(tag) and tag[at] != 0:
        name = tag[at : at + width].decode("latin-1")
        size = tag[at + width : at + 2 * width]
        size = _synchsafe(size) if version > 3 else int.from_bytes(size, "big")
        body = tag[at + head : at + head + size]
        if version > 3 and tag[at + 9] & 2:
            body = body.replace(b"\xff\x00", b"\xff")
        if version > 3 and tag[at + 9] & 1:
            body = body[4:]
        if name[0] == "T" and body:
            text = _decoded(body)
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            out.tags[name] = text.rstrip("\0")
        at += head + size
    # A footer repeats the head.
    return min(len(data), end + 10) if version > 3 and flags & 16 else end


def _id3v1(tag: bytes, out: Stream) -> None:
    """Fields of the 128 bytes at a stream's end; those of an ID3v2 tag go first."""
    for name, first, last in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        text = tag[first:last].split(b"\0")[0].decode("latin-1").rstrip(" ")
        if text:
            out.tags.setdefault(name, text)
    if tag[125] == 0 and tag[126]:
        out.tags.setdefault("track", str(tag[126]))


def _vbr_table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    xing = at + 4 + 2 * h.protected + h.side
    if data[xing : xing + 4] in (b"Xing", b"Info"):
        out.vbr = data[xing : xing + 4].decode()
        flags, p = int.from_bytes(data[xing + 4 : xing + 8], "big"), xing + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc = data[p : p + 100]
        return True
    v = at + 36
    if data[v : v + 4] == b"VBRI":
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames = int.from_bytes(data[v + 10 : v + 14], "big"), int.from_bytes(data[v + 14 : v + 18], "big")
        entries, scale, size = (int.from_bytes(data[v + i : v + i + 2], "big") for i in (18, 20, 22))
        total, p = 0, v + 26
        for i in range(entries if size else 0):
            if p + (i + 1) * size > at + h.length:
                break
            total += scale * int.from_bytes(data[p + i * size : p + (i + 1) * size], "big")
            out.points.append(total)
        return True
    return False


def parse(data: bytes) -> Stream:
    out = Stream()
    at, n, first, last, free = _id3v2(data, out), len(data), True, None, 0
    end = n - 128 if n >= 128 and data[n - 128 : n - 125] == b"TAG" else n
    if end < n:
        _id3v1(data[end:], out)
    while at + 4 <= end:
        h = _header(int.from_bytes(data[at : at + 4], "big"))
        length = 0
        if h is not None:
            if not h.kbits and (not free or last is None):
                free = _free_length(data, at, h, end)
            length = h.length if h.kbits else free + h.pad if free else 0
            if not length:
                h = None
        if h is not None and last is not None:
            if (h.version, h.layer, h.rate) != last:
                h = None
        elif h is not None:
            after = at + length
            nxt = _header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            if after != end and (nxt is None or (nxt.version, nxt.layer, nxt.rate) != (h.version, h.layer, h.rate)):
                h = None
        if h is None or at + length > end:
            seek = data.find(b"\xff", at + 1, end)
            seek = end if seek < 0 else seek
            out.skipped += seek - at
            at, last = seek, None
            continue
        last = (h.version, h.layer, h.rate)
        if h.protected:
            out.crc_checked += 1
            out.crc_bad += not checksum_holds(data[at : at + min(length, 200)], h)
        if not (first and h.layer == 3 and _vbr_table(data, at, h, out)):
            out.offsets.append(at)
            body = at + 4 + 2 * h.protected + h.side
            out.bodies.append((body, at + length))
            out.samples += h.samples
            out.bitrates.add(h.kbits)
        out.rate, out.layer, out.channels, first = h.rate, h.layer, 1 if h.mono else 2, False
        at += length
    out.skipped += max(0, end - at)
    return out


def _frame_head(kbits: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a mono 32 kHz Layer III frame, and the frame's length."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | KBITS[True, 3].index(kbits) << 12 | 2 << 10 | 3 << 6
    head, side = word.to_bytes(4, "big"), bytes(17)
    return head + crc16(side, crc16(head[2:])).to_bytes(2, "big") + side, header(word).length


_FRAMES = [(k, *_frame_head(k)) for k in KBITS[True, 3][1:]]


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    size = len(body)
    return b"TXXX" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + b"\0\0" + body


def pack(data: bytes) -> bytes:
    """Stores bytes as the ancillary data of MPEG-1 Layer III frames behind an ID3v2 tag and a Xing table."""
    _, big, length = _FRAMES[-1]
    room = length - len(big)
    full = len(data) // room
    rest = data[full * room :]
    body = np.zeros((full, length), np.uint8)
    body[:, : len(big)] = np.frombuffer(big, np.uint8)
    body[:, len(big) :] = np.frombuffer(data, np.uint8, full * room).reshape(full, room)
    frames, parts = full, [body.tobytes()]
    if rest:
        _, head, size = next(f for f in _FRAMES if f[2] - len(f[1]) >= len(rest))
        parts.append(head + rest + bytes(size - len(head) - len(rest)))
        frames += 1
    audio = b"".join(parts)
    total = len(audio)
    # Audio that looks as if it ended in an ID3v1 tag gets a real, empty one behind it.
    end = b"TAG" + bytes(125) if audio[-128:-125] == b"TAG" else b""
    marks = [max(0, min(frames * i // 100, frames - 1)) * length for i in range(100)]
    toc = bytes(min(255, m * 256 // max(total, 1)) for m in marks)
    _, head, size = _FRAMES[3 if len(_FRAMES[3][1]) + 120 <= _FRAMES[3][2] else -1]
    xing = head + b"Xing" + struct.pack(">III", 7, frames, total) + toc
    xing += bytes(size - len(xing))
    tag = _text_frame("payload_bytes", str(len(data)))
    n = len(tag)
    return b"ID3\x04\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag + xing + audio + end


def payload(data: bytes, stream: Stream) -> bytes:
    size = int(stream.tags.get("payload_bytes", "0"))
    found = b"".join([data[a:b] for a, b in stream.bodies])[:size]
    if len(found) < size:
        raise ValueError(f"{len(found)} bytes of a payload of {size}")
    return found


def feature(s: Stream) -> str:
    """What is stored for seeking and playing; all values are exact integers."""
    seek = zlib.crc32(np.array(s.offsets, ">i8").tobytes())
    return (
        f"layer={s.layer};rate={s.rate};channels={s.channels};frames={len(s.offsets)};samples={s.samples};"
        f"bitrates={'/'.join(map(str, sorted(s.bitrates)))};vbr={s.vbr}:{s.vbr_frames}:{s.vbr_bytes}:{zlib.crc32(s.toc)};"
        f"crc={s.crc_checked}:{s.crc_bad};skipped={s.skipped};seek={seek}"
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, zero bytes up to a positive multiple of 64, as an audio stream."""

    def pack_batch(batch):
        ids, sizes, media = batch[id_col], [], []
        for t in batch[text_col].to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            media.append(pack(raw + bytes(-len(raw) % SLOTS if raw else SLOTS)))
        return {"doc_id": ids, "n_bytes": sizes, "media": media}

    return map_rows(docs.select(id_col, text_col), pack_batch, "doc_id long, n_bytes long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Parses the ``media`` column: durations, frames, seek offsets and the payload's digests."""

    def read_batch(batch):
        rows = []
        for m in batch["media"].to_pylist():
            s = parse(m)
            p = payload(m, s)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-SLOTS:]), len(m), hashlib.sha256(m).hexdigest(), feature(s), s.seconds, s.offsets))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets")
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"]} | {n: list(c) for n, c in zip(names, cols, strict=True)}

    return map_rows(
        media, read_batch,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>",
    )


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(store(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return inspect(media)
