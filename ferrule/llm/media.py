"""Operator 1: MPEG audio columns.

``encode_audio`` carries a payload losslessly in the ancillary bytes of Layer III frames (every frame is valid, silent and
protected by the standard's CRC-16) behind an ID3v2 tag and a Xing table. ``read_audio`` is a reader for any MPEG audio bytes:
it skips tags, resynchronises on frame headers, verifies checksums, reads Xing, Info and VBRI tables, and gives exact durations
(without the encoder's delay and padding where its tag names them) and the byte offset of every frame. Checksums of Layer II and frames of
free format are not read.

Defined results: null or empty texts give one block of padding; equal texts, however long, give equal media, and repeated rows and null doc_ids one
row each; empty tables give no rows; null media gives null features; damaged bytes are skipped and
counted in ``skipped_bytes``; bytes with no frame give zero frames; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 192
# Fixed values of the MPEG audio standard (ISO/IEC 11172-3 and 13818-3).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

#: What the writer uses: MPEG 1, Layer III, 32 kHz, mono, protected.
RATE, SAMPLES, SIDE = 32000, 1152, 17
HEAD = 4 + 2 + SIDE + 2  # header, checksum, side information, count of payload bytes in this frame
LENGTHS = tuple(144000 * b // RATE for b in BITRATES[1, 3])


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


#: Headers with side information repeat from frame to frame, so their checksums do.
checksum = lru_cache(1 << 14)(crc16)


class Header:
    """A frame header's fields; ``parse`` gives None where four bytes are none. ``guarded``: bytes behind the checksum that it covers, 0: not known."""

    __slots__ = ("version", "layer", "protected", "bitrate", "rate", "channels", "length", "samples", "side", "guarded")

    @classmethod
    @lru_cache(1 << 12)
    def parse(cls, four: bytes) -> Header | None:
        if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
            return None
        version, layer, at = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4
        rate = four[2] >> 2 & 3
        if version == 1 or layer == 4 or at in (0, 15) or rate == 3:
            return None
        h = cls()
        family = 1 if version == 3 else 2
        h.version, h.layer, h.protected = version, layer, not four[1] & 1
        h.bitrate, h.rate = BITRATES[family, layer][at], RATES[version][rate]
        h.channels = 1 if four[3] >> 6 == 3 else 2
        pad = four[2] >> 1 & 1
        if layer == 1:
            h.samples, h.length = 384, (12000 * h.bitrate // h.rate + pad) * 4
        else:
            h.samples = 576 if layer == 3 and family == 2 else 1152
            h.length = h.samples // 8 * 1000 * h.bitrate // h.rate + pad
        h.side = {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[family, h.channels] if layer == 3 else 0
        bound = 32 * (h.channels - 1) if four[3] >> 6 != 1 else 4 + 4 * (four[3] >> 4 & 3)  # subbands of Layer I with an allocation per channel
        h.guarded = h.side if layer == 3 else (32 + bound) // 2 if layer == 1 else 0
        return h


def frame(payload: bytes, at: int, body: bytes = b"") -> bytes:
    """One Layer III frame at a place of the bitrate table. Its side information says that no audio bits follow."""
    head = bytes((0xFF, 0xFA, at << 4 | 2 << 2, 0xC0))
    side = bytes(SIDE)
    out = head + checksum(head[2:] + side).to_bytes(2, "big") + side + (body or len(payload).to_bytes(2, "big") + payload)
    return out + bytes(LENGTHS[at] - len(out))


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode_audio(payload: bytes, title: str = "") -> bytes:
    """ID3v2.4 tag, a frame with the Xing table, then the payload in frames of the largest size, the last as small as it fits."""
    most = LENGTHS[-1] - HEAD
    frames = []
    for i in range(0, len(payload), most):
        part = payload[i : i + most]
        at = next(k for k in range(1, 15) if LENGTHS[k] - HEAD >= len(part))
        frames.append(frame(part, at))
    ends = [0]
    for f in frames:
        ends.append(ends[-1] + len(f))
    first = LENGTHS[9]
    total = first + ends[-1]
    toc = bytes(min(255, 256 * (first + ends[k * len(frames) // 100]) // total) for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\x03" + title.encode()
    tag = b"TIT2" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + frame(b"", 9, info) + b"".join(frames)


def whole(raw: bytes, bits: int) -> int:
    """A big-endian number whose bytes carry so many bits each."""
    n = 0
    for b in raw:
        n = n << bits | b
    return n


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag at a place ends, and its text fields. Extended headers are passed over, and unsynchronisation is undone."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    major, flags = data[at + 3], data[at + 5]
    end, fields, i = min(len(data), at + 10 + whole(data[at + 6 : at + 10], 7)), {}, 0
    tag = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major > 2:
        i = whole(tag[:4], 7) if major == 4 else 4 + whole(tag[:4], 8)
    wide, head = (3, 6) if major == 2 else (4, 10)
    while i + head <= len(tag) and tag[i : i + 1].isalnum():
        name, n = tag[i : i + wide].decode("latin-1"), whole(tag[i + wide : i + 2 * wide], 7 if major == 4 else 8)
        text = tag[i + head : i + head + n]
        if major == 4 and tag[i + 9] & 1:
            text = text[4:]  # the length before unsynchronisation
        if major == 4 and tag[i + 9] & 2:
            text = text.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and text:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1")
            fields[name] = text[1:].decode(coding, "replace").rstrip("\0")
        i += head + n
    return end + (10 if flags & 16 and major == 4 else 0), fields


def vbr_table(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in the frame at a place."""
    i = at + 4 + 2 * h.protected + h.side
    if data[i : i + 4] in (b"Xing", b"Info"):
        flags, out, i = int.from_bytes(data[i + 4 : i + 8], "big"), {"kind": data[i : i + 4].decode()}, i + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = int.from_bytes(data[i : i + 4], "big"), i + 4
        if flags & 4:
            out["toc"], i = list(data[i : i + 100]), i + 100
        i += 4 * (flags >> 3 & 1)
        if data[i : i + 4] in (b"LAME", b"Lavc", b"Lavf") and i + 24 <= at + h.length:  # the encoder's delay and padding, 12 bits each
            both = int.from_bytes(data[i + 21 : i + 24], "big")
            out["delay"], out["padding"] = both >> 12, both & 0xFFF
        return out
    i = at + 36
    if data[i : i + 4] == b"VBRI" and len(data) >= i + 26:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", data[i + 10 : i + 26])
        steps = [int.from_bytes(data[i + 26 + k * width : i + 26 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": steps, "frames_per_entry": per}
    return None


def read_audio(data: bytes) -> dict:
    """Features of MPEG audio bytes, with the bytes carried behind each frame's side information where that says that no audio follows.

    A header counts as a frame only if the next frame, a tag or the end follows it; else the search goes on one byte later.
    """
    end = len(data)
    tail = ""
    if data[-128:-125] == b"TAG":
        end, tail = end - 128, "ID3v1"
    at, fields = id3v2(data, 0)
    if tail and "TIT2" not in fields:
        fields["TIT2"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").rstrip()
    tags = [x for x in ("ID3v2" if at else "", tail) if x]
    skipped = bad = checked = bits = samples = 0
    vbr, shape, offsets, parts = None, None, [], []
    while at + 4 <= end:
        h = Header.parse(data[at : at + 4])
        follows = at + h.length if h else 0
        if not h or follows > end or (shape and shape != (h.version, h.layer, h.rate)) or not (
            follows + 4 > end or Header.parse(data[follows : follows + 4]) or data[follows : follows + 3] in (b"ID3", b"TAG")
        ):
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            skipped, at = skipped + near - at, near
            continue
        body = at + 4 + 2 * h.protected + h.side
        if h.protected and h.guarded:
            checked += 1
            bad += checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.guarded]) != int.from_bytes(data[at + 4 : at + 6], "big")
        table = None if offsets or vbr else vbr_table(data, at, h)
        shape = (h.version, h.layer, h.rate)
        if table:
            vbr = table
        else:
            offsets.append(at)
            samples, bits = samples + h.samples, bits + h.length * 8
            if h.layer == 3 and not any(data[body - h.side : body]):  # no audio bits: what follows was put there by ``frame``
                parts.append(data[body + 2 : body + 2 + int.from_bytes(data[body : body + 2], "big")])
        at = follows
    if at < end:
        skipped += end - at
    version, layer, rate = shape or (0, 0, 1)
    heard = max(0, samples - (vbr or {}).get("delay", 0) - (vbr or {}).get("padding", 0))
    return {
        "version": {3: "1", 2: "2", 0: "2.5"}[version] if shape else "", "layer": layer, "sample_rate": rate if shape else 0,
        "frames": len(offsets), "samples": samples, "duration_us": heard * 1_000_000 // rate, "mean_bitrate": bits * rate // samples if samples else 0,
        "tags": ",".join(tags), "title": fields.get("TIT2", ""), "vbr": vbr["kind"] if vbr else "", "vbr_frames": (vbr or {}).get("frames", 0),
        "vbr_bytes": (vbr or {}).get("bytes", 0), "checked": checked, "bad_checksums": bad, "skipped_bytes": skipped,
        "seek_offsets": offsets, "payload": b"".join(parts),
    }


FEATURES = (
    "version string, layer int, sample_rate int, frames long, samples long, duration_us long, mean_bitrate long, tags string, title string,"
    " vbr string, vbr_frames long, vbr_bytes long, checked long, bad_checksums long, skipped_bytes long, seek_offsets array<long>, payload binary"
)


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the block."""
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def texts_to_media(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes and media of each text, stored as MPEG audio."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            media = [encode_audio(pad(x)) for x in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads a ``media`` column: the key, n_bytes, sizes and digests, and a struct of features with durations and seek offsets."""
    schema = f"{key} long, n_bytes long, media_bytes long, media_sha256 string, features struct<{', '.join(': '.join(x.split(' ')) for x in FEATURES.replace(', ', ',').replace('  ', ' ').split(','))}>"
    kinds = [tuple(x.strip().split(" ")) for x in FEATURES.split(",")]
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    struct_type = pa.struct([(name, arrow[kind]) for name, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            yield pa.record_batch([
                batch.column(key), batch.column("n_bytes"), pa.array([None if m is None else len(m) for m in media], pa.int64()),
                pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([None if m is None else read_audio(m) for m in media], struct_type),
            ], [key, "n_bytes", "media_bytes", "media_sha256", "features"])

    return stored.select(key, "n_bytes", "media").mapInArrow(run, schema)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features")
    payload = f["payload"]
    shown = ("version", "layer", "sample_rate", "frames", "samples", "duration_us", "mean_bitrate", "tags", "vbr", "vbr_frames", "vbr_bytes", "checked", "bad_checksums", "skipped_bytes")
    return media_features(texts_to_media(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(";", *[F.concat(F.lit(f"{n}="), f[n].cast("string")) for n in shown],
                    F.concat(F.lit("seek="), F.md5(F.array_join(f["seek_offsets"].cast("array<string>"), ",")))).alias("feature"),
        f["duration_us"].alias("duration_us"), f["seek_offsets"].alias("seek_offsets"))
