"""MPEG audio columns: streams written and read frame by frame.

parse() walks any byte string: ID3v2 and ID3v1 tags, APE tags, Xing/Info and VBRI tables, and Layer I-III
frames of MPEG 1, 2 and 2.5. After garbage it searches for the next header that another header (or the end)
confirms. It verifies the CRC-16 of protected Layer III frames (over header and side information), and returns
exact sample counts and the byte offset of every frame.

encode() stores a payload losslessly: each frame is a protected Layer III mono frame with empty side
information, so its whole main data is ancillary, and the payload fills it byte by byte. The first frame is a Xing
table with frame and byte counts and a seek table; an ID3v2 tag holds the payload's length. Frames vary in bitrate:
the last is the smallest that fits the rest.

Query results: a null text is stored as an empty one (64 zero bytes); equal texts give equal values; repeated
rows give a row each; an empty table gives no rows; extra columns are ignored; a text of any length is stored whole.
A payload that is not read back intact raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rubrica.llm.common import slices, table

# Fixed values of the MPEG audio format (ISO/IEC 11172-3, 13818-3), in kbit/s and Hz.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def header(data: bytes, at: int) -> tuple | None:
    """(version, layer, rate, frame bytes, samples, protected, mono) of the frame header at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version = {3: 1, 2: 2, 0: 2.5}.get(b1 >> 3 & 3)
    layer = 4 - (b1 >> 1 & 3)
    if version is None or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3:
        return None
    family = 1 if version == 1 else 2
    rate = RATES[version][b2 >> 2 & 3]
    bits = BITRATES[family, layer][b2 >> 4] * 1000
    pad, samples = b2 >> 1 & 1, SAMPLES[family, layer]
    size = (12 * bits // rate + pad) * 4 if layer == 1 else samples // 8 * bits // rate + pad
    return version, layer, rate, size, samples, not b1 & 1, b3 >> 6 == 3


def side_bytes(version: float, mono: bool) -> int:
    return (17 if mono else 32) if version == 1 else (9 if mono else 17)


def tags(data: bytes) -> tuple[int, int, dict]:
    """First byte after leading tags, end before trailing ones, and their text fields.

    Audio may end in bytes that look like a trailing tag. Where the first frame's table counts the bytes up to the end of the file, nothing trails.
    """
    begin, end, found = 0, len(data), {}
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        major, flags = data[begin + 3], data[begin + 5]
        size = synchsafe(data[begin + 6 : begin + 10])
        at, stop = begin + 10, min(len(data), begin + 10 + size)
        while major >= 3 and at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            name = data[at : at + 4].decode("latin-1")
            n = synchsafe(data[at + 4 : at + 8]) if major == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            if name[0] == "T" and n:
                body = data[at + 11 : min(stop, at + 10 + n)]
                found[name] = body.decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[at + 10], "latin-1"), "replace").strip("\0")
            at += 10 + n
        begin = stop + (10 if flags & 16 else 0)
    first = header(data, begin)
    counted = vbr_table(data, begin, first) if first and begin + first[3] <= end else None
    if counted and begin + counted.get("bytes", 0) == end:
        return begin, end, found
    if data[end - 128 : end - 125] == b"TAG" and end - begin >= 128:
        found.setdefault("TIT2", data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1"))
        end -= 128
    if data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end -= min(end - begin, size + (32 if flags >> 31 else 0))
    return min(begin, end), end, found


def synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def vbr_table(data: bytes, at: int, head: tuple) -> dict | None:
    """The Xing/Info or VBRI table in a frame."""
    version, _, _, size, _, protected, mono = head
    x = at + 4 + 2 * protected + side_bytes(version, mono)
    if data[x : x + 4] in (b"Xing", b"Info") and at + size <= len(data):
        flags, out, x = struct.unpack(">I", data[x + 4 : x + 8])[0], {"kind": data[x : x + 4].decode()}, x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], x = struct.unpack(">I", data[x : x + 4])[0], x + 4
        if flags & 4:
            out["toc"] = list(data[x : x + 100])
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and len(data) >= x + 18:
        total, frames = struct.unpack(">II", data[x + 10 : x + 18])
        return {"kind": "VBRI", "frames": frames, "bytes": total}
    return None


def parse(data: bytes, body: bool = False) -> dict:
    """Everything about a stream; body adds the bytes after side information of its Layer III frames."""
    at, end, text = tags(data)
    out = {"tags": text, "vbr": None, "offsets": [], "samples": 0, "rate": 0, "crc_checked": 0, "crc_errors": 0, "skipped": 0, "body": []}
    checked: dict[bytes, int] = {}
    synced = False
    while at < end:
        head = header(data, at) if at + 4 <= end else None
        if head and not synced:  # a first header counts if the next one agrees, or the stream ends there
            after = header(data, at + head[3])
            head = head if at + head[3] == end or (at + head[3] < end and after and after[:3] == head[:3]) else None
        if not head or at + head[3] > end:
            synced = False
            found = data.find(b"\xff", at + 1, end)
            out["skipped"] += (found if found > 0 else end) - at
            at = found if found > 0 else end
            continue
        synced = True
        version, layer, rate, size, samples, protected, mono = head
        skip = 4 + 2 * protected
        if protected and layer == 3:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + side_bytes(version, mono)]
            if covered not in checked:
                checked[covered] = crc16(covered)
            out["crc_checked"] += 1
            out["crc_errors"] += checked[covered] != struct.unpack(">H", data[at + 4 : at + 6])[0]
        table_ = vbr_table(data, at, head) if not out["offsets"] and out["vbr"] is None else None
        if table_:
            out["vbr"] = table_
        else:
            out["offsets"].append(at)
            out["samples"] += samples
            if body and layer == 3:
                out["body"].append(data[at + skip + side_bytes(version, mono) : at + size])
        out["rate"] = rate
        at += size
    return out


class Encoder:
    """Writes payloads as MPEG-1 Layer III mono at 32 kHz; frames of a bitrate share their first 23 bytes."""

    RATE, SIDE = 32000, 17

    def __init__(self) -> None:
        self.kinds = []  # (payload bytes, first bytes)
        for index, kbits in enumerate(BITRATES[1, 3][1:], 1):
            head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 3 << 6])
            side = bytes(self.SIDE)
            start = head + struct.pack(">H", crc16(head[2:] + side)) + side
            self.kinds.append((144 * kbits * 1000 // self.RATE - len(start), start))
        self.table_kind = next(k for k in self.kinds if k[0] >= 116)

    def encode(self, payload: bytes) -> bytes:
        room, start = self.kinds[-1]
        whole, rest = divmod(len(payload), room)
        frames = [start + payload[i * room : (i + 1) * room] for i in range(whole)]
        if rest:
            least, first = next(k for k in self.kinds if k[0] >= rest)
            frames.append(first + payload[whole * room :] + bytes(least - rest))
        value = b"\0PAYLOAD\0" + str(len(payload)).encode()
        tag = b"TXXX" + struct.pack(">I", len(value)) + b"\0\0" + value
        n = len(tag)
        id3 = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag
        space, first = self.table_kind
        total = len(first) + space + sum(map(len, frames))
        toc, at = [], len(first) + space
        ends = []
        for f in frames:
            ends.append(at)
            at += len(f)
        for i in range(100):
            toc.append(min(255, 256 * ends[i * len(ends) // 100] // total) if ends else 0)
        xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
        return id3 + first + xing + bytes(space - len(xing)) + b"".join(frames)

    @staticmethod
    def decode(stream: bytes) -> tuple[bytes, dict]:
        info = parse(stream, body=True)
        length = int(info["tags"]["TXXX"].rpartition("\0")[2])
        payload = b"".join(info["body"])[:length]
        if len(payload) != length or info["crc_errors"] or info["skipped"]:
            raise ValueError("the stored stream does not hold its payload")
        return payload, info


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


SCHEMA = (
    "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_samples long, sample_rate int, crc_checked long, frame_offsets array<long>"
)


def store(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Every text as an MPEG stream, read back: digests, exact duration (n_samples / sample_rate) and frame offsets."""

    def run(batches):
        coder = Encoder()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows: list[list] = [[] for _ in range(12)]
            for text in batch.column("text").to_pylist():
                n, payload = pad(text)
                media = coder.encode(payload)
                back, info = coder.decode(media)
                offsets = info["offsets"]
                digest = zlib.crc32(struct.pack(f">{len(offsets)}Q", *offsets))
                feature = f"frames={len(offsets)};samples={info['samples']};rate={info['rate']};vbr={info['vbr']['frames']}/{info['vbr']['bytes']};crc={info['crc_checked']};seek={digest:08x}"
                values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, info["samples"], info["rate"], info["crc_checked"], offsets, media if with_media else None)
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)][: None if with_media else -1]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_samples", "sample_rate", "crc_checked", "frame_offsets", "media"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names[: len(columns)]])

    schema = SCHEMA.format(id=dict(docs.dtypes)["doc_id"]) + (", media binary" if with_media else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def describe(files: DataFrame) -> DataFrame:
    """(path, n_frames, n_samples, sample_rate, crc_errors, skipped, tags, frame_offsets) of files (path, content)."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "content")):
            found = [parse(c or b"") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([len(f["offsets"]) for f in found], pa.int64()), *[pa.array([f[k] for f in found], t) for k, t in (("samples", pa.int64()), ("rate", pa.int32()), ("crc_errors", pa.int64()), ("skipped", pa.int64()))],
                 pa.array([list(f["tags"].items()) for f in found], pa.map_(pa.string(), pa.string())), pa.array([f["offsets"] for f in found], pa.list_(pa.int64()))],
                ["path", "n_frames", "n_samples", "sample_rate", "crc_errors", "skipped", "tags", "frame_offsets"],
            )

    return files.select("path", "content").mapInArrow(run, "path string, n_frames long, n_samples long, sample_rate int, crc_errors long, skipped long, tags map<string,string>, frame_offsets array<long>")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))
