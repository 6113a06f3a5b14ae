"""Files behind the rows: fetching, texts of PDF reports, hashes and tags of images.

Extractors are functions of a file's bytes, which a caller may replace. The defaults use pdfplumber, PyPDF2 or Pillow where they are installed; without
them PDF texts are read here, by pages and fonts, or from any stream with text operators. JPEG, PNG and PNM images are decoded here, others by Pillow. A file that cannot be read has no
text, tags or hash; it never fails the job.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.functions.scalars import pdf_title
from rubrica.plans.staging import stage
from rubrica.sources.jpeg import read_jpeg
from rubrica.sources.pdf import pdf_text

# --- fetching ---


def fetch_url(url: str, timeout: float = 30, chunk: int = 8192) -> bytes:
    """The content of an address; raises on any failure."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:
        return b"".join(iter(lambda: answer.read(chunk), b""))


def fetched(paths: DataFrame, column: str = "path", fetch: Callable[[str], bytes] = fetch_url, tasks: int | None = None) -> DataFrame:
    """(path, content) of the distinct paths, staged; content is null where the fetch fails. There is one attempt a path, from `tasks` tasks (as many as a shuffle has, by default)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:  # one file at a time is held
                try:
                    content = fetch(path)
                except Exception:  # a file that cannot be fetched is a missing file
                    content = None
                yield pd.DataFrame({"path": [path], "content": pd.Series([content], dtype=object)})

    wanted = paths.where(F.col(column) != "").select(F.col(column).alias("path")).distinct().repartition(tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return stage(wanted.mapInPandas(run, "path string, content binary"), "fetched")


def stored(paths: DataFrame, folder: str, column: str = "path", base: str = EngineConfig().base_path) -> DataFrame:
    """(path, content) of the paths found in a folder that stands for the base address, in any store that Spark reads."""
    root = folder.rstrip("/") + "/"
    files = paths.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.substring_index("path", root, -1).alias("file"), "content")
    p = F.col(column)
    wanted = paths.where(p != "").select(p.alias("path"), F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).otherwise(p).alias("file")).distinct()
    return wanted.join(files, "file").select("path", "content")


# --- PDF ---

STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*)\]\s*TJ|(T\*|Td|TD|ET)", re.S)
PIECE = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d+\.?\d*", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
# Escapes of PDF strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else ESCAPES.get(m[1], m[1].replace(b"\n", b"")), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def plain_pdf(content: bytes) -> tuple[str, dict[str, str]]:
    """Text operators of the content streams in file order, and the string entries of the information dictionary."""
    pages = []
    for head, body in STREAM.findall(content):
        if b"/Subtype" in head and b"/Image" in head:
            continue
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        text = []
        for one, many, move in SHOWN.findall(body):
            if one:
                text.append(pdf_string(one))
            elif many:
                parts = PIECE.findall(many)
                text.append("".join(pdf_string(p) if p[:1] in b"(<" else " " if float(p) < -200 else "" for p in parts))
            elif text and move and text[-1] != "\n":
                text.append("\n")
        pages.append("".join(text).strip())
    info = {}
    for key in (b"Title", b"Author", b"Subject", b"Creator", b"Producer"):
        found = re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", content, re.S)
        if found:
            info["/" + key.decode()] = pdf_string(found[1])
    return "\n".join(p for p in pages if p), info


def read_pdf(content: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata) by the first that gives a text: two libraries, where they are installed, then pdf_text(); else by plain_pdf()."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            text = "\n".join(t for page in pdf.pages if (t := page.extract_text()))
            if text.strip():
                return text, {k: str(v) for k, v in (pdf.metadata or {}).items()}
    except Exception:  # absent, or unable to read this file
        pass
    try:
        import PyPDF2

        pdf = PyPDF2.PdfReader(io.BytesIO(content))
        text = "\n".join(t for page in pdf.pages if (t := page.extract_text()))
        if text.strip():
            return text, {k: str(v) if v else "" for k, v in (pdf.metadata or {}).items()}
    except Exception:
        pass
    try:
        text, info = pdf_text(content)
        if text.strip():
            return text, info
    except Exception:  # encrypted, or no pages that can be read
        pass
    return plain_pdf(content)


def reports(files: DataFrame, extract: Callable[[bytes], tuple[str, dict[str, str]]] = read_pdf) -> DataFrame:
    """(path, text, title, metadata) of files (path, content) that exist; an unreadable file has an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for content in pdf["content"]:
                try:
                    got.append(extract(bytes(content)))
                except Exception:
                    got.append(("", {}))
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in got], "metadata": [m for _, m in got]})

    out = files.where("content is not null").select("path", "content").mapInPandas(run, "path string, text string, metadata map<string,string>")
    return out.withColumn("title", pdf_title(F.col("metadata"), F.col("text")))


# --- images ---

# Numbers of EXIF tags and of the position directory.
EXIF_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x8769: "ExifOffset", 0x8825: "GPSInfo"}


def exif(content: bytes) -> dict[str, str]:
    """The tags of the first directory of an EXIF block; GPSInfo is there if the image tells its place."""
    start = content.find(b"Exif\0\0")
    if start < 0:
        return {}
    data = content[start + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return {}
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n, value = struct.unpack(order + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
        name = EXIF_TAGS.get(tag, str(tag))
        if kind == 2:
            raw = data[value : value + n] if n > 4 else data[at + 10 + 12 * i : at + 10 + 12 * i + n]
            out[name] = raw.rstrip(b"\0").decode("latin-1")
        elif kind == 3:
            out[name] = str(struct.unpack(order + "H", data[at + 10 + 12 * i : at + 12 + 12 * i])[0])
        else:
            out[name] = str(value)
    return out


def read_png(content: bytes) -> np.ndarray:
    """Grey levels of a PNG of 8 bits a sample that is not interlaced."""
    at, chunks = 8, []
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    palette = None
    while at < len(content):
        n, name = struct.unpack(">I4s", content[at : at + 8])
        if name == b"IDAT":
            chunks.append(content[at + 8 : at + 8 + n])
        elif name == b"PLTE":
            palette = np.frombuffer(content[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3)
        at += 12 + n
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or interlaced:
        raise ValueError("only plain PNG of 8 bits is read")
    raw = np.frombuffer(zlib.decompress(b"".join(chunks)), np.uint8).reshape(height, 1 + width * samples)
    rows = np.zeros((height, width * samples), np.uint8)
    zero = np.zeros(width * samples, np.uint8)
    for y in range(height):
        how, line, up = raw[y, 0], raw[y, 1:], rows[y - 1] if y else zero
        if how == 0:
            rows[y] = line
        elif how == 2:
            rows[y] = line + up
        else:
            for x in range(width * samples):
                a, b = int(rows[y, x - samples]) if x >= samples else 0, int(up[x])
                c = int(up[x - samples]) if x >= samples else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                rows[y, x] = (int(line[x]) + {1: a, 3: (a + b) // 2, 4: near}[int(how)]) & 255
    pixels = rows.reshape(height, width, samples)
    if kind == 3:
        pixels = palette[pixels[:, :, 0]]
    return grey(pixels)


def read_pnm(content: bytes) -> np.ndarray:
    head = re.match(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
    width, height, samples = int(head[2]), int(head[3]), 1 if head[1] == b"5" else 3
    return grey(np.frombuffer(content, np.uint8, width * height * samples, head.end()).reshape(height, width, samples))


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(float)
    return pixels[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def decode(content: bytes) -> np.ndarray:
    """Grey levels of an image; raises where it cannot be read."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(content)
    if content[:2] in (b"P5", b"P6"):
        return read_pnm(content)
    if content[:2] == b"\xff\xd8":
        return read_jpeg(content)
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"), float)


SIDE, KEPT = 32, 8


@lru_cache
def waves() -> np.ndarray:
    """[frequency, pixel] of the cosine transform, the lowest frequencies only."""
    k, i = np.arange(KEPT)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * (2 * i + 1) * k / (2 * SIDE))


def resized(pixels: np.ndarray) -> np.ndarray:
    """SIDE by SIDE means of the areas that each new pixel covers."""

    def cover(n: int) -> np.ndarray:
        edges = np.arange(SIDE + 1) * n / SIDE
        return np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)[None]) - np.maximum(edges[:-1, None], np.arange(n)[None]), 0, None) * SIDE / n

    return cover(pixels.shape[0]) @ pixels @ cover(pixels.shape[1]).T


def phash(pixels: np.ndarray) -> str:
    """16 hexadecimal characters: which of the 64 lowest frequencies are above their median."""
    low = waves() @ resized(np.asarray(pixels, float)) @ waves().T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def phash_of(pixels: Column) -> Column:
    """phash() of a square picture given as an array of its grey levels, row by row."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        side = lambda v: round(len(v) ** 0.5)
        return values.map(lambda v: None if v is None or not len(v) else phash(np.asarray(v, float).reshape(side(v), -1)))

    return run(pixels)


def image_features(files: DataFrame, read: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, sha256, phash, exif, has_geotag) of files (path, content) that exist."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def attempt(fn, content, default):
            try:
                return fn(bytes(content))
            except Exception:  # an image that cannot be read has no hash and no tags
                return default

        for pdf in batches:
            tags = [attempt(exif, c, {}) for c in pdf["content"]]
            hashes = [attempt(lambda b: phash(read(b)), c, None) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "sha256": pdf["sha256"], "phash": hashes, "exif": tags, "has_geotag": ["GPSInfo" in t for t in tags]})

    there = files.where("content is not null").select("path", "content", F.sha2("content", 256).alias("sha256"))
    return there.mapInPandas(run, "path string, sha256 string, phash string, exif map<string,string>, has_geotag boolean")
