"""Grey levels of JPEG files: Huffman-coded pictures of 8 bits, sequential or progressive, with or without restarts.

Only what a hash of the brightness needs is kept: of a picture in luminance and colour differences, the luminance alone. Coefficients are read by
table look-ups on 16 bits at a time; the cosine transform of all blocks is one matrix product. A file that is cut short or broken raises ValueError,
as do arithmetic coding, 12 bits a sample and four colours (inks).
"""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Numbers of the markers.
SOI, EOI, SOS, DHT, DQT, DRI, APP14 = 0xD8, 0xD9, 0xDA, 0xC4, 0xDB, 0xDD, 0xEE
SEQUENTIAL, PROGRESSIVE, REFUSED = {0xC0, 0xC1}, {0xC2}, {0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}
#: Coefficients that a picture may have at most; beyond it the header is taken for broken.
LARGEST = 1 << 29


def zigzag() -> list[int]:
    """Place of the k-th stored coefficient in a block, row by row: along diagonals, in turns of direction."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return [8 * y + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))]


ZIGZAG = zigzag() + [63] * 16  # a broken run may point behind the block


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next: 256 times the length of the code they begin with, plus its symbol; 0 for none."""
    table, at, code = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return table.tolist()


@dataclass
class Plane:
    """One component: its sampling, its table of steps, its blocks."""

    number: int
    across: int
    down: int
    steps: int
    kept: bool = True
    width: int = 0
    height: int = 0
    row: int = 0
    rows: int = 0
    values: array = field(default_factory=lambda: array("h"))


class Bits:
    """One stretch of coded data between restarts. Zeros follow its end; reading far into them means that it is cut short."""

    def __init__(self, data: bytes) -> None:
        self.end = 8 * len(data)
        self.data, self.at = data + bytes(64), 0

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big") >> 32 - n - (at & 7) & (1 << n) - 1 if n else 0

    def symbol(self, table: list[int]) -> int:
        at = self.at
        found = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big") >> 16 - (at & 7) & 0xFFFF]
        if not found or at > self.end:
            raise ValueError("broken or cut short")
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        """n bits as a number whose leading bit tells its sign."""
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


class Scan:
    """What one scan adds to the coefficients of its planes."""

    def __init__(self, planes: list[Plane], dc: list, ac: list, first: int, last: int, high: int, low: int, progressive: bool) -> None:
        self.planes, self.dc, self.ac = planes, dc, ac
        self.first, self.last, self.high, self.low = first, last, high, low
        self.read = (self.refine if high else self.part) if progressive else self.whole
        self.restart()

    def restart(self) -> None:
        self.before = [0] * len(self.planes)
        self.skip = 0

    def whole(self, bits: Bits, i: int, at: int) -> None:
        """A block of a sequential picture."""
        plane = self.planes[i]
        values, kept, table = plane.values, plane.kept, self.ac[i]
        self.before[i] += bits.signed(bits.symbol(self.dc[i]))
        if kept:
            values[at] = self.before[i]
        k, data, p = 1, bits.data, bits.at
        while k < 64:
            found = table[int.from_bytes(data[p >> 3 : (p >> 3) + 4], "big") >> 16 - (p & 7) & 0xFFFF]
            p += found >> 8
            n = found & 15
            if n:
                k += found >> 4 & 15
                if kept:
                    value = int.from_bytes(data[p >> 3 : (p >> 3) + 4], "big") >> 32 - n - (p & 7) & (1 << n) - 1
                    values[at + ZIGZAG[k]] = value if value >> (n - 1) else value - (1 << n) + 1
                p += n
                k += 1
            elif found & 0xF0 == 0xF0:
                k += 16
            elif found:
                break
            else:
                raise ValueError("no such code")
        bits.at = p
        if p > bits.end:
            raise ValueError("cut short")

    def part(self, bits: Bits, i: int, at: int) -> None:
        """A block's first bits of some coefficients."""
        values = self.planes[i].values
        if not self.first:
            self.before[i] += bits.signed(bits.symbol(self.dc[i]))
            values[at] = self.before[i] << self.low
            return
        if self.skip:
            self.skip -= 1
            return
        k = self.first
        while k <= self.last:
            code = bits.symbol(self.ac[i])
            run, n = code >> 4, code & 15
            if n:
                k += run
                values[at + ZIGZAG[k]] = bits.signed(n) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + bits.take(run)
                return

    def refine(self, bits: Bits, i: int, at: int) -> None:
        """One more bit of coefficients that earlier scans have begun, and new ones of that size."""
        values, one = self.planes[i].values, 1 << self.low
        if not self.first:
            values[at] |= bits.take(1) << self.low
            return
        k, last = self.first, self.last

        def correct(place: int) -> None:
            if bits.take(1) and not abs(values[place]) & one:
                values[place] += one if values[place] > 0 else -one

        if not self.skip:
            while k <= last:
                code = bits.symbol(self.ac[i])
                run, new = code >> 4, 0
                if code & 15:
                    new = one if bits.take(1) else -one
                elif run < 15:
                    self.skip = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    place = at + ZIGZAG[k]
                    if values[place]:
                        correct(place)
                    elif run:
                        run -= 1
                    else:
                        values[place] = new
                        k += 1
                        break
                    k += 1
        if self.skip:
            for k in range(k, last + 1):
                if values[at + ZIGZAG[k]]:
                    correct(at + ZIGZAG[k])
            self.skip -= 1


class Picture:
    """A file's tables and planes, filled marker by marker."""

    def __init__(self, content: bytes) -> None:
        self.content, self.steps, self.codes = content, {}, {}
        self.planes: list[Plane] = []
        self.width = self.height = self.every = 0
        self.transform, self.progressive, self.seen = None, False, False
        self.run()

    def run(self) -> None:
        content, at = self.content, 2
        if content[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while True:
            at = content.index(b"\xff", at)  # ValueError where the file ends without its last marker
            while content[at : at + 1] == b"\xff":
                at += 1
            kind = content[at]
            at += 1
            if kind == EOI:
                break
            if kind in (0, 1, SOI) or 0xD0 <= kind <= 0xD7:
                continue
            size = struct.unpack(">H", content[at : at + 2])[0]
            body = content[at + 2 : at + size]
            if len(body) != size - 2:
                raise ValueError("cut short")
            at += size
            if kind == DQT:
                self.quantisers(body)
            elif kind == DHT:
                self.huffman(body)
            elif kind == DRI:
                self.every = struct.unpack(">H", body)[0]
            elif kind == APP14 and body[:5] == b"Adobe" and len(body) >= 12:
                self.transform = body[11]
            elif kind in SEQUENTIAL | PROGRESSIVE:
                self.frame(body, kind in PROGRESSIVE)
            elif kind in REFUSED:
                raise ValueError("a kind of JPEG that is not read")
            elif kind == SOS:
                at = self.scan(body, at)
        if not self.seen:
            raise ValueError("no picture")

    def quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            stored = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
            table = np.zeros(64)
            table[ZIGZAG[:64]] = stored
            self.steps[number] = table
            at += 1 + 64 * (1 + bool(wide))

    def huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.codes[body[at] >> 4, body[at] & 15] = lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def frame(self, body: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or self.planes or n not in (1, 3) or not self.width or not self.height:
            raise ValueError("a kind of JPEG that is not read")
        self.progressive = progressive
        self.planes = [Plane(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.wide, self.tall = max(p.across for p in self.planes), max(p.down for p in self.planes)
        if not all(p.across and p.down for p in self.planes):
            raise ValueError("no sampling")
        if n == 1:
            self.planes[0].across = self.planes[0].down = self.wide = self.tall = 1
        self.mcus, self.mcu_rows = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.tall))
        colours = n == 3 and (self.transform == 0 or (self.transform is None and bytes(p.number for p in self.planes) == b"RGB"))
        self.weights = [0.299, 0.587, 0.114] if colours else [1.0]
        for i, p in enumerate(self.planes):
            p.width, p.height = -(-self.width * p.across // self.wide), -(-self.height * p.down // self.tall)
            p.row, p.rows, p.kept = self.mcus * p.across, self.mcu_rows * p.down, i < len(self.weights)
            if 64 * p.row * p.rows > LARGEST:
                raise ValueError("too large")
            p.values = array("h", bytes(128 * p.row * p.rows)) if p.kept or progressive else p.values

    def stretches(self, at: int) -> tuple[list[bytes], int]:
        """The coded data from `at` up to the next marker but restarts, without stuffing; and where it ends."""
        out, start, content = [], at, self.content
        while True:
            at = content.index(b"\xff", at)
            mark = content[at + 1 : at + 2]
            if mark == b"\0" or mark == b"\xff":
                at += 2 if mark == b"\0" else 1
            elif mark and 0xD0 <= mark[0] <= 0xD7:
                out.append(content[start:at].replace(b"\xff\0", b"\xff"))
                at += 2
                start = at
            else:
                return [*out, content[start:at].replace(b"\xff\0", b"\xff")], at

    def scan(self, body: bytes, at: int) -> int:
        n = body[0]
        named = {p.number: p for p in self.planes}
        planes = [named[body[1 + 2 * i]] for i in range(n)]
        tables = [body[2 + 2 * i] for i in range(n)]
        first, last, bits = body[1 + 2 * n : 4 + 2 * n]
        data, end = self.stretches(at)
        self.seen = True
        if self.progressive and first and not planes[0].kept:
            return end  # details of a plane that is not looked at
        scan = Scan(planes, [self.codes.get((0, t >> 4)) for t in tables], [self.codes.get((1, t & 15)) for t in tables], first, min(last, 63), bits >> 4, bits & 15, self.progressive)
        if n == 1:
            plane = planes[0]
            across, down = -(-plane.width // 8), -(-plane.height // 8)
            units = [[(0, 64 * (y * plane.row + x))] for y in range(down) for x in range(across)]
        else:
            units = (self.unit(planes, y, x) for y in range(self.mcu_rows) for x in range(self.mcus))
        total = len(units) if n == 1 else self.mcus * self.mcu_rows
        if len(data) < (-(-total // self.every) if self.every else 1):
            raise ValueError("cut short")
        stretch, read = iter(data), scan.read
        source = None
        for count, unit in enumerate(units):
            if source is None or self.every and count % self.every == 0:
                source = Bits(next(stretch))
                scan.restart()
            for i, place in unit:
                read(source, i, place)
            if source.at > source.end:
                raise ValueError("cut short")
        return end

    @staticmethod
    def unit(planes: list[Plane], y: int, x: int) -> list[tuple[int, int]]:
        """(plane, place) of the blocks of one interleaved unit."""
        return [(i, 64 * ((y * p.down + v) * p.row + x * p.across + h)) for i, p in enumerate(planes) for v in range(p.down) for h in range(p.across)]

    def levels(self, plane: Plane) -> np.ndarray:
        """Samples of a plane, 0 to 255."""
        k, i = np.arange(8)[:, None], np.arange(8)[None]
        wave = (np.cos(np.pi * (2 * i + 1) * k / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
        blocks = np.frombuffer(plane.values, np.int16).reshape(-1, 64) * self.steps[plane.steps].astype(np.float32)
        pixels = wave.T @ blocks.reshape(-1, 8, 8) @ wave
        rows = pixels.reshape(plane.rows, plane.row, 8, 8).transpose(0, 2, 1, 3).reshape(8 * plane.rows, 8 * plane.row)
        return np.clip(np.rint(rows[: plane.height, : plane.width] + 128), 0, 255)


def read_jpeg(content: bytes) -> np.ndarray:
    """Grey levels of a picture. Planes of different sampling are brought to the largest by repetition."""
    picture = Picture(content)
    planes = [picture.levels(p) for p, _ in zip(picture.planes, picture.weights)]
    if len(planes) == 1:
        return planes[0]
    height, width = max(p.shape[0] for p in planes), max(p.shape[1] for p in planes)
    spread = lambda p: p[np.arange(height) * p.shape[0] // height][:, np.arange(width) * p.shape[1] // width]
    return sum(w * spread(p) for w, p in zip(picture.weights, planes))
