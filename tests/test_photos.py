"""JPEG photos against the decoder of the Java library, and duplicates among them."""

import csv
import struct

import numpy as np
import pytest

from rubrica import __main__ as cli
from rubrica.functions.scalars import hamming
from rubrica.sources import assets, jpeg


class Imaging:
    """Java's own encoder and decoder, by the session's JVM."""

    def __init__(self, spark):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway

    def ints(self, values):
        """Numbers as the JVM's array, sent as bytes."""
        raw = np.asarray(values, ">i4").tobytes()
        out = self.gateway.new_array(self.jvm.int, len(raw) // 4)
        self.jvm.java.nio.ByteBuffer.wrap(bytearray(raw)).asIntBuffer().get(out)
        return out

    def numbers(self, values, n):
        """The JVM's array as numbers."""
        held = self.jvm.java.nio.ByteBuffer.allocate(4 * n)
        held.asIntBuffer().put(values)
        return np.frombuffer(bytes(held.array()), ">i4")

    def encode(self, pixels, quality=0.8, progressive=False):
        """A picture of three colours, or of grey levels where pixels have no third axis."""
        height, width = pixels.shape[:2]
        image = self.jvm.java.awt.image.BufferedImage(width, height, 10 if pixels.ndim == 2 else 1)
        image.getRaster().setPixels(0, 0, width, height, self.ints(pixels.astype(int).ravel()))
        writer = self.jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        how.setCompressionMode(2)
        how.setCompressionQuality(quality)
        how.setProgressiveMode(1 if progressive else 0)
        out = self.jvm.java.io.ByteArrayOutputStream()
        stream = self.jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(image, None, None), how)
        stream.flush()
        return bytes(out.toByteArray())

    def decode(self, content):
        image = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(content))
        raster, width, height = image.getRaster(), image.getWidth(), image.getHeight()
        bands = raster.getNumBands()
        n = width * height * bands
        samples = self.numbers(raster.getPixels(0, 0, width, height, self.ints([0] * n)), n).astype(float).reshape(height, width, bands)
        return samples[:, :, 0] if bands == 1 else samples @ np.array([0.299, 0.587, 0.114])


@pytest.fixture(scope="module")
def java(spark):
    return Imaging(spark)


def photo(height, width, seed=0, grey=False):
    y, x = np.mgrid[0:height, 0:width]
    base = np.stack([127 + 100 * np.sin(x / 9 + y / 17 + seed), 127 + 90 * np.cos(y / 11 + seed), (x * 3 + y) % 256], -1)
    pixels = np.clip(base + np.random.default_rng(seed).normal(0, 8, base.shape), 0, 255)
    return pixels[:, :, 1] if grey else pixels


@pytest.mark.parametrize("size", [(60, 77), (64, 64), (8, 8), (1, 1), (33, 130), (17, 16)])
@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("grey", [False, True])
def test_jpeg_equals_java(java, size, progressive, grey):
    """Colours are stored at a quarter of the resolution, so brightness differs where Java clips a colour."""
    content = java.encode(photo(*size, grey=grey), progressive=progressive)
    got, want = assets.decode(content), java.decode(content)
    assert got.shape == want.shape and np.abs(got - want).max() <= (1 if grey else 4) and np.abs(got - want).mean() < 0.5


def test_hash_of_a_smooth_picture_equals_java(java):
    y, x = np.mgrid[0:90, 0:120]
    pixels = np.stack([100 + 60 * np.sin(x / 23 + y / 31), 120 + 50 * np.cos(x / 40 - y / 13), 90 + x / 2], -1)
    for progressive in (False, True):
        content = java.encode(pixels, 0.95, progressive)
        apart = bin(int(assets.phash(assets.decode(content)), 16) ^ int(assets.phash(java.decode(content)), 16)).count("1")
        assert apart <= 2  # bits at the median may turn


class Writer:
    """A sequential encoder of coefficients, with restarts and any sampling; codes of 4 and 8 bits."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def block(self, coefficients, before):
        step = int(coefficients[0]) - before
        self.put(abs(step).bit_length(), 4)
        self.number(step)
        run = 0
        for v in (int(coefficients[z]) for z in jpeg.ZIGZAG[1:64]):
            if not v:
                run += 1
                continue
            while run > 15:
                self.put(SYMBOLS.index(0xF0), 8)
                run -= 16
            self.put(SYMBOLS.index(run << 4 | abs(v).bit_length()), 8)
            self.number(v)
            run = 0
        if run:
            self.put(SYMBOLS.index(0), 8)
        return int(coefficients[0])

    def flush(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


SYMBOLS = [0, 0xF0, *(run << 4 | n for run in range(16) for n in range(1, 11))]


def segment(kind, body):
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def encoded(planes, sampling, size, every=0, adobe=None):
    """planes: blocks [rows, row, 64] of coefficients; one table of steps of 1."""
    height, width = size
    out = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64)
    out += b"" if adobe is None else segment(0xEE, b"Adobe" + struct.pack(">HHHB", 100, 0, 0, adobe))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling)))
    out += segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    out += segment(0xC4, b"\x10" + bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8) + bytes(SYMBOLS))
    out += segment(0xDD, struct.pack(">H", every)) if every else b""
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    wide, tall = max(a for a, _ in sampling), max(d for _, d in sampling)
    if len(planes) == 1:
        sampling = [(1, 1)]
        wide = tall = 1
    writer, before, n = Writer(), [0] * len(planes), 0
    for y in range(-(-height // (8 * tall))):
        for x in range(-(-width // (8 * wide))):
            if every and n and n % every == 0:
                out += writer.flush() + bytes([255, 0xD0 + (n // every - 1) % 8])
                before = [0] * len(planes)
            for i, (a, d) in enumerate(sampling):
                for v in range(d):
                    for h in range(a):
                        before[i] = writer.block(planes[i][y * d + v, x * a + h], before[i])
            n += 1
    return out + writer.flush() + b"\xff\xd9"


def blocks(rng, rows, row):
    out = np.zeros((rows, row, 64), int)
    out[:, :, 0] = rng.integers(-600, 600, (rows, row))
    for _ in range(6):
        out[:, :, rng.integers(1, 64)] = rng.integers(-90, 90, (rows, row))
    return out


def direct(plane, height, width):
    """Samples by the definition of the inverse cosine transform."""
    scale = np.array([np.sqrt(1 / 8)] + [0.5] * 7)
    wave = np.array([[scale[k] * np.cos((2 * i + 1) * k * np.pi / 16) for i in range(8)] for k in range(8)])
    rows = [np.hstack([np.einsum("ki,kl,lj->ij", wave, b.reshape(8, 8), wave) for b in line]) for line in plane]
    return np.clip(np.rint(np.vstack(rows)[:height, :width] + 128), 0, 255)


@pytest.mark.parametrize("every", [0, 1, 3, 100])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3, [(4, 1), (1, 1), (2, 1)]])
def test_restarts_and_sampling(java, every, sampling):
    rng, size = np.random.default_rng(4), (37, 50)
    wide, tall = (max(s[i] for s in sampling) for i in (0, 1)) if len(sampling) > 1 else (1, 1)
    across, down = -(-size[1] // (8 * wide)), -(-size[0] // (8 * tall))
    planes = [blocks(rng, down * (d if len(sampling) > 1 else 1), across * (a if len(sampling) > 1 else 1)) for a, d in sampling]
    content = encoded(planes, sampling, size, every)
    want = direct(planes[0], *size)
    assert np.abs(jpeg.read_jpeg(content) - want).max() <= 1
    if len(sampling) == 1:
        assert np.abs(java.decode(content) - want).max() <= 2  # the test's encoder writes what others read


def test_colours_without_transform():
    rng, size = np.random.default_rng(6), (16, 24)
    planes = [blocks(rng, 2, 3) for _ in range(3)]
    got = jpeg.read_jpeg(encoded(planes, [(1, 1)] * 3, size, adobe=0))
    assert np.abs(got - sum(w * direct(p, *size) for w, p in zip((0.299, 0.587, 0.114), planes))).max() < 1.5
    assert np.abs(jpeg.read_jpeg(encoded(planes, [(1, 1)] * 3, size, adobe=1)) - direct(planes[0], *size)).max() <= 1


def test_broken_photos_have_no_hash(spark, java):
    fine, progressive = java.encode(photo(60, 77)), java.encode(photo(60, 77), progressive=True)
    arithmetic = fine.replace(b"\xff\xc0", b"\xff\xc9", 1)
    inks = fine.replace(b"\x03\x01\x22", b"\x04\x01\x22", 1)
    broken = [b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", fine[:300], fine[: len(fine) // 2], fine[:-40] + b"\xff\xd9", progressive[: len(progressive) // 2], arithmetic, inks, fine[:170] + b"\xff" * 60 + fine[230:]]
    for content in broken:
        with pytest.raises((ValueError, IndexError, KeyError, TypeError, struct.error)):
            jpeg.read_jpeg(content)
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate([fine, *broken])], "path string, content binary")
    got = {r.path: (r.phash is not None, len(r.sha256)) for r in assets.image_features(files).collect()}
    assert got == {str(i): (i == 0, 64) for i in range(len(broken) + 1)}


def test_noise_never_hangs():
    """Any change of bytes gives a picture or an error."""
    rng = np.random.default_rng(3)
    fine = encoded([blocks(rng, 4, 5)], [(1, 1)], (32, 40), 3)
    for _ in range(300):
        noisy = bytearray(fine)
        for at in rng.integers(2, len(fine), 3):
            noisy[at] = rng.integers(0, 256)
        try:
            jpeg.read_jpeg(bytes(noisy))
        except (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, MemoryError, struct.error):
            pass


def test_command_line_finds_copies_of_photos(spark, java, tmp_path):
    """The same photo in two qualities, and another one: the copy is told, as similar and not identical."""
    folder = tmp_path / "container" / "photos"
    folder.mkdir(parents=True)
    y, x = np.mgrid[0:120, 0:160]
    scene = lambda s: np.clip(np.stack([128 + 70 * np.sin(x / (17 + s) + y / 29), 128 + 60 * np.cos(x / 37 - y / (11 + 3 * s)), 100 + 50 * np.sin(y / 19 + s)], -1), 0, 255)
    contents = {"a.jpg": java.encode(scene(0), 0.95), "b.jpg": java.encode(scene(0), 0.8, progressive=True), "c.jpg": java.encode(scene(9), 0.9)}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    hashes = {n: assets.phash(assets.decode(c)) for n, c in contents.items()}
    apart = lambda a, b: spark.range(1).select(hamming(*[__import__("pyspark.sql.functions", fromlist=["lit"]).lit(hashes[n]) for n in (a, b)])).first()[0]
    assert apart("a.jpg", "b.jpg") <= 5 < min(apart("a.jpg", "c.jpg"), apart("b.jpg", "c.jpg"))
    rows = "".join(f"{i},Talk {i},Theme,3,20,2,1,none.pdf,photos/{n}\n" for i, n in ((1, "a.jpg"), (2, "b.jpg"), (3, "c.jpg")))
    (tmp_path / "in.csv").write_text("id,activity_name,event_theme,activity_duration,student_participants,faculty_participants,event_driven,report,photo1\n" + rows)
    target = str(tmp_path / "r.csv")
    assert cli.main([str(tmp_path / "in.csv"), "--output-csv", target, "--files", str(tmp_path / "container"), "--log-level", "ERROR", "--non-interactive"]) == 0
    told = [r["Requirements Not Met"] for r in csv.DictReader(open(target, encoding="utf-8-sig"))]
    assert "similar" in told[1] and "identical" not in told[1]
    assert not any("Image similar" in t or "identical" in t for t in (told[0], told[2]))


def test_the_target_scan_is_one_query(spark, monkeypatch):
    """The target is no query of its own, which would shuffle all photos once more."""
    from rubrica.plans.queries import photos

    monkeypatch.setattr(photos, "target", lambda d: pytest.fail("a query of its own"))
    rows = photos.QUERIES["dup_target_scan"](spark, "/root/testdata/sf0.001").collect()
    assert rows and "exact" in {r["match"] for r in rows}
