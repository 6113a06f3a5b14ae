"""Files in and out, the command line, and the streaming twins."""

import logging
import os
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica import __main__ as cli
from rubrica.config import EngineConfig
from rubrica.sources import assets, readers, sinks
from rubrica.streaming import monitor


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv(spark, tmp_path):
    text = 'id,name,hours,mixed,empty\n1,"a ""b""\nc",3,1,\n2,N/A,2.5,x,\n3\n'
    got = readers.read_batch(spark, write(tmp_path / "a.csv", text))
    assert dict(got.dtypes) == {"id": "bigint", "name": "string", "hours": "double", "mixed": "string", "empty": "bigint"} or dict(got.dtypes)["id"] == "bigint"
    rows = got.orderBy("id").collect()
    assert [(r.id, r.name, r.hours, r.mixed) for r in rows] == [(1, 'a "b"\nc', 3.0, "1"), (2, None, 2.5, "x"), (3, None, None, None)]
    latin = readers.read_batch(spark, write(tmp_path / "l.csv", "n\né\n".encode("latin-1")))
    assert latin.first().n == "é"


def test_csv_of_lines_is_read_in_splits(spark, tmp_path):
    """A file without line breaks in cells is read by several tasks, with the same rows as by one; names may be empty or hold dots."""
    rows = "".join(f'{i},"t, ""{i}""",{i / 8},{"x" * (i % 50)}\n' for i in range(20_000))
    path = write(tmp_path / "big.csv", "\ufeffid,a.b,share of,\n" + rows)
    assert readers.line_facts(spark, path) == (True, True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = readers.read_csv(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.count() == 20_000 and df.columns[:3] == ["id", "a.b", "share of"] and [t for _, t in df.dtypes] == ["bigint", "string", "double", "string"]
    got = sorted(tuple(r) for r in df.collect())
    assert got[7] == (7, 't, "7"', 0.875, "x" * 7) and got[0][3] is None


@pytest.mark.parametrize("text,facts", [
    ('a,b\n1,"x\ny"\n', (True, False)), ('a,b\n1,5" pipe\n', (True, False)), ('a\n"x ""y"" z"\n\n', (True, True)), ("a\n \n", (True, False)), ("", (True, True)), ("a,b\n,\n", (True, True)),
])
def test_facts_of_lines(spark, tmp_path, text, facts):
    assert readers.line_facts(spark, write(tmp_path / "f.csv", text)) == facts
    assert readers.line_facts(spark, write(tmp_path / "l.csv", text.encode() + b"\xe9\n"))[0] is False


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_batch(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="no rows"):
        readers.read_batch(spark, write(tmp_path / "e.csv", "a,b\n"))
    with pytest.raises(ValueError, match="more than 2 cells"):
        readers.read_batch(spark, write(tmp_path / "w.csv", "a,b\n1,2\n1,2,3\n"))
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_batch(spark, write(tmp_path / "x.txt", "a"))


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä,b", float("nan"))], "id int, t string, x double")
    path = sinks.save_results(df, str(tmp_path), source="/in/my file.csv")
    assert os.path.basename(path).startswith("validation_results_my_file_") and open(path, "rb").read()[:3] == b"\xef\xbb\xbf"
    assert sinks.output_name(None, datetime(2025, 1, 2, 3, 4, 5)) == "validation_results_20250102_030405.csv"
    assert readers.result_path(spark, str(tmp_path), "../" + os.path.basename(path)) == path
    assert readers.result_path(spark, str(tmp_path), "no.csv") is None and readers.result_path(spark, str(tmp_path), "..") is None
    assert [r.name for r in readers.catalogue(spark, str(tmp_path)).collect()] == [os.path.basename(path)]
    import json

    got = json.load(open(sinks.respond(df, "json", str(tmp_path / "r.json"))))
    assert got == [{"id": 1, "t": "ä,b", "x": None, "Overall Score": 0, "Status": "Error", "Requirements Not Met": ""}]
    assert json.load(open(sinks.respond(df.limit(0), "json", str(tmp_path / "e.json")))) == []
    with pytest.raises(ValueError):
        sinks.respond(df, "pdf", str(tmp_path / "r"))


def test_one_file_by_executors_equals_a_driver_writer(spark, tmp_path, monkeypatch):
    """Bytes as Python's csv module writes them on one machine, from several ordered parts, some of them empty."""
    import csv
    import io
    from decimal import Decimal

    rows = [(i, f'a "{i}",\r\n b' if i % 3 else None, i / 7, i % 2 == 0, Decimal(i) / 4, datetime(2024, 1, 2, 3, 4, i % 60).date(), "ä漢🙂; x" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string, x double, b boolean, d decimal(10,2), day date, `odd, name` string").repartition(7)
    want = io.StringIO(newline="")
    csv.writer(want).writerow(df.columns)
    csv.writer(want).writerows([(*r[:4], Decimal(r[4]).quantize(Decimal("0.01")), *r[5:]) for r in rows])
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    for name in ("new.csv", "new.csv"):
        sinks.write_csv_bom(df.orderBy("id"), str(tmp_path / name))
    assert (tmp_path / "new.csv").read_bytes() == b"\xef\xbb\xbf" + want.getvalue().encode()
    assert os.listdir(tmp_path) == ["new.csv"]
    sinks.write_csv_bom(df.limit(0), str(tmp_path / "deep" / "none.csv"))
    assert (tmp_path / "deep" / "none.csv").read_bytes().startswith(b"\xef\xbb\xbfid,t,x,b,d,day,")
    import json

    got = json.load(open(sinks.respond(df.select("id", "t").orderBy("id"), "json", str(tmp_path / "r.json"))))
    assert [(r["id"], r["t"]) for r in got] == [r[:2] for r in rows]


def test_retention(spark, tmp_path):
    old, new = write(tmp_path / "old", "1"), write(tmp_path / "new", "2")
    os.utime(old, (1000, 1000))
    assert readers.expire(spark, str(tmp_path)) == 1 and os.listdir(tmp_path) == ["new"]
    assert readers.expire(spark, str(tmp_path), None) == 1 and not os.path.exists(new)
    assert readers.expire(spark, str(tmp_path / "none")) == 0


def png(pixels, kind=0):
    h, w = pixels.shape[:2]
    raw = b"".join(bytes([y % 5]) + filtered(pixels, y, y % 5) for y in range(h))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(pixels, y, how):
    flat = pixels.reshape(pixels.shape[0], -1).astype(int)
    n = flat.shape[1] // pixels.shape[1]
    line, up = flat[y], flat[y - 1] if y else np.zeros_like(flat[0])
    left, corner = np.r_[[0] * n, line[:-n]], np.r_[[0] * n, up[:-n]]
    p = left + up - corner
    near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    return ((line - [0 * line, left, up, (left + up) // 2, near][how]) % 256).astype(np.uint8).tobytes()


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (40, 50), dtype=np.uint8), rng.integers(0, 256, (33, 20, 3), dtype=np.uint8)
    assert (assets.decode(png(grey)) == grey).all()
    assert np.allclose(assets.decode(png(colour, 2)), colour @ np.array([0.299, 0.587, 0.114]))
    assert (assets.decode(b"P5\n# c\n50 40 255\n" + grey.tobytes()) == grey).all()
    small = assets.resized(grey.astype(float))
    want = [[sum(small[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
    bits = (np.array(want) > np.median(want)).ravel()
    assert assets.phash(grey) == f"{int(''.join(map(str, bits.astype(int))), 2):016x}" and np.isclose(small.mean(), grey.mean())
    tag = struct.pack("<HHII", 0x8825, 4, 1, 99) + struct.pack("<HHII", 0x010F, 2, 4, 0x00436241)
    jpeg = b"\xff\xd8\xff\xe1..Exif\0\0II*\0" + struct.pack("<IH", 8, 2) + tag
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "a.png", png(grey))
    write(tmp_path / "b.JPG", jpeg)
    write(tmp_path / "c.txt", "x")
    got = {r.path.rpartition("/")[2]: r for r in assets.image_features(readers.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.JPG"} and got["a.png"].phash == assets.phash(grey) and not got["a.png"].has_geotag
    assert got["b.JPG"].has_geotag and got["b.JPG"].exif == {"GPSInfo": "99", "Make": "AbC"} and got["b.JPG"].phash is None


def pdf(lines, title):
    body = b"BT /F1 12 Tf " + b" 0 -14 Td ".join(b"(%s) Tj" % line.encode("latin-1") for line in lines) + b" T* [(Sp) -300 (aced) 20 (<)] TJ <4142> Tj ET"
    packed = zlib.compress(body)
    return b"%PDF-1.4\n1 0 obj << /Title (" + title + b") /Author <4D65> >> endobj\n2 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream endobj\n%%EOF"


def test_pdf(spark):
    text, info = assets.plain_pdf(pdf(["Report \\(one\\)", "Caf\\351"], b"My \\134 title"))
    assert text == "Report (one)\nCafé\nSp aced<AB" and info == {"/Title": "My \\ title", "/Author": "Me"}
    files = spark.createDataFrame([("a", bytearray(pdf(["First line here", "x"], b""))), ("b", bytearray(b"no pdf")), ("c", None)], "path string, content binary")
    got = {r.path: (r.text.split("\n")[0], r.title) for r in assets.reports(files).collect()}
    assert got == {"a": ("First line here", "First line here"), "b": ("", None)}


def test_fetch(spark):
    def fetch(path):
        if "bad" in path:
            raise OSError("404")
        return path.encode()

    rows = spark.createDataFrame([("x",), ("x",), ("bad",), ("",), (None,)], "path string")
    assert {r.path: r.content and bytes(r.content) for r in assets.fetched(rows, fetch=fetch, tasks=2).collect()} == {"x": b"x", "bad": None}


@pytest.fixture
def quiet():
    """The root logger as it was: the command line sets handlers that write to the captured output."""
    root = logging.getLogger()
    level, handlers = root.level, root.handlers[:]
    yield
    root.handlers[:] = handlers
    root.setLevel(level)


def test_command_line(spark, tmp_path, capsys, quiet):
    """A batch with its own files: a report that is there, one that is not, a repeated photo, and a row without a title."""
    files = tmp_path / "container"
    (files / "photos").mkdir(parents=True)
    write(files / "r1.pdf", pdf(["Report of the keynote speaker", "20 people came"], b"T"))
    rng = np.random.default_rng(2)
    for name in "ab":
        write(files / "photos" / f"{name}.png", png(rng.integers(0, 256, (40, 40), dtype=np.uint8)))
    source = write(
        tmp_path / "in.csv",
        "id,activity_name,event_theme,activity_duration,student_participants,faculty_participants,event_driven,report,photo1,photo2,status\n"
        "9,One,Theme,3,20,2,1,r1.pdf,photos/a.png,0,old\n"
        "7,Two,Theme,4.5,1,2,1,none.pdf,photos/b.png,photos/a.png,old\n"
        "8,,Theme,9,30,2,1,r1.pdf,photos/b.png,0,old\n",
    )
    target = str(tmp_path / "out" / "r.csv")
    assert cli.main([source, "--output-csv", target, "--files", str(files), "--log-level", "ERROR"]) == 0
    import csv

    rows = list(csv.DictReader(open(target, encoding="utf-8-sig")))
    assert [r["id"] for r in rows] == ["9", "7", "8"] and {r["status"] for r in rows} == {"old"}
    assert [r["Status"] for r in rows][1:] == ["Reopen", "Error"] and rows[0]["Status"] in ("Accepted", "Rejected")
    assert "Image identical to submission 9 (SHA256 match)" in rows[1]["Requirements Not Met"]
    assert rows[2]["Requirements Not Met"] == "Processing error: 'float' object has no attribute 'strip'" and rows[2]["Overall Score"] == "0"
    assert "Expert details" not in rows[0]["Requirements Not Met"] and "total 3" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "no.csv"), "--non-interactive"]) == 1


def test_settings(monkeypatch):
    monkeypatch.setenv("RUBRICA_ENABLE_YEAR", "false")
    monkeypatch.setenv("RUBRICA_ACCEPTANCE_THRESHOLD", "70")
    assert EngineConfig.from_env() == EngineConfig(acceptance_threshold=70)


def streamed(spark, tmp_path, df, make, name, mode):
    df.write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streaming_budget(spark, tmp_path):
    rows = [("a", i, s) for i in range(3) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id string, idx int, step int").withColumn("ts", F.timestamp_seconds(1000 + F.col("idx"))).coalesce(1)
    got = streamed(spark, tmp_path, df, monitor.budget, "budget_out", "append").collect()
    assert {(r.idx, r.step): r.granted for r in got} == {(i, s): n < 5 for n, (_, i, s) in enumerate(rows)}
