import random

import numpy as np
from pyspark.sql import functions as F

from quire.functions import binary, geometry
from quire.operators import store


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_jpeg_counts(spark):
    sof = bytes.fromhex("FFD8FFC0001108000100010300")
    assert binary.jpeg_component_count(sof) == 3
    for bad in (None, b"", b"\x00\x01\x02\x03", b"\xff\xd8", sof[:9], bytes.fromhex("FFD8FFD9"), bytes.fromhex("FFD8FFE00001"), bytes.fromhex("FFD8AA00")):
        assert binary.jpeg_component_count(bad) is None
    assert binary.jpeg_component_count(bytes.fromhex("FFD8FFD0FF01FFE00003AAFFC20011080001000104")) == 4
    df = spark.createDataFrame([(bytearray(sof),), (None,)], "d binary")
    assert [r.v for r in df.select(binary.jpeg_components(F.col("d")).alias("v")).collect()] == [3, None]


def rgb(spark, data, w, h, bits, reported):
    col = binary.raw_pixels(F.lit(bytearray(data)), *(F.lit(x) for x in (w, h, bits, reported)))
    found = one(spark, col)
    return None if found is None else list(found)


def test_raw_decode(spark):
    assert rgb(spark, b"\xf0\x80\xf0", 2, 1, 4, 3) == [255, 0, 136, 0, 255, 0]
    assert rgb(spark, b"\xf0", 2, 1, 4, 3) == [255, 255, 255, 0, 0, 0]
    assert rgb(spark, b"\xf0\x80", 2, 1, 4, 3) is None and rgb(spark, b"", 0, 1, 4, 1) is None and rgb(spark, b"\x00", 1, 1, 17, 1) is None


def test_raw_decode_against_bit_reader():
    rng = random.Random(4)
    for _ in range(100):
        w, h, bits, n = rng.randrange(1, 6), rng.randrange(1, 4), rng.randrange(1, 17), rng.choice((1, 3))
        per_row = (w * n * bits + 7) // 8
        data = rng.randbytes(per_row * h)
        got = binary.decode_samples(data, w, h, bits, n)
        for y in range(h):
            row = int.from_bytes(data[y * per_row : (y + 1) * per_row], "big")
            for x in range(w):
                for c in range(n):
                    at = (x * n + c) * bits
                    value = row >> (per_row * 8 - at - bits) & ((1 << bits) - 1)
                    assert got[y, x, c] == value * 255 // ((1 << bits) - 1)


def test_orientation(spark):
    def matrix(*ctm):
        m = one(spark, geometry.orientation(*(F.lit(float(x)) for x in ctm), F.lit(4), F.lit(8)))
        return m and (m.m00, m.m01, m.m10, m.m11)

    assert matrix(100, 0, 0, 100) is None and matrix(0, 0, 0, 0) is None and matrix(70, 70, -70, 70) is None
    assert matrix(-100, 0, 0, 100) == (-1, 0, 0, 1) and matrix(100, 0, 0, -100) == (1, 0, 0, -1) and matrix(100, 1e-6, 0, -100) == (1, 0, 0, -1)
    m = matrix(0, 100, -100, 0)
    assert (m[1], m[2]) == (1, -1)


def test_oriented_pixels(spark):
    image = np.arange(4 * 2 * 3, dtype=np.uint8).reshape(2, 4, 3)

    def turned(*ctm):
        m = geometry.orientation(*(F.lit(float(x)) for x in ctm), F.lit(4), F.lit(2))
        return bytes(one(spark, binary.oriented_pixels(F.lit(bytearray(image.tobytes())), F.lit(4), F.lit(2), m)))

    assert turned(1, 0, 0, 1) == image.tobytes()
    assert turned(-1, 0, 0, 1) == image[:, ::-1].tobytes() and turned(1, 0, 0, -1) == image[::-1].tobytes()
    assert turned(0, 1, -1, 0) == np.rot90(image, 1).tobytes() or turned(0, 1, -1, 0) == np.rot90(image, -1).tobytes()


def test_geometry(spark):
    sizes = [(1200, 800, 1), (2000, 1500, 1), (2001, 1000, 2), (8000, 6000, 4), (6000, 8000, 4), (64000, 1000, 32)]
    assert [one(spark, geometry.subsampling(F.lit(w), F.lit(h))) for w, h, _ in sizes] == [f for _, _, f in sizes]
    r = one(spark, geometry.crop_rect(*(F.lit(float(x)) for x in (100, 200, 300, 400, 800, 72)), F.lit(600), F.lit(800)))
    assert tuple(r) == (94, 394, 306, 606)
    band = [one(spark, geometry.in_table_band(F.lit(float(y)), F.lit(200.0), F.lit(400.0), F.lit(800.0))) for y in (394, 606, 500, 393, 607, 0, 800)]
    assert band == [True] * 3 + [False] * 4
    inside = [(50, 100, 200, 100), (50, -4284, 200, 100), (50, 100, 50, 900), (-0.5, 10, 612.5, 10)]
    assert [one(spark, geometry.on_page(*(F.lit(float(x)) for x in s), F.lit(612.0), F.lit(792.0))) for s in inside] == [True, False, False, True]
    full = [one(spark, geometry.is_full_page(F.lit(float(w)), F.lit(float(h)), F.lit(200.0), F.lit(300.0))) for w, h in ((200, 300), (40, 30))]
    assert full == [True, False] and one(spark, geometry.is_full_page(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))) is False
    assert one(spark, geometry.scrubber_page(F.lit(0.5), F.lit(4))) == 3 and one(spark, geometry.scrubber_page(F.lit(7.0), F.lit(4))) == 4
    assert one(spark, geometry.progress_of_spacing(F.lit(9.9))) == 10


def test_settings(spark):
    df = spark.createDataFrame([(5, 0.3, -10, -10), (999, 9.9, 500, 500), (20, None, None, None)], "font_size int, line_spacing float, padding int, block_spacing int")
    got = [tuple(round(x, 3) for x in r) for r in store.clamp_settings(df).collect()]
    assert got == [(12, 1.0, 8, 0), (32, 2.0, 32, 32), (20, 1.2, 16, 12)]


def test_progress(spark):
    stored = spark.createDataFrame([("a", 42), ("d", 7)], "file_key string, page int")
    updates = spark.createDataFrame([("b", 1, 1), ("b", 99, 2), ("c", 0, 1), ("d", 8, 0)], "file_key string, page int, ts long")
    after = store.upsert_progress(stored, updates)
    assert {r.file_key: r.page for r in after.collect()} == {"a": 42, "b": 99, "c": 1, "d": 8}
    files = spark.createDataFrame([("a",), ("none",)], "file_key string")
    assert {r.file_key: r.page for r in store.read_progress(files, after).collect()} == {"a": 42, "none": None}


def test_states_and_keys(spark):
    df = spark.createDataFrame([(3, None, False), (0, None, False), (None, " ", True), (None, "bad", True)], "n int, e string, f boolean")
    got = [tuple(r.s) for r in df.select(store.load_state(F.col("n"), F.col("e"), F.col("f")).alias("s")).collect()]
    assert got == [("success", 3, None), ("error", None, store.EMPTY_MESSAGE), ("error", None, store.ERROR_MESSAGE), ("error", None, "bad")]
    assert one(spark, store.content_key(F.lit(bytearray(b"abc")))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, store.view_uri(F.lit("VIEW"), F.lit("u"))) == "u" and one(spark, store.view_uri(F.lit("EDIT"), F.lit("u"))) is None


def test_files(spark, tmp_path):
    from quire.sources import files

    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = files.binary_files(spark, str(tmp_path), "*.pdf").collect()
    assert [(r.length, r.file_key[:8], bytes(r.content)) for r in rows] == [(3, "ba7816bf", b"abc")]
    df = spark.createDataFrame([(1, 3), (2, None)], "i int, n int")
    assert [r.status for r in files.failed_rows(df, "n").orderBy("i").collect()] == ["ok", "failed"]


def test_decode_route(spark):
    def route(bits, suffix, factor, n):
        return one(spark, binary.decode_route(F.lit(bits), F.lit(suffix), F.lit(factor), F.lit(n).cast("int")))

    assert [route(4, "jpg", 2, 3), route(8, "jpg", 2, 3), route(8, "jpg", 2, 4), route(8, "jpg", 1, 3), route(8, "png", 2, 3), route(8, "jpg", 2, None)] == [
        "raw", "subsampled", "library", "library", "library", "library"
    ]
