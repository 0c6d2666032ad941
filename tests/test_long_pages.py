"""Pages of many lines, drifting heights, path operations, strips of pixels."""

import random
import time

from pyspark.sql import functions as F

from quire.functions import reflow, text
from quire.operators import paragraphs, placement, tables

LINES = "doc_id long, page int, seq long, text string, y float, font_size float, is_bold boolean"


def folded(ys):
    """Runs of rows at the height of their first row, one row after another."""
    runs = []
    for i, y in enumerate(ys):
        if runs and y is not None and ys[runs[-1][0]] is not None and abs(y - ys[runs[-1][0]]) < 0.01:
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def test_runs_against_a_plain_fold(spark):
    rng = random.Random(6)
    for _ in range(4):
        ys = []
        for _ in range(150):
            # heights in 256ths, which 32-bit floats hold exactly
            step = rng.choice([0.0, 1 / 256, 2 / 256, 3 / 256, -1 / 256, 8 / 256, 14.0])
            ys.append(None if rng.random() < 0.03 else (next((y for y in reversed(ys) if y is not None), 50.0) + step))
        rows = [(1, 1, i, f"w{i}", y, 12.0, False) for i, y in enumerate(ys)]
        got = sorted((r.seq, r.text) for r in paragraphs.merge_runs(spark.createDataFrame(rows, LINES)).collect())
        assert got == [(run[0], " ".join(f"w{i}" for i in run)) for run in folded(ys)]


def test_a_page_of_many_lines(spark):
    rows = [(1, 1, i, f"line {i}" if i % 3 else f"行{i}", float(14 * (i // 2)), 12.0, False) for i in range(20_000)]
    began = time.perf_counter()
    found = paragraphs.paragraphs(spark.createDataFrame(rows, LINES), "page").collect()
    assert len(found) == 1 and found[0].text.startswith("行 0 line 1 line 2 行 3") and time.perf_counter() - began < 60


def test_seams_against_a_plain_join(spark):
    def plain(lines):
        cjk = lambda c: bool(c) and "一" <= c <= "鿿"
        joined = ""
        for x in lines:
            tight = not joined or not x or cjk(joined[-1:]) or cjk(x[:1])
            joined += x if tight else " " + x
        return joined

    rng = random.Random(7)
    rows = [(i, ["".join(rng.choice("ab中文- ") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(7))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, p array<string>")
    assert {r.i: r.v for r in df.select("i", text.join_lines(F.col("p")).alias("v")).collect()} == {i: plain(p) for i, p in rows}


def test_ideographic_space_is_a_token_of_its_own(spark):
    df = spark.createDataFrame([("a 　 b",)], "t string")
    assert df.select(text.tokens(F.col("t")).alias("v")).first().v == ["a", " ", "　", " ", "b"]
    assert reflow.Wrapper(2, 1.0, 0.5).wrap("a 　b") == ["a", "b"]


def test_a_cut_word_fills_lines(spark):
    """As many characters as the sum of widths allows, though the first look at the room took one less."""
    line = reflow.Wrapper(10, 0.3, 0.7).wrap("中 x, abcd中x , ab中" + "z" * 65)
    assert line[0].endswith("ab中zzzz") and "".join(line).count("z") == 65


OPS = "doc_id long, page int, op_seq int, op string, x float, y float, w float, h float"


def test_path_segments(spark):
    ops = [
        ("line", 5, 0), ("move", 1, 1), ("line", 4, 1), ("curve", 4, 9), ("line", 2, 9), ("close", 0, 0), ("stroke", 0, 0),
        ("rect", 10, 20, 3, 2), ("line", 0, 0), ("discard", 0, 0), ("line", 7, 7), ("fill", 0, 0), ("rect", 1, 1, 1, 1),
    ]
    rows = [(1, 1, i, o[0], float(o[1]), float(o[2]), *(map(float, o[3:]) if len(o) > 3 else (None, None))) for i, o in enumerate(ops)]
    got = tables.path_segments(spark.createDataFrame(rows, OPS)).orderBy("path_seq", "seg_seq").collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, 0, 0, 0, 5, 0, True), (1, 1, 1, 1, 4, 1, True), (1, 2, 4, 9, 2, 9, True), (1, 3, 2, 9, 1, 1, True),
        (2, 0, 10, 20, 13, 20, False), (2, 1, 13, 20, 13, 22, False), (2, 2, 13, 22, 10, 22, False), (2, 3, 10, 22, 10, 20, False), (2, 4, 10, 20, 0, 0, False),
        (3, 0, 0, 0, 7, 7, True), (4, 0, 1, 1, 2, 1, False), (4, 1, 2, 1, 2, 2, False), (4, 2, 2, 2, 1, 2, False), (4, 3, 1, 2, 1, 1, False),
    ]
    assert tables.path_segments(spark.createDataFrame([], OPS)).count() == 0


def test_pixels_of_strips(spark):
    import numpy as np

    whole = np.arange(2 * 7 * 3, dtype=np.uint8).reshape(2, 7, 3)
    rows = [(1, 1, i, w, 2, bytearray(whole[:, a : a + w].tobytes())) for i, (a, w) in enumerate([(0, 3), (3, 3), (6, 1)])]
    rows += [(1, 2, i, 3, 2, bytearray(b"x" * (18 - i))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page int, img_seq int, width int, height int, pixels binary")
    got = {r.page: r for r in placement.stitched_pixels(df).collect()}
    assert bytes(got[1].pixels) == whole.tobytes() and got[1].width == 7 and got[2].pixels is None


def test_region_between_pages(spark):
    paras = spark.createDataFrame([(1, 0, 1, 50.0), (1, 1, 1, 90.0), (1, 2, 3, 10.0)], "doc_id long, para_idx int, page int, top_y float")
    marks = spark.createDataFrame([(1, 2, 5.0), (1, 3, 10.0), (1, 3, 11.0), (1, 0, 9.0), (2, 1, 9.0)], "doc_id long, page int, top_y float")
    got = {(r.doc_id, r.page, r.top_y): r.after_idx for r in placement.place_regions(marks, paras).collect()}
    assert got == {(1, 2, 5.0): 1, (1, 3, 10.0): 1, (1, 3, 11.0): 2, (1, 0, 9.0): -1, (2, 1, 9.0): -1}
