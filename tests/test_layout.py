from pyspark.sql import functions as F

from quire.operators import glyphs, noise, outline, paragraphs, placement, tables
from quire.plans import documents

LINES = "doc_id long, page int, seq long, text string, y float, font_size float, is_bold boolean"
TEXT = "doc_id long, page int, seq long, text string"


def noisy(spark, pages, titles=None):
    rows = [(1, p, i, t) for i, (p, t) in enumerate(pages)]
    df = noise.flag_noise(spark.createDataFrame(rows, TEXT), titles)
    return sorted(r.seq for r in df.where("is_noise").collect())


def test_noise_patterns(spark):
    assert noisy(spark, [(1, "https://example.com/a")]) == [0]
    assert noisy(spark, [(1, " 2026/7/10 23:21 ")]) == [0]
    assert noisy(spark, [(1, "https://e.com/a 3/10")]) == [0]
    assert noisy(spark, [(1, "see https://e.com/a here")]) == []
    assert noisy(spark, [(1, "3/4")]) == []
    assert noisy(spark, [(1, "https://e.com"), (1, "body"), (1, "2026/1/1 1:02:03"), (1, "3/4")]) == [0, 2, 3]
    assert noisy(spark, [(1, "https://e.com"), (2, "3/4")]) == [0]


def test_running_titles(spark):
    body = [(p, f"text {p}") for p in range(1, 7)]
    assert noisy(spark, body + [(p, "Title") for p in range(1, 6)]) == [6, 7, 8, 9, 10]
    assert noisy(spark, [(p, f"b{p}") for p in range(1, 21)] + [(p, "Title") for p in range(1, 5)]) == []
    assert noisy(spark, [(1, "T"), (2, "T")]) == []
    assert noisy(spark, [(p, "x" * 61) for p in range(1, 6)]) == []
    assert noisy(spark, [(p, "😀" * 31) for p in range(1, 6)]) == []
    titles = noise.learned_titles(spark.createDataFrame([(1, p, p, "Title") for p in range(1, 6)], TEXT))
    assert noisy(spark, [(7, "Title"), (7, "body")], titles) == [0]


def lines(spark, rows):
    return spark.createDataFrame([(1, p, i, t, y, 12.0, False) for i, (p, y, t) in enumerate(rows)], LINES)


def test_runs_and_paragraphs(spark):
    ys = [452.83] * 4 + [484.03] * 3 + [589.66, 620.86, 652.06]
    got = paragraphs.paragraphs(lines(spark, [(1, y, f"w{i}") for i, y in enumerate(ys)])).orderBy("para_idx").collect()
    assert [r.text for r in got][-1].startswith("w7 w8") and got[0].text == "w0 w1 w2 w3 w4 w5 w6"
    drift = paragraphs.merge_runs(lines(spark, [(1, 10.0, "a"), (1, 10.008, "b"), (1, 10.016, "c")])).collect()
    assert sorted(r.text for r in drift) == ["a b", "c"]


def test_single_line_keeps_its_text(spark):
    assert paragraphs.paragraphs(lines(spark, [(1, 5.0, "手册（2025）")])).first().text == "手册（2025）"
    assert paragraphs.paragraphs(spark.createDataFrame([], LINES)).count() == 0


def test_footers_by_mode(spark):
    """The same pages: in document mode the footers part from the body, in page mode they stay in one paragraph."""
    rows = []
    for p in (1, 2, 3):
        y = [50, 65, 80, 95, 110, 310, 370, 430, 490]
        t = ["This", "is", "page", str(p), "body", "https://e.com/x", "2026/7/10 23:21", f"{p}/3", "Handbook"]
        rows += [(p, float(a), b) for a, b in zip(y, t)]
    kept = noise.clean(paragraphs.paragraphs(lines(spark, rows))).orderBy("page").collect()
    assert [r.text for r in kept] == [f"This is page {p} body" for p in (1, 2, 3)]
    assert paragraphs.paragraphs(lines(spark, rows), "page").count() == 6


def test_headings(spark):
    def flags(sizes, bold):
        rows = [(1, 1, i, 0.0, "t", s, b) for i, (s, b) in enumerate(zip(sizes, bold))]
        df = spark.createDataFrame(rows, "doc_id long, page int, para_idx int, top_y float, text string, font_size float, is_bold boolean")
        return [r.is_heading for r in paragraphs.headings(df).orderBy("para_idx").collect()]

    assert flags([24.0, 12.0, 12.0], [False] * 3) == [True, False, False]
    assert flags([12.0] * 3, [True, False, False]) == [True, False, False]
    assert flags([13.0, 12.0, 12.0], [False] * 3) == [False] * 3
    assert flags([13.8, 12.0, 12.0], [False] * 3) == [True, False, False]
    assert flags([12.0], [True]) == [True] and flags([12.0], [False]) == [False] and flags([0.0], [False]) == [False]


SEGMENTS = "doc_id long, page int, path_seq long, seg_seq int, x1 float, y1 float, x2 float, y2 float, painted boolean"


def region(spark, horizontals, verticals, extra=()):
    rows = [(1, 1, i, 0, 8.0, float(y), 634.0, float(y), True) for i, y in enumerate(horizontals)]
    rows += [(1, 1, 100 + i, 0, float(x), 79.0, float(x), 220.0, True) for i, x in enumerate(verticals)]
    rows += [(1, 1, 200 + i, 0, *map(float, s), True) for i, s in enumerate(extra)]
    pages = spark.createDataFrame([(1, 1, 700.0, 800.0)], "doc_id long, page int, width float, height float")
    found = tables.table_regions(spark.createDataFrame(rows, SEGMENTS), pages).collect()
    return [tuple(r)[2:] for r in found]


def test_table_regions(spark):
    box = [(8.0, 79.0, 634.0, 220.0)]
    assert region(spark, [79, 115, 151, 186, 220], [8, 200, 442, 634]) == box
    assert region(spark, [79, 80, 151, 152, 219, 220], [8, 9, 200, 201, 442, 634]) == box
    assert region(spark, [], []) == [] and region(spark, [79], [8]) == []
    assert region(spark, [79, 80, 81, 82], [8, 200, 442]) == []
    assert region(spark, [], [], [(0, 0, 100, 100), (10, 0, 110, 100), (5, 5, 7, 5)] * 3) == []
    assert region(spark, [500, 540, 580], [8, 200, 442]) == []


def test_segment_cap(spark):
    rows = [(1, 1, p, s, 0.0, 0.0, 50.0, 0.0, painted) for p, (n, painted) in enumerate([(3, True), (2, False), (3, True), (9, False), (1, True)]) for s in range(n)]
    df = spark.createDataFrame(rows, SEGMENTS)
    assert sorted(r.path_seq for r in tables.capped_segments(df, 12).collect()) == [0] * 3 + [2] * 3
    assert len(tables.capped_segments(df, 5).collect()) == 3
    assert len(tables.capped_segments(df, 20000).collect()) == 7


PARAS = "doc_id long, para_idx int, page int, top_y float"


def paras(spark, pages, ys=None):
    rows = [(1, i, p, float(y)) for i, (p, y) in enumerate(zip(pages, ys or [0] * len(pages)))]
    return spark.createDataFrame(rows, PARAS)


def test_image_placement(spark):
    def after(pages, page):
        return placement.place_by_page(spark.createDataFrame([(1, page, 0)], "doc_id long, page int, img_seq int"), paras(spark, pages)).first().after_idx

    assert (after([1, 1, 2, 2], 1), after([1, 1, 2, 2], 2), after([1, 2], 3), after([2, 2], 1), after([], 1)) == (1, 3, 1, -1, -1)


def test_region_placement(spark):
    def after(pages, ys, page, y):
        df = spark.createDataFrame([(1, page, y)], "doc_id long, page int, top_y float")
        return placement.place_regions(df, paras(spark, pages, ys)).first().after_idx

    assert after([1, 2, 2, 2], [50, 50, 80, 400], 2, 90.0) == 2
    assert after([1, 1, 2, 2], [50, 80, 300, 400], 2, 50.0) == 1
    assert after([1, 1], [50, 80], 1, 80.0) == 0


def test_outline_targets(spark):
    def target(pages, page, ys=None, y=None):
        entry = spark.createDataFrame([(1, 0, page, y)], "doc_id long, entry_seq int, page int, target_y float")
        return outline.to_paragraphs(entry, paras(spark, pages, ys)).first().para_idx

    assert (target([1, 1, 2, 2], 2), target([1, 1, 3, 3], 2), target([1, 2], 5), target([], 1)) == (2, 2, 1, None)
    assert target([1, 2, 2, 2, 3], 2, [50, 100, 300, 500, 50], 310.0) == 2
    assert target([1, 1, 3, 3], 2, [1, 2, 3, 4], 10.0) == 2
    assert target([1, 1], 1, [10, 20], 15.0) == 0
    images = spark.createDataFrame([(1, -1), (1, 0), (1, 2)], "doc_id long, after_idx int")
    at = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, para_idx int")
    assert sorted([r.block_idx for r in outline.to_blocks(at, images).collect()], key=str) == [3, None]


def test_outline_tree(spark):
    rows = [(1, 1, None, 0, "A", 1), (1, 2, 1, 0, None, 1), (1, 3, 1, 1, "lost", None), (1, 4, 3, 0, "kept", 2), (1, 5, None, 1, "B", 3)]
    nodes = spark.createDataFrame(rows, "doc_id long, id long, parent long, ord int, title string, page int")
    nodes = nodes.selectExpr("*", "if(id = 4, 'XYZ', 'Fit') AS dest_type", "700f AS top", "792f AS page_height")
    got = [(r.title, r.depth, r.target_y) for r in outline.flatten(nodes).orderBy("entry_seq").collect()]
    assert got == [("A", 0, None), ("", 1, None), ("kept", 2, 92.0), ("B", 0, None)]


def test_strips(spark):
    def strips(sizes):
        df = spark.createDataFrame([(1, 1, i, w, h) for i, (w, h) in enumerate(sizes)], "doc_id long, page int, img_seq int, width int, height int")
        return [(r.width, r.height) for r in placement.stitched_strips(df).collect()]

    assert strips([(125, 1078)] * 6 + [(19, 1078)]) == [(769, 1078)]
    assert strips([(125, 1078)] * 2) == [] and strips([(125, 1), (125, 2), (125, 1)]) == []
    assert strips([(125, 1), (120, 1), (19, 1)]) == [] and strips([(125, 1), (125, 1), (130, 1)]) == []


def test_glyphs(spark):
    rows = [(1, 1, 0, i, ch, 10.0 + i, 5.0 + i, 9.0 + i, None, "Foo-BOLD" if i else "Foo") for i, ch in enumerate("abc")]
    rows += [(1, 1, 1, 0, " ", 1.0, 1.0, 9.0, None, None), (1, 1, 2, 0, "z", 2.0, 0.0, 9.0, True, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, pos int, ch string, y float, x float, font_size float, force_bold boolean, font_name string")
    got = [(r.seq, r.text, r.y, r.font_size, r.is_bold) for r in glyphs.lines_of_glyphs(df).orderBy("seq").collect()]
    assert got == [(0, "z", 2.0, 9.0, True), (1, "abc", 10.0, 11.0, True)]


def test_page_blocks(spark):
    text = lines(spark, [(1, 100.0, "above"), (1, 115.0, "the"), (1, 130.0, "table"), (1, 400.0, "inside"), (1, 760.0, "below"), (2, 10.0, "hidden"), (3, 10.0, "plain")])
    rows = [(1, 1, i, 0, 8.0, float(y), 600.0, float(y), True) for i, y in enumerate([300, 400, 500])]
    rows += [(1, 1, 9 + i, 0, float(x), 300.0, float(x), 500.0, True) for i, x in enumerate([8, 300, 600])]
    pages = spark.createDataFrame([(1, p, 700.0, 800.0) for p in (1, 2, 3)], "doc_id long, page int, width float, height float")
    images = spark.createDataFrame([(1, 1, 0, 5.0, 5.0), (1, 2, 0, 700.0, 800.0), (1, 3, 0, 5.0, 5.0)], "doc_id long, page int, img_seq int, a float, d float")
    images = images.select("doc_id", "page", "img_seq", F.struct("a", "d").alias("ctm"))
    got = documents.page_blocks(text, spark.createDataFrame(rows, SEGMENTS), images, pages).orderBy("page", "block_idx").collect()
    assert [(r.page, r.block_idx, r.kind, r.text or r.image_ref) for r in got] == [
        (1, 0, "text", "above the table"), (1, 1, "image", "table"), (1, 2, "text", "below"), (2, 0, "image", "0"), (3, 0, "text", "plain"), (3, 1, "image", "0"),
    ]
    one = documents.page_blocks(text, spark.createDataFrame(rows, SEGMENTS), images, pages, page=3)
    assert one.count() == 2
