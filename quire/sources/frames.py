"""Layout frames for the test tables.

The tables hold no page layout, so these frames derive one from their columns by whole-number arithmetic. They
exercise operators; they are no evidence of quality on real documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_blank


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, seq, text, y): a source is a document, its documents are pages, and pairs of lines share a height."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    lines = docs.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return lines.where(~is_blank(F.col("text"))).withColumn("y", F.expr("72 + 14 * (seq div 2) + 20 * (seq div 8)").cast("float"))


def styled_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_frame(spark, sf_dir)
    size = F.when(F.col("seq") % 9 == 0, 16).otherwise(12).cast("float")
    return lines.withColumn("font_size", size).withColumn("is_bold", (F.col("page") + F.col("seq")) % 13 == 0)


def noise_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a running title, dates, URLs and page counters put in."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    page = F.col("page")

    def injected(seq: int, text, where=None):
        one = F.array(F.struct(F.lit(seq).alias("seq"), text.alias("text"), F.lit(True).alias("put_in")))
        return one if where is None else F.when(where, one).otherwise(F.filter(one, lambda _: F.lit(False)))

    own = F.transform(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")), lambda t, i: F.struct(i.alias("seq"), t.alias("text"), F.lit(False).alias("put_in")))
    rows = F.concat(
        own,
        injected(-4, F.concat(F.lit("Handbook "), F.col("doc_id"))),
        injected(-3, F.lit("2026/7/10 23:21"), page % 3 != 0),
        injected(900001, F.concat(F.lit("https://example.com/"), F.col("doc_id")), page % 3 == 1),
        injected(900002, F.concat((page % 50 + 1).cast("string"), F.lit("/50"))),
    )
    flat = docs.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", "r.*")
    return flat.where(F.col("put_in") | ~is_blank(F.col("text"))).drop("put_in")


def cjk_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_frame(spark, sf_dir)
    text = F.regexp_replace(F.translate("text", "aeiou", "中文测试页"), "[^A-Za-z0-9À-ɏ 中文测试页]", "")
    return lines.select("doc_id", "page", "seq", text.alias("text"))


def segment_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments per row of lineitem: a horizontal and a vertical one; orders are pages of one document."""
    order = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    items = read(spark, sf_dir, "lineitem").withColumn("path_seq", F.expr(f"row_number() OVER ({order})"))
    across = items.selectExpr(
        "1L AS doc_id", "l_orderkey AS page", "path_seq", "0 AS seg_seq", "50f AS x1",
        "float(100 + 30 * l_linenumber + if(l_partkey % 10 = 0, 2000, 0)) AS y1",
        "float(if(l_suppkey % 7 = 0, 60, 550)) AS x2",
        "float(100 + 30 * l_linenumber + if(l_partkey % 10 = 0, 2000, 0)) AS y2", "true AS painted",
    )
    down = items.selectExpr(
        "1L AS doc_id", "l_orderkey AS page", "path_seq", "1 AS seg_seq", "float(50 + 80 * l_linenumber) AS x1", "110f AS y1",
        "float(50 + 80 * l_linenumber) AS x2", "400f AS y2", "true AS painted",
    )
    return across.unionByName(down)


def document_segments(pages: DataFrame) -> DataFrame:
    """A grid of three lines each way from 100 to 200 points below the top of every seventh page."""
    lines = [(50, 100, 550, 100), (50, 150, 550, 150), (50, 200, 550, 200), (50, 100, 50, 200), (300, 100, 300, 200), (550, 100, 550, 200)]
    segments = [
        F.struct(
            F.lit(i).cast("long").alias("path_seq"), F.lit(0).alias("seg_seq"), F.lit(x1).cast("float").alias("x1"), (F.col("height") - y1).cast("float").alias("y1"),
            F.lit(x2).cast("float").alias("x2"), (F.col("height") - y2).cast("float").alias("y2"), F.lit(True).alias("painted"),
        )
        for i, (x1, y1, x2, y2) in enumerate(lines)
    ]
    return pages.where("page % 7 = 0").select("doc_id", "page", F.explode(F.array(*segments)).alias("s")).select("doc_id", "page", "s.*")


def path_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path operations of one document, four parts a page: a rectangle, lines and a curve, ended in four ways."""
    ops = """array(
      struct('move', float(p_size), float(10), 0f, 0f), struct('line', float(p_size + 100), float(10), 0f, 0f),
      struct('curve', float(p_size + 100), float(200), 0f, 0f), struct('line', float(p_size), float(200), 0f, 0f), struct('close', 0f, 0f, 0f, 0f),
      struct(element_at(array('stroke', 'fill', 'discard', 'both'), int(p_partkey % 4) + 1), 0f, 0f, 0f, 0f),
      struct('rect', float(p_partkey % 100), float(p_size), 30f, 20f), struct('line', 7f, 8f, 0f, 0f),
      struct(if(p_partkey % 3 = 0, 'curve', 'stroke'), 1f, 2f, 0f, 0f))"""
    rows = read(spark, sf_dir, "part").selectExpr("1L AS doc_id", "p_partkey div 4 AS page", "p_partkey", f"posexplode({ops}) AS (k, o)")
    return rows.selectExpr("doc_id", "page", "p_partkey * 10 + k AS op_seq", "o.col1 AS op", "o.col2 AS x", "o.col3 AS y", "o.col4 AS w", "o.col5 AS h")


def glyph_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of one document: a part's name is a line, twenty to a page; every thirteenth line is blank."""
    parts = read(spark, sf_dir, "part").selectExpr("1L AS doc_id", "p_partkey div 20 AS page", "p_partkey AS line", "if(p_partkey % 13 = 0, '  ', p_name) AS name")
    glyphs = parts.select("doc_id", "page", "line", F.posexplode(F.split("name", "")).alias("pos", "ch"))
    return glyphs.selectExpr(
        "doc_id", "page", "line", "pos", "ch", "float(line * 37 % 100 + pos) AS y", "float(line % 3 * 100 + pos * 6) AS x", "float(8 + pos % 5) AS font_size",
        "case line % 11 when 0 then true when 1 then cast(null AS boolean) else false end AS force_bold", "if((line + pos) % 3 < line % 3, 'Foo-BoldOblique', 'Foo') AS font_name",
    )


def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("1L AS doc_id", "l_orderkey AS page").distinct().selectExpr("*", "612f AS width", "792f AS height")


def table_line_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per row of lineitem, spread down the order's page."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "1L AS doc_id", "l_orderkey AS page", "l_partkey AS seq", "concat('part ', l_partkey) AS text", "float(l_partkey % 792) AS y"
    )


def image_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as image strips."""
    last = "max(turn) OVER (PARTITION BY conv_id)"
    return read(spark, sf_dir, "conversations").selectExpr(
        "1L AS doc_id", "conv_id AS page", "turn AS img_seq", f"if(turn = {last}, 19, 125) AS width",
        "int(1078 + if(conv_id % 5 = 0, turn % 2, 0)) AS height",
        "named_struct('a', float(if(conv_id % 3 = 0, 500, 100)), 'b', 0f, 'c', 0f, 'd', float(if(conv_id % 3 = 0, 700, 100))) AS ctm",
    )


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations below; some targets have no height, and region 3 cannot be resolved."""
    regions = read(spark, sf_dir, "region").selectExpr(
        "1L AS doc_id", "cast(r_regionkey AS long) AS id", "cast(null AS long) AS parent", "r_regionkey AS ord", "r_name AS title",
        "if(r_regionkey = 3, null, r_regionkey * 7 + 1) AS page", "'Fit' AS dest_type", "0f AS top", "792f AS page_height",
    )
    nations = read(spark, sf_dir, "nation").selectExpr(
        "1L AS doc_id", "cast(100 + n_nationkey AS long) AS id", "cast(n_regionkey AS long) AS parent", "n_nationkey AS ord", "n_name AS title",
        "n_nationkey + 1 AS page", "if(n_nationkey % 3 = 0, 'Fit', 'XYZ') AS dest_type", "float(692 - 10 * n_nationkey) AS top", "792f AS page_height",
    )
    return regions.unionByName(nations)


def part_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of one document: parts in key order, a page for every seven."""
    return read(spark, sf_dir, "part").selectExpr(
        "1L AS doc_id", "int(p_partkey) AS para_idx", "int(p_partkey div 7) AS page", "float((p_partkey % 7) * 90 + p_size) AS top_y"
    )
