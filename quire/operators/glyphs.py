"""Glyphs to lines, for sources that give single glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_blank


def is_bold_glyph(force_bold: Column, font_name: Column) -> Column:
    return F.coalesce(force_bold, F.lit(False)) | F.coalesce(F.lower(font_name).contains("bold"), F.lit(False))


def lines_of_glyphs(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text, y, font_size, is_bold) from glyphs (doc_id, page, line, pos, ch, y, font_size, force_bold, font_name).

    A line is at its first glyph's height, has its largest size, and is bold if more than half of its glyphs are.
    Blank lines are dropped; lines are numbered in visual order.
    """
    bold = is_bold_glyph(F.col("force_bold"), F.col("font_name"))
    rows = glyphs.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s.ch), "").alias("text"),
        F.min_by("y", "pos").alias("y"),
        F.min_by("x", "pos").alias("x"),
        F.max("font_size").alias("font_size"),
        (F.count_if(bold) * 2 > F.count(F.lit(1))).alias("is_bold"),
    )
    return visual_order(rows.where(~is_blank(F.col("text")))).select("doc_id", "page", "seq", "text", "y", "font_size", "is_bold")


def visual_order(rows: DataFrame) -> DataFrame:
    """Adds seq: top to bottom, left to right within a page."""
    page = Window.partitionBy("doc_id", "page").orderBy("y", "x", "line")
    return rows.withColumn("seq", (F.row_number().over(page) - 1).cast("long"))
