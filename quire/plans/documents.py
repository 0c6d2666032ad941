"""Whole plans: a document's paragraphs and images, or the display blocks of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import noise, paragraphs, placement, tables
from quire.plans.stage import cut

_PAGE = ["doc_id", "page"]


def extract_document(lines: DataFrame, segments: DataFrame, images: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document mode: (paragraphs, images). Table text is cut, gaps are judged over the document, noise is dropped and the
    rest renumbered; inline images come before table images and both carry after_idx."""
    regions = cut(tables.table_regions(segments, pages))
    paras = cut(paragraphs.paragraphs(tables.outside_tables(lines, regions, pages), "document"))
    kept = cut(_renumber(noise.clean(paras), ["doc_id"]))
    inline = placement.place_by_page(placement.without_table_pages(images.select(*_PAGE, "img_seq"), regions), kept)
    tops = regions.join(pages.select(*_PAGE, "height"), _PAGE).select(*_PAGE, (F.col("height") - F.col("max_y")).alias("top_y"))
    placed = placement.place_regions(tops, kept)
    both = inline.select(*_PAGE, F.lit(0).alias("kind"), "img_seq", "after_idx").unionByName(
        placed.select(*_PAGE, F.lit(1).alias("kind"), F.lit(0).cast(images.schema["img_seq"].dataType).alias("img_seq"), "after_idx")
    )
    return kept, both


def page_blocks(lines: DataFrame, segments: DataFrame, images: DataFrame, pages: DataFrame, page: int | None = None) -> DataFrame:
    """Page mode: display blocks of every page, or of one. Titles are learned from raw lines of the first pages; headings
    are judged before noise is dropped."""
    titles = noise.learned_titles(lines)
    if page is not None:
        lines, segments, images, pages = (d.where(F.col("page") == page) for d in (lines, segments, images, pages))
    regions = cut(tables.table_regions(segments, pages))
    paras = paragraphs.headings(paragraphs.paragraphs(tables.outside_tables(lines, regions, pages), "page"))
    kept = cut(_renumber(noise.clean(cut(paras), titles), _PAGE))
    tops = regions.join(pages.select(*_PAGE, "height"), _PAGE).select(*_PAGE, (F.col("height") - F.col("max_y")).alias("top_y"))
    # within a page, only its own paragraphs count
    own = ["p_doc", "p_page"]
    scoped = kept.select(F.concat_ws("\0", *_PAGE).alias("doc_id"), "page", "top_y", "para_idx")
    marks = tops.select(F.concat_ws("\0", *_PAGE).alias("doc_id"), "page", "top_y", F.col("doc_id").alias(own[0]))
    table_images = placement.place_regions(marks, scoped).select(F.col(own[0]).alias("doc_id"), "page", "after_idx")
    full = placement.full_page_images(images, pages).where("has_full_page_image").select(*_PAGE)
    return placement.blocks(kept, table_images, images, full)


def _renumber(paras: DataFrame, scope: list[str]) -> DataFrame:
    """para_idx without the gaps that dropped rows left; counted page by page, then added up over the pages."""
    from pyspark.sql import Window

    local = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("para_idx")) - 1
    numbered = paras.withColumn("_local", local)
    if scope == _PAGE:
        return numbered.withColumn("para_idx", F.col("_local").cast("int")).drop("_local")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = paras.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("n")).select(*_PAGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(offsets, _PAGE).withColumn("para_idx", (F.col("_before") + F.col("_local")).cast("int")).drop("_local", "_before")
