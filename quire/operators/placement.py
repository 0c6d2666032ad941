"""Where images, table regions and outline targets go among paragraphs: as-of and nearest joins.

As-of joins are unions with a running maximum or minimum, one window per document, so they cost a sort and not a
product of both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import is_full_page

_PAGE = ["doc_id", "page"]
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def place_by_page(images: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds after_idx to images: the last paragraph on their page or an earlier one, -1 without any."""
    last = paras.groupBy(*_PAGE).agg(F.max("para_idx").alias("last_idx"))
    pages = images.select(*_PAGE).distinct().withColumn("last_idx", F.lit(None).cast("int"))
    both = last.unionByName(pages)
    order = Window.partitionBy("doc_id").orderBy("page").rangeBetween(*_UPTO)
    found = both.withColumn("after_idx", F.coalesce(F.max("last_idx").over(order), F.lit(-1))).select(*_PAGE, "after_idx").distinct()
    return images.join(found, _PAGE)


def place_regions(regions: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds after_idx to regions (doc_id, page, top_y): the last paragraph that starts before them, -1 without any.

    Paragraphs of the region's own page are compared by height, within that page; of earlier pages only the last
    paragraph counts, one row a page.
    """
    none = F.lit(None).cast("int")
    marks = regions.select(*_PAGE, F.col("top_y").cast("double").alias("_y")).distinct()
    texts = paras.select(*_PAGE, F.col("top_y").cast("double").alias("_y"), F.lit(1).alias("kind"), F.col("para_idx").cast("int").alias("idx"))
    # a region sorts before paragraphs at its own height, which do not start before it
    height = Window.partitionBy(*_PAGE).orderBy("_y", "kind").rowsBetween(*_UPTO)
    both = texts.unionByName(marks.select(*_PAGE, "_y", F.lit(0).alias("kind"), none.alias("idx"))).withColumn("own_idx", F.max("idx").over(height))
    own = both.where("kind = 0").select(*_PAGE, "_y", "own_idx")
    pages = paras.groupBy(*_PAGE).agg(F.max("para_idx").cast("int").alias("idx")).unionByName(marks.select(*_PAGE).distinct().select(*_PAGE, none.alias("idx")))
    before = Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    # RANGE needs a number: pages are whole
    earlier = pages.withColumn("earlier_idx", F.max("idx").over(before)).groupBy(*_PAGE).agg(F.max("earlier_idx").alias("earlier_idx"))
    found = own.join(earlier, _PAGE).select(*_PAGE, "_y", F.coalesce(F.greatest("own_idx", "earlier_idx"), F.lit(-1)).alias("after_idx"))
    return regions.withColumn("_y", F.col("top_y").cast("double")).join(found, [*_PAGE, "_y"]).drop("_y")


def without_table_pages(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images that are not on a page with a table."""
    return images.join(regions.select(*_PAGE), _PAGE, "left_anti")


def full_page_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, has_image, has_full_page_image) of pages with images."""
    joined = images.join(pages.select(*_PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), _PAGE)
    full = is_full_page(F.col("ctm.a"), F.col("ctm.d"), F.col("pw"), F.col("ph"))
    return joined.groupBy(*_PAGE).agg(F.lit(True).alias("has_image"), F.max(full).alias("has_full_page_image"))


def stitched_strips(images: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, n_strips) of pages whose images are strips of one: three or more of one height,
    all but the last of one width and the last no wider."""
    order = Window.partitionBy(*_PAGE).orderBy("img_seq")
    last = F.row_number().over(Window.partitionBy(*_PAGE).orderBy(F.desc("img_seq"))) == 1
    marked = images.select(*_PAGE, "img_seq", "width", "height").withColumn("is_last", last).withColumn("first_width", F.first("width").over(order))
    pages = marked.groupBy(*_PAGE).agg(
        F.count(F.lit(1)).alias("n_strips"),
        F.min("height").alias("height"),
        F.max("height").alias("_h"),
        F.sum("width").alias("total"),
        F.min(F.when(~F.col("is_last"), F.col("width") == F.col("first_width")).otherwise(F.col("width") <= F.col("first_width"))).alias("even"),
    )
    good = pages.where((F.col("n_strips") >= 3) & (F.col("height") == F.col("_h")) & F.col("even"))
    return good.select(*_PAGE, F.col("total").alias("width"), "height", "n_strips")


def stitched_pixels(images: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, pixels) of the pages that ``stitched_strips`` finds: RGB bytes of the strips side by side.

    ``images`` also has ``pixels``, row by row; a strip whose bytes do not fit its size makes the page's pixels null.
    """
    pages = stitched_strips(images)
    strips = images.select(*_PAGE, F.struct("img_seq", F.col("width").alias("w"), "pixels").alias("strip")).join(pages, _PAGE)
    held = strips.groupBy(*_PAGE, "width", "height").agg(F.array_sort(F.collect_list("strip")).alias("strips"))
    whole = F.forall("strips", lambda s: F.coalesce(F.octet_length(s.pixels) == s.w * F.col("height") * 3, F.lit(False)))

    def row(y: Column) -> Column:
        parts = F.transform("strips", lambda s: F.hex(F.substring(s.pixels, y * s.w * 3 + 1, s.w * 3)))
        return F.array_join(parts, "")

    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), row)
    return held.select(*_PAGE, "width", "height", F.when(whole, F.unhex(F.array_join(rows, ""))).alias("pixels"))


def blocks(texts: DataFrame, table_images: DataFrame, images: DataFrame, full_pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, block_idx, kind, text, is_heading, image_ref) in reading order of each page.

    A table's image comes after its paragraph (-1: first). Images come last, and not on pages with a table. Texts of
    pages with a full-page image (``full_pages``: doc_id, page) are left out unless the page has a table.
    """
    none = F.lit(None).cast("string")
    if full_pages is not None:
        hidden = full_pages.select(*_PAGE).join(table_images.select(*_PAGE), _PAGE, "left_anti")
        texts = texts.join(hidden, _PAGE, "left_anti")
    parts = [
        texts.select(*_PAGE, F.col("para_idx").alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("seq"), F.lit("text").alias("kind"), "text", "is_heading", none.alias("image_ref")),
        table_images.select(*_PAGE, F.col("after_idx").alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("seq"), F.lit("image").alias("kind"), none.alias("text"),
                            F.lit(None).cast("boolean").alias("is_heading"), F.lit("table").alias("image_ref")),
        without_table_pages(images, table_images).select(*_PAGE, F.lit(2**31 - 1).alias("at"), F.lit(2).alias("rank"), F.col("img_seq").cast("int").alias("seq"),
                            F.lit("image").alias("kind"), none.alias("text"), F.lit(None).cast("boolean").alias("is_heading"), F.col("img_seq").cast("string").alias("image_ref")),
    ]
    order = Window.partitionBy(*_PAGE).orderBy("at", "rank", "seq")
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("block_idx", (F.row_number().over(order) - 1).cast("int")).drop("at", "rank", "seq")
