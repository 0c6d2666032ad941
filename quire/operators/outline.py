"""Outlines: flattening a tree, and resolving its entries to paragraphs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import destination_y
from quire.plans.stage import cut


def flatten(nodes: DataFrame) -> DataFrame:
    """(doc_id, entry_seq, title, page, depth, target_y) in pre-order.

    ``nodes``: doc_id, id, parent (null at the top), ord, title, page (null: unresolvable), dest_type, top,
    page_height. An unresolvable entry is left out, its children stay; a null title is empty. One join per level.
    """
    step = F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").cast("long").alias("id"))
    level = nodes.where("parent IS NULL").withColumn("depth", F.lit(0)).withColumn("path", F.array(step))
    children = nodes.select("doc_id", F.col("id").alias("cid"), "parent", F.col("ord").alias("cord"), "title", "page", "dest_type", "top", "page_height")
    found = level
    while not level.isEmpty():
        above = level.select(F.col("doc_id").alias("d"), F.col("id").alias("pid"), F.col("depth").alias("pdepth"), F.col("path").alias("ppath"))
        joined = children.join(above, (F.col("doc_id") == F.col("d")) & (F.col("parent") == F.col("pid")))
        level = cut(joined.select(
            "doc_id", F.col("cid").alias("id"), "parent", F.col("cord").alias("ord"), "title", "page", "dest_type", "top", "page_height",
            (F.col("pdepth") + 1).alias("depth"),
            F.array_append("ppath", F.struct(F.col("cord").cast("long").alias("ord"), F.col("cid").cast("long").alias("id"))).alias("path"),
        ))
        found = found.unionByName(level)
    order = Window.partitionBy("doc_id").orderBy("path")
    kept = found.where("page IS NOT NULL").withColumn("entry_seq", (F.row_number().over(order) - 1).cast("int"))
    y = destination_y(F.col("dest_type"), F.col("top"), F.col("page_height"))
    return kept.select("doc_id", "entry_seq", F.coalesce("title", F.lit("")).alias("title"), "page", "depth", y.alias("target_y"))


def to_paragraphs(outline: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds para_idx: on the target page the paragraph nearest to target_y (the first of equals); without a height, or
    without paragraphs there, the first on that page or a later one, else the last; null in a document without any."""
    # nearest within the page: an equi-join
    pairs = outline.where("target_y IS NOT NULL").join(paras.select("doc_id", "page", F.col("para_idx").alias("p"), "top_y"), ["doc_id", "page"])
    near = pairs.groupBy("doc_id", "entry_seq").agg(F.min_by("p", F.struct(F.abs(F.col("top_y") - F.col("target_y")).alias("d"), "p")).alias("near"))
    # first on the page or later: a running minimum from the end, over one row per page
    first = paras.groupBy("doc_id", "page").agg(F.min("para_idx").alias("lo"), F.max("para_idx").alias("hi"))
    asked = outline.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    later = Window.partitionBy("doc_id").orderBy(F.desc("page")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = first.unionByName(asked).withColumn("next_idx", F.min("lo").over(later)).withColumn("last_idx", F.max("hi").over(Window.partitionBy("doc_id")))
    fallback = both.select("doc_id", "page", F.coalesce("next_idx", "last_idx").alias("fallback")).distinct()
    joined = outline.join(fallback, ["doc_id", "page"], "left").join(near, ["doc_id", "entry_seq"], "left")
    return joined.withColumn("para_idx", F.coalesce("near", "fallback")).drop("near", "fallback")


def to_blocks(targets: DataFrame, images: DataFrame) -> DataFrame:
    """Adds block_idx: the paragraph plus the images placed before it (after_idx < para_idx). Null stays null."""
    counts = images.groupBy("doc_id", "after_idx").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.col("after_idx").alias("at"), F.lit(1).alias("kind"), "n")
    asked = targets.where("para_idx IS NOT NULL").select("doc_id", F.col("para_idx").alias("at")).distinct()
    asked = asked.select("doc_id", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    upto = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.unionByName(asked).withColumn("before", F.sum("n").over(upto)).where("kind = 0").select("doc_id", F.col("at").alias("para_idx"), "before")
    return targets.join(before, ["doc_id", "para_idx"], "left").withColumn("block_idx", (F.col("para_idx") + F.col("before")).cast("int")).drop("before")
