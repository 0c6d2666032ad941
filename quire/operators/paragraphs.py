"""Lines to paragraphs: runs of one line, gaps, islands, and headings.

Runs and islands never cross a page, so both are found page by page; only the gap threshold of document mode and
the numbering look at a whole document, and they do so over one row per page or per different gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import cjk_spacing, join_lines
from quire.operators.medians import upper_median

# fixed values
SAME_LINE = 0.01
GAP_FACTOR = 1.5
HEADING_FACTOR = 1.15

_PAGE = ["doc_id", "page"]


def merge_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, seq, y, text, font_size, is_bold): rows at the height of a run's first row, as one.

    A step of three tolerances between neighbours ends a run in any case. What lies between two such steps is a run if
    all of it is at its first row's height; only where heights drift are rows folded in order, as a run is held to its
    first row and not to the row before.
    """
    order = Window.partitionBy(*_PAGE).orderBy("seq")
    step = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) >= F.lit(3 * SAME_LINE).cast("float"), F.lit(True))
    stretches = lines.withColumn("_step", step.cast("int")).withColumn("_stretch", F.sum("_step").over(order))
    row = F.struct("seq", "y", "text", "font_size", "is_bold")
    grouped = stretches.groupBy(*_PAGE, "_stretch").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def level(r: Column, y: Column) -> Column:
        return F.coalesce(F.abs(r.y - y) < F.lit(SAME_LINE).cast("float"), F.lit(False))

    kind = "array<array<struct<seq:bigint,y:float,text:string,font_size:float,is_bold:boolean>>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind[6:-1]).alias("run"))

    def fold(acc: Column, r: Column) -> Column:
        same = (F.size(acc.run) > 0) & level(r, F.get(acc.run, 0).y)
        done = F.when(same | (F.size(acc.run) == 0), acc.done).otherwise(F.array_append(acc.done, acc.run))
        return F.struct(done.alias("done"), F.when(same, F.array_append(acc.run, r)).otherwise(F.array(r)).alias("run"))

    rows = F.col("rows").cast(kind[6:-1])
    one = (F.size("rows") == 1) | F.forall("rows", lambda r: level(r, F.get(F.col("rows"), 0).y))
    runs = F.when(one, F.array(rows)).otherwise(F.aggregate(rows, start, fold, lambda acc: F.array_append(acc.done, acc.run)))
    flat = grouped.select(*_PAGE, F.explode(runs).alias("run"))
    return flat.select(
        *_PAGE,
        F.get("run", 0).seq.cast(lines.schema["seq"].dataType).alias("seq"),
        F.get("run", 0).y.alias("y"),
        join_lines(F.col("run.text")).alias("text"),
        F.array_max("run.font_size").alias("font_size"),
        F.array_max("run.is_bold").alias("is_bold"),
    )


def _gaps(merged: DataFrame) -> DataFrame:
    """Adds gap to the row before on the page (null on a page's first row) and cross, the gap to the page before."""
    page = Window.partitionBy(*_PAGE).orderBy("seq")
    gaps = merged.withColumn("gap", (F.col("y") - F.lag("y").over(page)).cast("float"))
    ends = merged.groupBy(*_PAGE).agg(F.min_by("y", "seq").alias("first_y"), F.max_by("y", "seq").alias("last_y"))
    before = F.lag("last_y").over(Window.partitionBy("doc_id").orderBy("page"))
    return gaps, ends.select("doc_id", "page", (F.col("first_y") - before).cast("float").alias("gap"))


def paragraphs(lines: DataFrame, mode: str = "document", merged: DataFrame | None = None) -> DataFrame:
    """(doc_id, para_idx, page, top_y, text, font_size, is_bold).

    ``mode``: "document" takes the median gap over a document, gaps between pages included; "page" over each page.
    """
    if mode not in ("document", "page"):
        raise ValueError(mode)
    merged = merge_runs(lines) if merged is None else merged
    scope = ["doc_id"] if mode == "document" else _PAGE
    gaps, cross = _gaps(merged)
    measured = gaps.select(*scope, "gap")
    if mode == "document":
        measured = measured.unionByName(cross.select("doc_id", "gap"))
    median = upper_median(measured, scope, "gap", "median")
    sizes = merged.groupBy(*scope).agg(F.count(F.lit(1)).alias("scope_rows"))
    rows = gaps.join(median, scope, "left").join(sizes, scope)
    page = Window.partitionBy(*_PAGE).orderBy("seq")
    breaks = F.col("gap").isNull() | (F.col("gap") > (F.col("median") * F.lit(GAP_FACTOR).cast("float")).cast("float"))
    rows = rows.withColumn("island", F.sum(breaks.cast("int")).over(page))
    rolled = rows.groupBy(*_PAGE, "island").agg(
        F.min_by("y", "seq").alias("top_y"),
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"),
        F.max("font_size").alias("font_size"),
        F.max("is_bold").alias("is_bold"),
        F.max("scope_rows").alias("scope_rows"),
    )
    joined = join_lines(F.col("parts.text"))
    # a scope of a single row keeps its text as it is
    rolled = rolled.withColumn("text", F.when(F.col("scope_rows") == 1, joined).otherwise(cjk_spacing(joined)))
    return _numbered(rolled, mode).select("doc_id", "para_idx", "page", "top_y", "text", "font_size", "is_bold")


def _numbered(rolled: DataFrame, mode: str) -> DataFrame:
    """Adds para_idx: over the document, or from 0 on each page."""
    local = (F.col("island") - 1).cast("int")
    if mode == "page":
        return rolled.withColumn("para_idx", local)
    per_page = rolled.groupBy(*_PAGE).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_page.select("doc_id", "page", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("int").alias("before"))
    return rolled.join(offsets, _PAGE).withColumn("para_idx", (F.col("before") + local).cast("int"))


def headings(paras: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Adds is_heading: larger than 1.15 times the median size of the scope (a page), or bold."""
    scope = scope or _PAGE
    base = upper_median(paras.where("font_size > 0"), scope, "font_size", "baseline")
    limit = (F.col("baseline") * F.lit(HEADING_FACTOR).cast("float")).cast("float")
    large = (F.col("baseline") > 0) & (F.col("font_size") > limit)
    return paras.join(base, scope, "left").withColumn("is_heading", F.coalesce(large, F.lit(False)) | F.col("is_bold")).drop("baseline")
