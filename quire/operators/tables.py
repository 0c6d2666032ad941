"""Ruled tables: line segments to one region per page, and what lies outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g

# fixed values
MAX_SEGMENTS = 20_000
MIN_CLUSTERS = 3
_PAGE = ["doc_id", "page"]


def path_segments(ops: DataFrame) -> DataFrame:
    """Segments (doc_id, page, path_seq, seg_seq, x1, y1, x2, y2, painted) of path operations.

    ``ops``: doc_id, page, op_seq, op, x, y, and w, h of rectangles. ``rect`` gives its four edges, ``line`` a line
    from the current point, ``close`` one back to where the subpath began; ``move`` and ``curve`` only move the
    point. ``stroke``, ``fill`` and ``both`` end a path and paint it, ``discard`` ends it unpainted, and so does the
    page's end. ``path_seq`` numbers the paths of a page from 1.
    """
    page = Window.partitionBy(*_PAGE).orderBy("op_seq")
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    later = page.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    op, zero = F.col("op"), F.lit(0.0).cast("float")
    ends = op.isin("stroke", "fill", "both", "discard")

    def last(value: Column) -> Column:
        return F.coalesce(F.last(value, ignorenulls=True).over(earlier), zero)

    begun = ops.select("*", *(last(F.when(op.isin("move", "rect"), F.col(c))).alias(f"s{c}") for c in "xy"))
    after = {c: F.when(op.isin("move", "line", "curve", "rect"), F.col(c)).when(op == "close", F.col(f"s{c}")) for c in "xy"}
    placed = begun.select(
        "*",
        *(last(after[c]).alias(f"c{c}") for c in "xy"),
        (F.coalesce(F.count_if(ends).over(earlier), F.lit(0)) + 1).alias("path_seq"),
        F.coalesce(F.first(F.when(ends, op != "discard"), ignorenulls=True).over(later), F.lit(False)).alias("painted"),
    )
    right, bottom = (F.col("x") + F.col("w")).cast("float"), (F.col("y") + F.col("h")).cast("float")

    def edge(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    x, y, cx, cy = F.col("x"), F.col("y"), F.col("cx"), F.col("cy")
    edges = (
        F.when(op == "rect", F.array(edge(x, y, right, y), edge(right, y, right, bottom), edge(right, bottom, x, bottom), edge(x, bottom, x, y)))
        .when(op == "line", F.array(edge(cx, cy, x, y)))
        .when(op == "close", F.array(edge(cx, cy, F.col("sx"), F.col("sy"))))
    )
    found = placed.select(*_PAGE, "op_seq", "path_seq", "painted", F.posexplode(edges).alias("nth", "e"))
    numbered = Window.partitionBy(*_PAGE, "path_seq").orderBy("op_seq", "nth")
    return found.select(*_PAGE, "path_seq", (F.row_number().over(numbered) - 1).alias("seg_seq"), "e.*", "painted")


def capped_segments(segments: DataFrame, most: int = MAX_SEGMENTS) -> DataFrame:
    """Painted segments up to the first path that would bring a page over ``most``; that path and later ones are left out.

    A path that is not painted can be the one that trips the cap and never counts towards it.
    """
    paths = segments.groupBy(*_PAGE, "path_seq").agg(F.count(F.lit(1)).alias("n"), F.max("painted").alias("painted"))
    earlier = Window.partitionBy(*_PAGE).orderBy("path_seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.when(F.col("painted"), F.col("n")).otherwise(0)).over(earlier), F.lit(0))
    trips = paths.withColumn("trips", (done + F.col("n")) > most)
    first = trips.where("trips").groupBy(*_PAGE).agg(F.min("path_seq").alias("stop"))
    kept = segments.where("painted").join(first, _PAGE, "left")
    return kept.where(F.col("stop").isNull() | (F.col("path_seq") < F.col("stop"))).drop("stop")


def ruled_segments(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """On-page segments that are horizontal or vertical, with ``axis`` 'h' or 'v'."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    inside = segments.join(pages.select(*_PAGE, "width", "height"), _PAGE).where(g.on_page(*ends, F.col("width"), F.col("height")))
    axis = F.when(g.is_horizontal(*ends), "h").when(g.is_vertical(*ends), "v")
    return inside.withColumn("axis", axis).where("axis IS NOT NULL").drop("width", "height")


def cluster_count(values: DataFrame, keys: list[str], value: str, tolerance: float = g.CLUSTER_TOLERANCE) -> DataFrame:
    """(keys, clusters): single-link clusters of sorted values; a new one starts where a step is over the tolerance."""
    order = Window.partitionBy(*keys).orderBy(value)
    step = F.col(value) - F.lag(value).over(order)
    steps = values.select(*keys, value).distinct().withColumn("_new", (step > F.lit(tolerance).cast("float")).cast("int"))
    return steps.groupBy(*keys).agg((F.lit(1) + F.coalesce(F.sum("_new"), F.lit(0))).cast("int").alias("clusters"))


def table_regions(segments: DataFrame, pages: DataFrame, most: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, page, min_x, min_y, max_x, max_y) of pages with a table.

    A table has three rows and three columns of lines at least, whose boxes meet. Lines doubled by thick strokes
    count once.
    """
    ruled = ruled_segments(capped_segments(segments, most), pages)
    place = F.when(F.col("axis") == "h", (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2).cast("float")
    ruled = ruled.withColumn("place", place)
    clusters = cluster_count(ruled, [*_PAGE, "axis"], "place")
    boxes = ruled.groupBy(*_PAGE, "axis").agg(
        F.min(F.least("x1", "x2")).alias("x0"),
        F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("x1", "x2")).alias("x9"),
        F.max(F.greatest("y1", "y2")).alias("y9"),
    )
    good = boxes.join(clusters.where(F.col("clusters") >= MIN_CLUSTERS), [*_PAGE, "axis"])

    def of(axis: str, name: str) -> Column:
        return F.max(F.when(F.col("axis") == axis, F.col(name)))

    both = good.groupBy(*_PAGE).agg(*(of(a, n).alias(f"{a}_{n}") for a in "hv" for n in ("x0", "y0", "x9", "y9")))
    meet = (
        (F.col("h_x0") <= F.col("v_x9")) & (F.col("v_x0") <= F.col("h_x9")) & (F.col("h_y0") <= F.col("v_y9")) & (F.col("v_y0") <= F.col("h_y9"))
    )
    return both.where(meet).select(
        *_PAGE,
        F.least("h_x0", "v_x0").alias("min_x"),
        F.least("h_y0", "v_y0").alias("min_y"),
        F.greatest("h_x9", "v_x9").alias("max_x"),
        F.greatest("h_y9", "v_y9").alias("max_y"),
    )


def outside_tables(lines: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that are not inside their page's table band."""
    band = regions.join(pages.select(*_PAGE, "height"), _PAGE).select(*_PAGE, "min_y", "max_y", "height")
    joined = lines.join(band, _PAGE, "left")
    inside = g.in_table_band(F.col("y"), F.col("min_y"), F.col("max_y"), F.col("height"))
    return joined.where(~F.coalesce(inside, F.lit(False))).drop("min_y", "max_y", "height")


def crop_rects(regions: DataFrame, pages: DataFrame, dpi: float) -> DataFrame:
    """(doc_id, page, left, top, right, bottom) in pixels of a page rendered at ``dpi``."""
    joined = regions.join(pages.select(*_PAGE, "width", "height"), _PAGE)
    w, h = ((F.col(c) * F.lit(dpi / 72).cast("float")).cast("int") for c in ("width", "height"))
    rect = g.crop_rect(*(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")), F.col("height"), F.lit(dpi).cast("float"), w, h)
    return joined.select(*_PAGE, rect.alias("r")).select(*_PAGE, "r.*")
