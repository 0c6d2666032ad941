"""The registered queries: operators over the derived frames."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import binary, geometry, reflow, text
from quire.operators import glyphs, noise, outline, paragraphs, placement, store, tables
from quire.plans import documents
from quire.sources import files, frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


_WIDE = {"float": "double", "int": "bigint"}


def query(f: Query) -> Query:
    """Registers a query; numbers leave it in their wide types."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        kinds = {c.name: c.dataType.simpleString() for c in df.schema}
        return df.select(*(F.col(c).cast(_WIDE.get(k, k)).alias(c) if k in _WIDE else F.col(c) for c, k in kinds.items()))

    QUERIES[f.__name__] = run
    return run


@query
def clean_lines(spark, sf):
    return noise.clean(frames.noise_frame(spark, sf))


@query
def noise_lines(spark, sf):
    return noise.flag_noise(frames.noise_frame(spark, sf)).where("is_noise").drop("is_noise")


@query
def learned_titles(spark, sf):
    return noise.learned_titles(frames.noise_frame(spark, sf))


@query
def clean_lines_page_mode(spark, sf):
    lines = frames.noise_frame(spark, sf)
    return noise.clean(lines, noise.learned_titles(lines))


@query
def merged_lines(spark, sf):
    return paragraphs.merge_runs(frames.styled_frame(spark, sf))


@query
def paragraphs_doc(spark, sf):
    return paragraphs.paragraphs(frames.styled_frame(spark, sf), "document")


@query
def paragraphs_page(spark, sf):
    return paragraphs.paragraphs(frames.styled_frame(spark, sf), "page")


@query
def headings(spark, sf):
    found = paragraphs.headings(paragraphs.paragraphs(frames.styled_frame(spark, sf), "page"))
    return found.select("doc_id", "page", "para_idx", "is_heading")


@query
def cjk_spacing(spark, sf):
    return frames.cjk_frame(spark, sf).select("doc_id", "page", "seq", text.cjk_spacing(F.col("text")).alias("spaced"))


@query
def cjk_tokens(spark, sf):
    return frames.cjk_frame(spark, sf).select("doc_id", "page", "seq", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query
def radical_fix(spark, sf):
    t = F.translate("text", "aeiou", "⻋⻓⼀⼈⻰")
    return frames.line_frame(spark, sf).select("doc_id", "page", "seq", text.fix_radicals(t).alias("fixed"))


@query
def grid_segments(spark, sf):
    found = tables.ruled_segments(tables.capped_segments(frames.segment_frame(spark, sf)), frames.segment_pages(spark, sf))
    return found.select("doc_id", "page", "path_seq", "seg_seq", "axis", "x1", "y1", "x2", "y2")


@query
def capped_segments(spark, sf):
    """The cap at six segments a page, so that the small pages trip it."""
    return tables.capped_segments(frames.segment_frame(spark, sf), 6).select("doc_id", "page", "path_seq", "seg_seq")


@query
def table_regions(spark, sf):
    return tables.table_regions(frames.segment_frame(spark, sf), frames.segment_pages(spark, sf))


@query
def lines_outside_tables(spark, sf):
    pages = frames.segment_pages(spark, sf)
    regions = tables.table_regions(frames.segment_frame(spark, sf), pages)
    return tables.outside_tables(frames.table_line_frame(spark, sf), regions, pages)


@query
def crop_rects(spark, sf):
    pages = frames.segment_pages(spark, sf)
    return tables.crop_rects(tables.table_regions(frames.segment_frame(spark, sf), pages), pages, 144.0)


@query
def strip_stitch(spark, sf):
    return placement.stitched_strips(frames.image_frame(spark, sf))


@query
def full_page_images(spark, sf):
    images = frames.image_frame(spark, sf)
    pages = images.select("doc_id", "page").distinct().withColumn("width", F.lit(612.0).cast("float")).withColumn("height", F.lit(792.0).cast("float"))
    return placement.full_page_images(images, pages)


def _part_images(spark, sf) -> DataFrame:
    return frames.read(spark, sf, "supplier").selectExpr("1L AS doc_id", "int(s_suppkey * 3) AS page", "s_suppkey AS img_seq")


@query
def image_placement(spark, sf):
    return placement.place_by_page(_part_images(spark, sf), frames.part_paragraphs(spark, sf))


@query
def region_placement(spark, sf):
    regions = frames.read(spark, sf, "supplier").selectExpr("1L AS doc_id", "s_suppkey", "int(s_suppkey * 2) AS page", "float(s_suppkey % 500) AS top_y")
    return placement.place_regions(regions, frames.part_paragraphs(spark, sf))


@query
def path_segments(spark, sf):
    """Every segment of the path operations, whether painted or not."""
    return tables.path_segments(frames.path_ops(spark, sf))


@query
def painted_segments(spark, sf):
    """Path operations to the segments that count, unpainted paths left out."""
    return tables.capped_segments(tables.path_segments(frames.path_ops(spark, sf))).select("doc_id", "page", "path_seq", "seg_seq")


@query
def glyph_lines(spark, sf):
    return glyphs.lines_of_glyphs(frames.glyph_frame(spark, sf))


@query
def strip_pixels(spark, sf):
    """Strips of three columns (the last of one) and two rows, side by side; a strip cut short makes its page's pixels null."""
    images = frames.image_frame(spark, sf).withColumn("width", F.expr("if(width = 19, 1, 3)")).withColumn("height", F.lit(2))
    data = F.unhex(F.sha2(F.concat_ws("-", "page", "img_seq"), 256))
    short = (F.col("page") % 5 == 0) & (F.col("img_seq") == 0)
    images = images.withColumn("pixels", F.substring(data, F.lit(1), F.col("width") * 6 - short.cast("int")))
    return placement.stitched_pixels(images).withColumn("pixels", F.coalesce(F.hex("pixels"), F.lit("none")))


@query
def outline_flat(spark, sf):
    return outline.flatten(frames.outline_nodes(spark, sf))


@query
def outline_targets(spark, sf):
    return outline.to_paragraphs(outline.flatten(frames.outline_nodes(spark, sf)), frames.part_paragraphs(spark, sf))


@query
def outline_blocks(spark, sf):
    paras = frames.part_paragraphs(spark, sf)
    targets = outline.to_paragraphs(outline.flatten(frames.outline_nodes(spark, sf)), paras)
    images = placement.place_by_page(_part_images(spark, sf), paras)
    return outline.to_blocks(targets, images).select("doc_id", "entry_seq", "para_idx", "block_idx")


@query
def outline_labels(spark, sf):
    flat = outline.flatten(frames.outline_nodes(spark, sf))
    return flat.select("entry_seq", text.indent_label(F.col("title"), F.col("depth")).alias("label"))


@query
def blocks(spark, sf):
    """Paragraphs of styled pages with a table image on some and strips of images on others."""
    texts = paragraphs.headings(paragraphs.paragraphs(frames.styled_frame(spark, sf), "page"))
    docs = frames.read(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"))
    tabled = docs.where("page % 4 = 0").select("doc_id", "page", F.expr("int(page % 3) - 1").alias("after_idx"))
    images = docs.where("page % 2 = 0").select("doc_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("img_seq"))
    full = docs.where("page % 10 = 0")
    return placement.blocks(texts, tabled, images, full).withColumn("is_heading", F.coalesce("is_heading", F.lit(False)))


@query
def extract_document(spark, sf):
    """Document mode from lines to cleaned and numbered paragraphs, with the noise rows among the lines."""
    return _document(spark, sf)[0]


def _document(spark, sf):
    lines = frames.noise_frame(spark, sf)
    y = F.expr("72 + 14 * (seq div 2) + 20 * (seq div 8)")
    lines = lines.withColumn("y", y.cast("float")).withColumn("font_size", F.lit(12.0).cast("float")).withColumn("is_bold", F.lit(False))
    pages = frames.read(spark, sf, "documents").selectExpr("source AS doc_id", "doc_id AS page", "612f AS width", "3000000f AS height")
    images = pages.where("page % 5 = 0").select("doc_id", "page", F.lit(0).alias("img_seq"))
    return documents.extract_document(lines, frames.document_segments(pages), images, pages)


@query
def document_images(spark, sf):
    return _document(spark, sf)[1].select("doc_id", "page", "kind", "after_idx")


@query
def line_width(spark, sf):
    p = frames.read(spark, sf, "part")
    return p.select("p_partkey", reflow.line_width(F.col("p_partkey") * 3, F.expr("p_size - 5")).alias("chars"))


@query
def subsampling(spark, sf):
    p = frames.read(spark, sf, "part").selectExpr("p_partkey", "int(p_partkey * 17 % 70000 + 1) AS w", "int(p_size * 91) AS h")
    return p.select("p_partkey", geometry.subsampling(F.col("w"), F.col("h")).alias("factor"))


@query
def orientation(spark, sf):
    k = "(p_partkey % 9)"
    p = frames.read(spark, sf, "part").selectExpr(
        "p_partkey", f"float(case when {k} in (0, 2) then 100 when {k} in (1, 3) then -100 when {k} = 8 then 70 else 0 end) AS a",
        f"float(case when {k} in (4, 6) then 100 when {k} in (5, 7) then -100 when {k} = 8 then 70 else 0 end) AS b",
        f"float(case when {k} in (4, 5) then 100 when {k} in (6, 7) then -100 when {k} = 8 then -70 else 0 end) AS c",
        f"float(case when {k} in (0, 1) then 100 when {k} in (2, 3) then -100 when {k} = 8 then 70 else 0 end) AS d", "p_size AS w", "p_size * 2 AS h",
    )
    m = geometry.orientation(*(F.col(c) for c in "abcdwh"))
    return p.select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


@query
def component_infer(spark, sf):
    p = frames.read(spark, sf, "part").selectExpr(
        "p_partkey", "p_size AS w", "int(p_partkey % 11) AS h", "int(p_partkey % 18) AS bits", "int(p_partkey % 5) AS reported",
        "((p_size * if(p_partkey % 2 = 0, 1, 3) * (p_partkey % 18) + 7) div 8) * (p_partkey % 11) AS n_bytes",
    )
    found = binary.inferred_components(*(F.col(c) for c in ("w", "h", "bits", "reported", "n_bytes")))
    return p.select("p_partkey", F.coalesce(found, F.lit(-1)).alias("components"))


@query
def jpeg_components(spark, sf):
    """Built headers: a comment segment, then a frame that names p_size components."""
    tail = F.lpad(F.hex("p_size"), 2, "0")
    head = F.concat(F.lit("FFD8FFFE0004ABCDFF"), F.when(F.col("p_partkey") % 2 == 0, "C0").otherwise("C4"), F.lit("00110800010001"), tail)
    return frames.read(spark, sf, "part").select("p_partkey", F.coalesce(binary.jpeg_components(F.unhex(head)), F.lit(-1)).alias("components"))


@query
def raw_decode(spark, sf):
    data = F.unhex(F.sha2(F.col("p_partkey").cast("string"), 256))
    pixels = binary.raw_pixels(data, F.lit(4), F.lit(8), F.lit(8), F.lit(1))
    turned = binary.oriented_pixels(pixels, F.lit(4), F.lit(8), geometry.orientation(F.lit(0), F.lit(1), F.lit(1), F.lit(0), F.lit(4), F.lit(8)))
    return frames.read(spark, sf, "part").select("p_partkey", F.hex(pixels).alias("rgb"), F.hex(turned).alias("turned"))


@query
def raw_depths(spark, sf):
    """Two rows of two samples, of 1 to 16 bits and one or three components."""
    p = frames.read(spark, sf, "part").selectExpr("p_partkey", "int(p_partkey % 16 + 1) AS bits", "if(p_partkey % 5 < 2, 1, 3) AS n")
    data = F.substring(F.unhex(F.sha2(F.col("p_partkey").cast("string"), 256)), F.lit(1), (binary.row_bytes(F.lit(2), F.col("n"), F.col("bits")) * 2).cast("int"))
    return p.select("p_partkey", F.hex(binary.raw_pixels(data, F.lit(2), F.lit(2), F.col("bits"), F.col("n"))).alias("rgb"))


@query
def page_status(spark, sf):
    """Pages whose samples cannot be decoded are failed rows, not a failed job."""
    p = frames.read(spark, sf, "part").selectExpr("p_partkey", "int(p_partkey % 18) AS bits")
    data = F.unhex(F.sha2(F.col("p_partkey").cast("string"), 256))
    found = files.failed_rows(p.select("p_partkey", binary.raw_pixels(data, F.lit(4), F.lit(8), F.col("bits"), F.lit(1)).alias("rgb")), "rgb")
    return found.select("p_partkey", "status")


@query
def decode_routes(spark, sf):
    p = frames.read(spark, sf, "part").selectExpr(
        "p_partkey", "element_at(array(1, 8, 4), int(p_partkey % 3 + 1)) AS bits", "if(p_partkey % 2 = 0, 'jpg', 'png') AS suffix",
        "int(p_partkey * 17 % 70000 + 1) AS w", "int(p_size * 91) AS h", "if(p_partkey % 5 = 0, null, int(p_partkey % 5)) AS components",
    )
    factor = geometry.subsampling(F.col("w"), F.col("h"))
    return p.select("p_partkey", binary.decode_route(F.col("bits"), F.col("suffix"), factor, F.col("components")).alias("route"))


def _page_blocks(spark, sf, page=None):
    """Page mode from lines to display blocks; tables on every seventh page, full pages of image on every tenth, a small one on other fifths."""
    lines = frames.noise_frame(spark, sf)
    y = F.expr("72 + 14 * (seq div 2) + 20 * (seq div 8)").cast("float")
    lines = lines.withColumn("y", y).withColumn("font_size", F.lit(12.0).cast("float")).withColumn("is_bold", F.col("seq") == 1)
    pages = frames.read(spark, sf, "documents").selectExpr("source AS doc_id", "doc_id AS page", "612f AS width", "792f AS height")
    ctm = "named_struct('a', float(if(page % 10 = 0, 600, 10)), 'd', float(if(page % 10 = 0, 700, 10))) AS ctm"
    images = pages.where("page % 5 = 0").selectExpr("doc_id", "page", "0 AS img_seq", ctm)
    found = documents.page_blocks(lines, frames.document_segments(pages), images, pages, page)
    return found.withColumn("is_heading", F.coalesce("is_heading", F.lit(False)))


@query
def page_blocks(spark, sf):
    return _page_blocks(spark, sf)


@query
def single_page(spark, sf):
    """One page of every document that has it: loading a page is the feature."""
    return _page_blocks(spark, sf, 14)


@query
def reflow_lines(spark, sf):
    lines = frames.line_frame(spark, sf).select("doc_id", "page", "seq", F.posexplode(reflow.reflow(F.col("text"), 40)).alias("line_no", "line"))
    return lines


@query
def content_key(spark, sf):
    return frames.read(spark, sf, "documents").select("doc_id", store.content_key(F.encode("text", "UTF-8")).alias("file_key"))


@query
def progress_upsert(spark, sf):
    e = frames.read(spark, sf, "events")
    updates = e.selectExpr("cast(user_id AS string) AS file_key", "int(event_id % 7) - 1 AS page", "event_id AS ts")
    stored = e.selectExpr("cast(user_id AS string) AS file_key").distinct().selectExpr("file_key", "5 AS page")
    more = stored.selectExpr("concat('old', file_key) AS file_key", "page")
    return store.upsert_progress(stored.unionByName(more), updates)


@query
def progress_read(spark, sf):
    """Where each document was left; progress is kept for the even users only, in part under the first page."""
    files = frames.read(spark, sf, "events").selectExpr("cast(user_id AS string) AS file_key").distinct()
    kept = files.where("int(file_key) % 2 = 0").selectExpr("file_key", "int(file_key) % 9 - 2 AS page")
    return store.read_progress(files, kept)


@query
def settings_clamp(spark, sf):
    s = frames.read(spark, sf, "part").selectExpr(
        "p_partkey", "if(p_partkey % 6 = 0, null, p_size) AS font_size", "float(p_size / 16) AS line_spacing", "int(p_size - 10) AS padding", "int(p_partkey % 60) - 10 AS block_spacing"
    )
    return store.clamp_settings(s)


@query
def load_state(spark, sf):
    p = frames.read(spark, sf, "part").selectExpr("p_partkey", "if(p_partkey % 7 = 0, null, int(p_size - 5)) AS pages", "case p_partkey % 3 when 0 then null when 1 then '\\n\u3000' else p_name end AS error", "p_partkey % 4 = 0 AS failed")
    return p.select("p_partkey", store.load_state(F.col("pages"), F.col("error"), F.col("failed")).alias("s")).select(
        "p_partkey", "s.state", F.coalesce("s.page_count", F.lit(0)).alias("page_count"), "s.message"
    )


@query
def slider_maps(spark, sf):
    p = frames.read(spark, sf, "part").selectExpr("p_partkey", "p_size", "int(p_size % 11) AS progress", "(p_partkey % 101) / 100D AS fraction")
    return p.select(
        "p_partkey",
        geometry.scrubber_page(F.col("fraction"), F.col("p_size")).alias("page"),
        geometry.progress_of_spacing(geometry.f32(1) + F.col("progress") / F.lit(8)).alias("progress"),
        geometry.spacing_of_progress(F.col("progress")).alias("spacing"),
        # the way there and back on the slider's own steps, which truncation does not always survive
        geometry.progress_of_spacing(geometry.spacing_of_progress(F.col("progress"))).alias("again"),
    )


@query
def view_uris(spark, sf):
    e = frames.read(spark, sf, "events")
    return e.select("event_id", store.view_uri(F.upper("event_type"), F.col("props")).alias("uri"))
