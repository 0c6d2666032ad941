"""Noise lines: URLs, dates, page counters beside them, and running titles learned from repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import COUNTER_LINE, DATE_LINE, URL_COUNTER_LINE, URL_LINE, trim_space, utf16_length

# fixed values: when a repeated text is a running title
MAX_TITLE_LENGTH = 60
MIN_TITLE_PAGES = 3
MIN_TITLE_SHARE = 0.5
#: Pages that titles are learned from in page mode.
SAMPLE_PAGES = 150


def running_titles(rows: DataFrame) -> DataFrame:
    """(doc_id, title) of texts on at least three pages and half of a document's pages that have rows."""
    lines = rows.select("doc_id", "page", trim_space(F.col("text")).alias("title"))
    pages = lines.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"))
    found = (
        lines.where((F.col("title") != "") & (utf16_length(F.col("title")) <= MAX_TITLE_LENGTH))
        .select("doc_id", "title", "page")
        .distinct()
        .groupBy("doc_id", "title")
        .agg(F.count(F.lit(1)).alias("_on"))
        .where(F.col("_on") >= MIN_TITLE_PAGES)
    )
    return found.join(pages, "doc_id").where(F.col("_on") / F.col("_pages") >= MIN_TITLE_SHARE).select("doc_id", "title")


def learned_titles(lines: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Running titles of the first pages only."""
    return running_titles(lines.where(F.col("page") <= sample_pages))


def flag_patterns(rows: DataFrame, name: str = "is_noise") -> DataFrame:
    """Adds whether a row is a URL, a date, a URL with a counter, or a counter on a page that has one of those; and _t, the trimmed text."""
    t = F.col("_t")
    lead = t.rlike(URL_LINE) | t.rlike(DATE_LINE) | t.rlike(URL_COUNTER_LINE)
    page = Window.partitionBy("doc_id", "page")
    marked = rows.withColumn("_t", trim_space(F.col("text"))).withColumn("_lead", lead).withColumn("_counter", t.rlike(COUNTER_LINE))
    flagged = marked.withColumn("_with", F.max("_lead").over(page))
    return flagged.withColumn(name, F.coalesce(F.col("_lead") | (F.col("_counter") & F.col("_with")), F.lit(False))).drop("_lead", "_counter", "_with")


def flag_noise(rows: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Adds is_noise. ``titles`` (doc_id, title) are the document's own running titles if not given."""
    titles = running_titles(rows) if titles is None else titles
    known = titles.select("doc_id", F.col("title").alias("_t"), F.lit(True).alias("_known"))
    joined = flag_patterns(rows, "_pattern").join(known, ["doc_id", "_t"], "left")
    return joined.withColumn("is_noise", F.col("_pattern") | F.coalesce("_known", F.lit(False))).drop("_t", "_known", "_pattern")


def clean(rows: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    return flag_noise(rows, titles).where("NOT is_noise").drop("is_noise")
