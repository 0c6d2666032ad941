"""A stream of pages cleaned with titles learned beforehand: an extension, as the data model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import DATE_LINE, URL_COUNTER_LINE, URL_LINE, trim_space


def clean_stream(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Streaming lines without URLs, dates, and the titles (doc_id, title) of a static table, by a stream-static anti join.

    Page counters need their whole page and are left to batch mode.
    """
    t = trim_space(F.col("text"))
    kept = lines.where(~(t.rlike(URL_LINE) | t.rlike(DATE_LINE) | t.rlike(URL_COUNTER_LINE)))
    known = titles.select(F.col("doc_id").alias("_d"), F.col("title").alias("_t"))
    return kept.join(known, (F.col("doc_id") == F.col("_d")) & (t == F.col("_t")), "left_anti")
