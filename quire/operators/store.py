"""Keys, progress, settings and load states of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank

# fixed values: (lowest, highest, default) of each setting
SETTINGS = {
    "font_size": (12, 32, 16),
    "line_spacing": (1.0, 2.0, 1.2),
    "padding": (8, 32, 16),
    "block_spacing": (0, 32, 12),
}
#: Messages of a document without content, and of a failure that says nothing itself.
EMPTY_MESSAGE = "Nothing to show: no text and no images were found."
ERROR_MESSAGE = "This document cannot be read."


def content_key(content: Column) -> Column:
    """SHA-256 of the bytes, lowercase hex."""
    return F.sha2(content, 256)


def upsert_progress(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """(file_key, page): the update with the largest ts wins, else what is stored; pages are 1 at least. updates: file_key, page, ts."""
    both = stored.select("file_key", "page", F.lit(None).cast("long").alias("ts")).unionByName(updates.select("file_key", "page", F.col("ts").cast("long").alias("ts")))
    newest = both.groupBy("file_key").agg(F.max_by("page", F.struct(F.coalesce("ts", F.lit(-(2**63))).alias("ts"), "page")).alias("page"))
    return newest.select("file_key", F.greatest("page", F.lit(1)).alias("page"))


def read_progress(files: DataFrame, progress: DataFrame) -> DataFrame:
    """Adds page to files; null where none is stored."""
    return files.join(progress.select("file_key", F.greatest("page", F.lit(1)).alias("page")), "file_key", "left")


def clamp_settings(settings: DataFrame) -> DataFrame:
    """Missing settings get their default, others are held to their range; further columns stay."""
    for name, (low, high, default) in SETTINGS.items():
        kind = "float" if isinstance(default, float) else "int"
        value = F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))
        settings = settings.withColumn(name, F.least(F.greatest(value, F.lit(low).cast(kind)), F.lit(high).cast(kind)))
    return settings


def load_state(pages: Column, error: Column, failed: Column) -> Column:
    """struct(state, page_count, message) of a loading result; a null number of pages counts as none."""
    said = F.when(~is_blank(F.coalesce(error, F.lit(""))), error).otherwise(F.lit(ERROR_MESSAGE))
    ok = ~failed & F.coalesce(pages > 0, F.lit(False))
    return F.struct(
        F.when(ok, "success").otherwise("error").alias("state"),
        F.when(ok, pages).alias("page_count"),
        F.when(failed, said).when(~ok, F.lit(EMPTY_MESSAGE)).alias("message"),
    )


def view_uri(action: Column, data: Column) -> Column:
    return F.when(action == "VIEW", data)
