"""Exact dedup in two Bloom passes, in DataFrame functions only.

Pass 1 hashes each normalised text and counts how many rows fall on each cell of a Bloom filter (two cells a
row, partial counts before the shuffle); cells hit more than once become the set bits of a bitmap.
Pass 2 probes that bitmap: a row with a cell that no other row hit is unique and passes straight through. Only
the rest is shuffled, grouped by digest, so false positives cost time and never change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, cut_lineage

#: Cells of the filter for each row, before rounding up to a power of two.
CELLS_PER_ROW = 16
#: Bound on the filter: 2**28 bits, a broadcast of 32 MB. Beyond it more unique rows are shuffled, none is lost.
MAX_FILTER_BITS = 1 << 28
_BITMAP_BITS = 32768


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def repeated_cells(digests: DataFrame, cells: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the cells that two or more of the rows' cells ``c1`` and ``c2`` fall on."""
    hit = (
        digests.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return hit.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of a
    group stays. Ids are expected to be unique: repeated rows of one id are counted each and share one verdict;
    a null id never stays unless its whole group has null ids. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    digests = cut_lineage(
        docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("_sha"))
    )
    cells = _BITMAP_BITS
    rows = digests.count()
    while cells < min(rows * CELLS_PER_ROW, max_filter_bits):
        cells *= 2
    h = F.xxhash64("_sha")
    digests = digests.select(
        "_id",
        "_sha",
        (h.bitwiseAND(F.lit(cells - 1)) + 1).alias("c1"),
        (F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(cells - 1)) + 1).alias("c2"),
    )
    # at most max_filter_bits / 8 bytes, whatever the input
    bitmaps = repeated_cells(digests, cells)
    for n in (1, 2):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"b{n}"), F.col("bits").alias(f"m{n}")))
        digests = digests.join(side, F.expr(f"bitmap_bucket_number(c{n})") == F.col(f"b{n}"), "left")
    both = F.coalesce(_bit(F.col("m1"), F.expr("bitmap_bit_position(c1)")), F.lit(False)) & F.coalesce(
        _bit(F.col("m2"), F.expr("bitmap_bit_position(c2)")), F.lit(False)
    )
    probed = digests.select("_id", "_sha", both.alias("_maybe"))
    suspects = probed.where("_maybe").select("_id", "_sha")
    groups = (
        suspects.groupBy("_sha")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # a new key expression, so that the join shuffles both sides and a hot digest can be split
        .select(F.concat("_sha", F.lit(b"")).alias("_key"), "keep_id", "group_size")
    )
    repeated = suspects.join(groups, F.col("_sha") == F.col("_key")).select("_id", "_sha", "keep_id", "group_size")
    single = probed.where("NOT _maybe").select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return repeated.unionByName(single).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
