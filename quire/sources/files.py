"""Files as rows: whole documents with their content key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.store import content_key


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, file_key, content) of the files under a folder; without ``content`` selected, Spark still hashes it but keeps nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", content_key(F.col("content")).alias("file_key"), "content")


def failed_rows(df: DataFrame, result: str) -> DataFrame:
    """Adds status: "ok" or "failed" by whether a result is there, so that one bad row never fails a job."""
    return df.withColumn("status", F.when(F.col(result).isNull(), "failed").otherwise("ok"))
