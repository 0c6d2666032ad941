"""From raw documents to packed training sequences, in five stages of the operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but for the last, returns the
columns of documents, further ones included. Null texts count as empty and null ids are kept throughout; rows that
repeat an id share its verdict. Empty texts score like any other and are copies of each other. Very long texts are
read whole. An empty table gives an empty result in every stage. ``run`` writes each stage's rows as Parquet and reads
them again, so that no stage works out the ones before it anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, packing, quality, simhash, toxicity
from quire.llm.common import fresh_name, write_and_read

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold; labels of the held-out fold are not learned from."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    return docs.where(toxicity.score(model, F.col("text")) < toxicity.THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(model, F.col("text")) >= quality.THRESHOLD)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``dropped``; null ids are never dropped."""
    key = fresh_name(docs, "_dropped")
    return docs.join(dropped.select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return _without(docs, exact_dedup.exact_dedup(docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return _without(docs, simhash.simhash_groups(docs).where("doc_id <> component_id"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: The learned stages, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
