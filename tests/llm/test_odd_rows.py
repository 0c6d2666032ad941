"""Every operator and pipeline stage on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, exact_dedup, langid, licenses, packing, quality, rules, simhash, toxicity

LONG = "word other thing " * 40_000
TEXTS = [(1, None), (2, ""), (3, "Released under the MIT License."), (4, LONG), (4, LONG), (None, "Hello there you"), (None, None), (7, "a b c d e f"), (8, "A b c d e f"), (9, "½ ² Ⅷ")]
CLASHES = (
    "score predicted held_out text_sha256 keep_id kept group_size fingerprint component_id fp node root least key bin length piece start "
    "sequence_id license dice licenses n_matches n_words base_failed v p ids _copy _dropped _word _KEY"
).split()


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (3, 1, 0), (3, None, None), (4, 1, 1), (7, 1, 0), (8, 0, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "op1": lambda d, x: langid.language_id(d),
    "op2": lambda d, x: bpe.round_trip(d, BYTE),
    "op3": lambda d, x: toxicity.toxicity(d, x),
    "op4": lambda d, x: exact_dedup.exact_dedup(d),
    "op5": lambda d, x: simhash.simhash_groups(d),
    "op6": lambda d, x: quality.quality(d, x),
    "op9": lambda d, x: licenses.license_scan(d),
    "op10": lambda d, x: rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    rows = OPERATORS[name](documents(spark), labels(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # repeated rows share one result
    assert by[4][0] == by[4][1]
    if name in ("op3", "op6"):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows) and by[1][0].score == by[2][0].score
    elif name == "op1":
        assert {by[i][0].lang_pred for i in (1, 2, 9)} == {"und"}
    elif name == "op2":
        assert by[1][0].n_tokens == 0 and by[4][0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    elif name == "op4":
        assert (by[2][0].keep_id, by[2][0].group_size) == (2, 3) and by[7][0].keep_id == 8 and by[4][0].kept
    elif name == "op5":
        assert by[1][0].component_id == by[2][0].component_id == 1 and by[8][0].component_id == 7
    elif name == "op9":
        assert by[3][0].license == "MIT" and by[1][0].n_matches == 0
    elif name == "op10":
        assert by[1][0].n_words == 0 and by[4][0].n_words == 120_000 and not by[1][0].kept
    assert OPERATORS[name](documents(spark, []), labels(spark, [])).count() == 0


def test_packing_of_odd_rows(spark):
    rows = packing.pack(documents(spark), WORD).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in TEXTS}
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    whole = sum(r.length for r in rows if r.doc_id == 4)
    assert whole == 2 * (120_000 + 1) and max(r.length for r in rows) == packing.CAPACITY


def test_stages_on_odd_rows(spark, tmp_path):
    docs = documents(spark)
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        kept[name] = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    # of equal texts the largest id stays, of near copies the smallest; null ids are kept
    assert kept["exact_dedup"] == sorted(["2", "3", "4", "4", "8", "9", "None", "None"])
    assert {"1", "7"} <= set(kept["simhash_near_dedup"]) and not {"2", "8"} & set(kept["simhash_near_dedup"])


def test_run_cuts_between_stages(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    want = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, want, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in want.select("doc_id").collect()}
