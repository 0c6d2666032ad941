import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.oracle import ORACLE_SQL
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, cols):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr(tuple(value(r[c]) for c in cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert got
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        cols = [d[0] for d in found.description]
        want = [dict(zip(cols, r)) for r in found.fetchall()]
        assert sorted(got[0]) == sorted(cols)
        assert plain(got, sorted(cols)) == plain(want, sorted(cols))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.streaming.noise import clean_stream

    rows = [(1, 1, 0, "Title"), (1, 1, 1, "body"), (1, 1, 2, "https://e.com")]
    spark.createDataFrame(rows, "doc_id long, page int, seq long, text string").write.parquet(str(tmp_path / "in"))
    titles = spark.createDataFrame([(1, "Title")], "doc_id long, title string")
    stream = spark.readStream.schema("doc_id long, page int, seq long, text string").parquet(str(tmp_path / "in"))
    q = clean_stream(stream, titles).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.text for r in spark.table("cleaned").select(F.col("text")).collect()] == ["body"]
