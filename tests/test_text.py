import random

from pyspark.sql import functions as F

from quire.functions import reflow, text


def values(spark, rows, col):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", col(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cjk_spacing(spark):
    cases = {
        "中 文": "中文", "中文  测试": "中文测试", "血压127": "血压 127", "127血压": "127 血压", "mmHg中文": "mmHg 中文", "abc   中文": "abc 中文",
        "abc   def": "abc def", "  中文  ": "中文", "血压120mmHg超标": "血压 120mmHg 超标", "": "",
    }
    assert values(spark, list(cases), text.cjk_spacing) == list(cases.values())


def test_cjk_spacing_is_idempotent(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("中文 a1-　\t。é🀄𠀀") for _ in range(30)) for _ in range(300)]
    once = values(spark, rows, text.cjk_spacing)
    assert values(spark, once, text.cjk_spacing) == once


def test_radicals_and_trim(spark):
    assert values(spark, ["⻋⼀⻰，ＡB", None], text.fix_radicals) == ["车一龙，ＡB", None]
    assert values(spark, ["　 a b \n", "\x1c"], text.trim_space) == ["a b", ""]
    assert values(spark, ["😀a", ""], text.utf16_length) == [3, 0]


def test_join_lines(spark):
    rows = [(["ab", "cd", "中", "文", "-", "x"],), (["", "a", ""],), ([],)]
    df = spark.createDataFrame(rows, "p array<string>")
    assert [r.v for r in df.select(text.join_lines(F.col("p")).alias("v")).collect()] == ["ab cd中文- x", "a", ""]


def test_tokens(spark):
    assert values(spark, ["我 love  Spark。"], text.tokens) == [["我", " ", "love", "  ", "Spark", "。"]]


def wrap(paragraph, width, other=0.55, space=0.3):
    return reflow.Wrapper(width, other, space).wrap(paragraph)


def test_reflow_goldens():
    fox = "the quick brown fox jumps over the lazy dog"
    assert wrap(fox, 10) == ["the quick brown fox", "jumps over the lazy", "dog"]
    assert wrap(fox, 10, 1.0, 1.0) == ["the quick", "brown fox", "jumps over", "the lazy", "dog"]
    assert wrap("我爱北京天安门我爱北京天安门", 5) == ["我爱北京天", "安门我爱北", "京天安门"]
    assert wrap("", 10) == [""] and wrap("   ", 10) == [""]
    long = wrap("a" + "b" * 40, 10)
    assert "".join(long) == "a" + "b" * 40 and len(long) > 1 and all(len(x) * 0.55 <= 10 for x in long)


def test_reflow_keeps_all_but_space():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("ab中 　文x\t") for _ in range(rng.randrange(60)))
        w = reflow.Wrapper(rng.randrange(2, 12), 0.55, 0.3)
        lines = w.wrap(p)
        assert "".join("".join(lines).split()) == "".join(p.split())
        assert all(w.measure(x) <= w.limit + 1e-4 for x in lines)


def test_reflow_document(spark):
    df = spark.createDataFrame([(["hello world", "second para"],), ([""],), ([],), (None,)], "p array<string>")
    got = [r.v for r in df.select(reflow.reflow_document(F.col("p"), 100).alias("v")).collect()]
    assert got == [["hello world", "", "second para"], [""], [], None]


def test_line_width(spark):
    df = spark.createDataFrame([(1000, 20), (1000, 40), (1000, 30), (1000, 0), (1000, -5), (5, 50)], "u int, c int")
    assert [r.v for r in df.select(reflow.line_width(F.col("u"), F.col("c")).alias("v")).collect()] == [50, 25, 33, 30, 30, 10]
