from pyspark.sql import functions as F

from kumiko.operators import pages


def test_kinds_and_ranges(spark):
    texts = ["cover", "別紙１０－２ a", "more", "別紙9 b", "別紙77", "tail", "別紙10-2 again"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc string, page int, text string")
    got = pages.page_kinds(df, {"別紙10": "ten", "別紙9": "nine"})
    assert [r["kind"] for r in got.orderBy("page").collect()] == [None, "ten", "ten", "nine", None, None, "ten"]
    assert sorted(tuple(r)[1:] for r in pages.page_ranges(got).collect()) == [("nine", 4, 4), ("ten", 2, 3), ("ten", 7, 7)]


def test_sections(spark):
    df = spark.createDataFrame([("d", i, "\n 別紙1" if i == 8 else "x") for i in range(1, 11)], "doc string, page int, text string")
    heads = spark.createDataFrame([("d", 2, 0, "a"), ("d", 2, 1, "b"), ("d", 3, 0, "a"), ("d", 5, 0, "b")], "doc string, page int, pos int, section string")
    assert sorted(tuple(r)[1:] for r in pages.sections(df, heads).collect()) == [("a", 2, 4), ("b", 5, 7)]


def test_recoverable(spark):
    ranges = spark.createDataFrame([("s", 1, 4), ("s", 5, 8), ("s", 9, 9), ("t", 1, 2)], "section string, lo int, hi int")
    defects = spark.createDataFrame([("s", 1), ("s", 2), ("s", 5), ("s", 9), ("s", 9)], "section string, seq int")
    assert sorted(map(tuple, pages.recoverable(ranges, defects).collect())) == [("s", 1, 4, 2), ("s", 9, 9, 1)]


def test_label(spark):
    row = spark.range(1).select(pages.appendix_label(F.lit("x" * 400 + "別紙1")), pages.appendix_label(F.lit("別紙 ３"))).collect()[0]
    assert tuple(row) == (None, "別紙3")
