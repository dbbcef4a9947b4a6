import pytest
from pyspark.sql import functions as F

from kumiko.functions import text as T
from kumiko.operators import expand, quality, sequence, spatial, versioning
from kumiko.sources import catalog


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (T.strip_u, "　a b　", "a b"), (T.squash_space, "a　 b\n", "ab"), (T.half_digits, "１2３", "123"), (T.code_key, " ｱ１ ", "ア1"),
        (T.leading_int, "１２ 項", 12), (T.leading_int, "項", None), (T.without_labels, "名①～③", "名"), (T.first_line, "\n \n a \nb", "a"),
        (T.mode_of, "数字", "numeric"), (T.mode_of, "other", "other"), (T.mode_of, "", None),
        (T.kind_from_file, "master_2_20260501.pdf", "appendix"), (T.version_from_file, "x.pdf", "unknown"), (T.label_count, "①～⑤", 5), (T.label_count, "1〜10", 10), (T.label_count, "⑨ ～ ⑫", 4), (T.label_count, "3～3", 0), (T.label_count, "x", 0),
    ],
)
def test_scalars(one, f, given, want):
    assert one(f(F.lit(given))) == want


def test_ranges_labels_sizes(one):
    assert tuple(one(T.range_of(F.lit("１０～17")))) == (10, 17)
    assert one(T.range_of(F.lit("72\n～\n81")))[1] == 81 and one(T.range_of(F.lit("17～10"))) is None and one(T.range_of(F.lit("0～3"))) is None
    assert one(T.group_labels(F.lit("②～④"), F.lit(3))) == ["②", "③", "④"]
    assert one(T.group_labels(F.lit("①～③ 1～2"), F.lit(2))) == []  # circled ones decide
    assert tuple(one(T.byte_size(F.lit("（１２）")))) == (12, True, None) and tuple(one(T.byte_size(F.lit("可変")))) == (None, False, "可変")
    assert one(T.pick_or_last(F.array(F.lit("a"), F.lit("b")), F.lit(5))) == "b" and one(T.pick_or_last(F.array().cast("array<string>"), F.lit(0))) == ""
    assert one(T.joined_modes(F.array(F.lit("英数"), F.lit("カナ"), F.lit("x")))) == ["英数カナ", "x"]
    assert tuple(one(T.first_number_and_name(F.array(F.lit("x"), F.lit("１２"), F.lit(""), F.lit("n"))))) == ("12", "n")


def test_snippet_and_keyword(one):
    text = F.lit("a" * 40 + " KEY\n" + "b" * 40)
    assert one(T.snippet(text, "key")) == "…" + "a" * 29 + " KEY " + "b" * 29 + "…"
    assert one(T.snippet(F.lit("none"), "key")) == "none"
    assert one(T.contains_keyword(F.lit("ＡＢ.c"), "ａｂ.")) and not one(T.contains_keyword(F.lit("abxc"), "b."))


@pytest.mark.parametrize(
    "text,want",
    [
        ("1:a\n2:b", [("1", "a"), ("2", "b")]),
        ("1:a", []),
        ("１：a\n続き\n\nlost\n2:b。\nlost", [("1", "a続き"), ("2", "b。")]),
        ("Ａ1： a\n2:\n注意\n3：b\n例1", [("A1", "a2:注意"), ("3", "b")]),
        ("1:a\n※ note\n2:b", [("1", "a"), ("2", "b")]),
        ("1:" + "n" * 80 + "\nlost\n2:b", [("1", "n" * 80), ("2", "b")]),
    ],
)
def test_code_lines(one, text, want):
    assert [tuple(x) for x in one(T.code_lines(F.lit(text)))] == want


@pytest.mark.parametrize("n,missing,severity", [(100, 19, "warning"), (101, 20, "error"), (10, 2, "error"), (11, 2, "warning")])
def test_missing_thresholds(spark, n, missing, severity):
    rows = [("m", i) for i in range(1, n + 1) if not 1 < i <= missing + 1]
    got = quality.missing_issues(spark.createDataFrame(rows, "k string, seq int"), ["k"], "seq").collect()[0]
    assert (got["missing_count"], got["severity"]) == (missing, severity)


def test_pairs_and_islands(spark):
    rows = [("d", i, c) for i, c in enumerate([False, True, True, False, True])]
    got = sequence.paired(spark.createDataFrame(rows, "d string, pos int, child boolean"), ["d"], ["pos"], F.col("child")).orderBy("pos").collect()
    assert [r["parent"] for r in got] == [False, True, False, False, True]
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 3)], "kind string, page int")
    assert sorted(map(tuple, sequence.number_islands(pages, ["kind"], "page").collect())) == [("a", 1, 2), ("a", 5, 5), ("b", 3, 3)]


def test_band_edges(spark):
    bands = spark.createDataFrame([("p", 0.0, 10.0), ("p", 10.0, 20.0)], "page string, lo double, hi double")
    points = spark.createDataFrame([("p", 10.0), ("p", 20.0), ("p", -1.0)], "page string, at double")
    assert [tuple(r) for r in spatial.band_join(points, bands, ["page"], "at").collect()] == [("p", 10.0, 10.0, 20.0)]


def test_table_rows(spark):
    cells = [("d", 1, 0, 0, ["項番", "項目名", "内容", "必須"]), ("d", 1, 0, 1, ["1", " n ", "c", "○"]), ("d", 1, 0, 2, [None, "", " ", None]), ("d", 1, 1, 0, ["x"])]
    got = expand.table_rows(spark.createDataFrame(cells, "doc string, page int, table_no int, row_no int, cells array<string>"), {"項番": "seq", "項目名": "name", "内容": "content"}).collect()
    assert [(r["seq"], r["name"], r["content"], r["flags"]) for r in got] == [("1", "n", "c", {"必須": "○"})]


def test_replace_and_seed(spark):
    fields = spark.createDataFrame([(1, "a"), (2, ""), (2, "kept")], "seq int, name string")
    new = spark.createDataFrame([(2, "found")], "seq int, name string")
    got = versioning.replace_recovered(fields, new, ["seq"], F.col("name") == "").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "found"), (2, "kept")]
    rows = spark.createDataFrame([("1", "k"), ("2", "k")], "version string, kind string")
    assert versioning.seed_snapshot(rows, "version", "1", "2", F.lit(True)).count() == 0


def test_manifests_of_both_shapes(spark, tmp_path):
    for version, body in (("20260101", '{"version": "20260101", "sourcePdf": "m_20251231.pdf", "sourceSha256": "x", "masters": []}'), ("20260201", '{"version": "20260201", "sources": [{"kind": "master", "sourcePdf": "a"}], "masters": [{"masterId": "m", "masterName": "N", "subName": "S", "fieldCount": 1}]}')):
        (tmp_path / version).mkdir()
        (tmp_path / version / "manifest.json").write_text(body)
    (tmp_path / "20260201" / "m.json").write_text('{"masterId": "m", "fields": [{"seq": 1, "name": "f", "codes": [{"code": "０1", "name": "c"}]}]}')
    m = catalog.manifests(spark, str(tmp_path))
    assert [(r["snapshot"], r["kind"], r["sourceVersion"]) for r in catalog.sources(m).orderBy("snapshot").collect()] == [("20260101", "master", "20251231"), ("20260201", "master", None)]
    assert catalog.masters(m).collect()[0]["title"] == "N / S"
    assert [(r["code"], r["code_norm"]) for r in catalog.codes(catalog.fields(spark, str(tmp_path))).collect()] == [("０1", "01")]
