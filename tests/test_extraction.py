import pytest
from pyspark.sql import functions as F

from kumiko.operators import layout, records, recover

RAW = "section string, pos long, seq_raw string, name string, sub_name string, mode_raw string, max_bytes_raw string, item_format_raw string, content string, flags map<string,string>"


def raw(spark, rows):
    return spark.createDataFrame([("s", i, *r, {}) for i, r in enumerate(rows)], RAW)


def lines(spark, texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "section string, line_no int, line string")


@pytest.mark.parametrize(
    "rows,want",
    [
        # a parent without a child: its name's lines are joined
        ([("1", "長い\n名", "", "数字", "3", "固定", "c")], [("1", "長い名", "", "数字", "3", "固定", "c")]),
        # a child takes what it lacks from its parent, and both texts
        (
            [("3", "親", "", "英数\nカナ", "9", "可変", "p"), ("", "", "a\nb", "", "(1)\n(2)", "", "q")],
            [("3", "親", "a", "英数カナ", "(1)", "可変", "p\nq"), ("3", "親", "b", "英数カナ", "(2)", "可変", "")],
        ),
        # numbers stacked in the parent
        ([("4\n5", "親", "", "", "", "", ""), ("", "", "a\nb", "数字", "1", "固定", "")], [("4", "親", "a", "数字", "1", "固定", ""), ("5", "親", "b", "数字", "1", "固定", "")]),
        # a range of two labels with two items each
        (
            [("10\n～\n13", "加算①～②", "", "", "", "", "p"), ("", "", "a\nb", "数字", "1", "固定", "")],
            [("10", "加算①", "a", "数字", "1", "固定", "p"), ("11", "加算①", "b", "数字", "1", "固定", ""), ("12", "加算②", "a", "数字", "1", "固定", ""), ("13", "加算②", "b", "数字", "1", "固定", "")],
        ),
        # a range that three items don't divide: its three tokens are used as they stand
        ([("10\n～\n13", "n", "", "", "", "", ""), ("", "", "a\nb\nc", "", "", "", "")], [("10", "n", "a", "", "", "", ""), ("～", "n", "b", "", "", "", ""), ("13", "n", "c", "", "", "", "")]),
        # the second child has no parent; neither has a leading one
        (
            [("", "", "x", "", "", "", ""), ("1", "n", "", "", "", "", ""), ("", "", "a", "", "", "", ""), ("", "", "y", "", "", "", "z")],
            [("", "", "x", "", "", "", ""), ("1", "n", "a", "", "", "", ""), ("", "", "y", "", "", "", "z")],
        ),
        # a multi-line row without a parent
        ([("8\n9", "", "a\nb", "数字", "1\n2", "固定", "c")], [("8", "", "a", "数字", "1", "固定", "c"), ("9", "", "b", "数字", "2", "固定", "")]),
    ],
)
def test_expanded(spark, rows, want):
    assert [tuple(r[c] for c in records.RAW) for r in records.expanded(raw(spark, rows)).orderBy("pos", "i").collect()] == want


def test_normalized(spark):
    rows = [("", "前", "", "", "", "", "lost"), ("1", "n", "s", "数字", "（２）", "固定", "1:a\n2:b"), ("", "", "", "", "", "", "more"), ("x", "", "", "", "", "", ""), ("2～3", "m", "", "?", "x", "", "")]
    got = records.normalized(raw(spark, rows)).orderBy("field_pos").collect()
    assert [(r["seq"], r["name"], r["short_name"], r["mode"], r["max_bytes"], r["item_format"], r["description"], len(r["codes"])) for r in got] == [
        (1, "n/s", "s", "numeric", 2, "固定", "1:a\n2:b\nmore", 2),
        (2, "m", None, "?", None, None, None, 0),
    ]
    assert records.normalized(raw(spark, [])).count() == 0


def test_text_records(spark):
    texts = ["項番  項 目 名", "グループ", " 1  薬価コ    数字  ９  固定  始め", "ード      続き", "  終わり", "", "lost", "12 親だけ", "- 3 -", None, "２ 名 英数カナ (3) 可変"]
    got = layout.text_records(lines(spark, texts)).orderBy("line_no").collect()
    assert [(r["seq"], r["name"], r["group"], r["mode_raw"], r["max_bytes_raw"], r["item_format_raw"], r["content"]) for r in got] == [
        (1, "薬価コード", "グループ", "数字", "9", "固定", "始め\n続き\n終わり"),
        (2, "名", "lost", "英数カナ", "(3)", "可変", ""),
    ]


@pytest.mark.parametrize(
    "texts,want",
    [
        (["100 加算①～④  ５２  本文", " ～ 続き", "111"], [(100, 111, "加算①～④", "52", "本文\n続き")]),
        (["10 名1～4", "x", "13"], [(10, 13, "名1～4", "", "x")]),  # near by, without a mark
        (["10 名1～4", "9"], []),  # smaller: no end
        (["10 名①～④", "～", "13 次"], [(10, 13, "名①～④", "", "")]),  # the next row is the end
        (["10 名①～④", "～", "20 次"], [(10, 19, "名①～④", "", "")]),
        (["10 名①～④", "～", "12 次"], [(10, 13, "名①～④", "", "")]),
        (["10 名①～②", "12 名①～③", "～", "14"], [(10, 14, "名①～②", "", "12 名①～③")]),  # a header among lines looked at doesn't count
        (["10 名①～②"] + ["x"] * 59 + ["20 名①～②", "～", "21"], [(20, 21, "名①～②", "", "")]),
    ],
)
def test_seq_ranges(spark, texts, want):
    assert [(r["lo"], r["hi"], r["name"], r["max_bytes"], r["description"]) for r in layout.seq_ranges(lines(spark, texts)).orderBy("range_no").collect()] == want


def test_sub_definitions(spark):
    texts = ["10 加算①～②  区分 数字 1 固定 頭", "長い説明がここにずっと続いています。", "親", "～ 点数 英数 (2) 可変", "13", "- 4 -", "   日付  数字  8  固定  年月日", "   区分  数字  1  固定", "   後  数字  1  固定"]
    at = lines(spark, texts)
    ranges = spark.createDataFrame([("s", 1, 10, 13)], "section string, range_no int, lo int, hi int")
    got = layout.sub_definitions(at, ranges).orderBy("sub_pos").collect()
    assert [(r["name"], r["mode_raw"], r["max_bytes_raw"], r["item_format_raw"], r["content"]) for r in got] == [
        ("区分", "数字", "1", "固定", "頭\n長い説明がここにずっと続いています。"),
        ("点数", "英数", "(2)", "可変", ""),
        ("日付", "数字", "8", "固定", "年月日"),
    ]
    beyond = lines(spark, texts[:1] + ["14 次"] + texts[6:])
    assert layout.sub_definitions(beyond, ranges).count() == 1


def test_extract_fields(spark):
    table = [("1", "一", "", "数字", "1", "固定", ""), ("", "", "a\nb", "数字\n漢字", "1\n2", "固定", "子"), ("9", "九", "", "数字", "1", "固定", ""), ("12", "", "", "", "", "", "")]
    # the child goes with row 1, as a page break would do it; ranges 3 to 6 and numbers 2, 7, 8, 10 to 12 have to be recovered
    texts = ["2 二 数字 4 固定 1:x", "2:y", "", "3 加算①～②", "～", "6", "", "12 末 漢字 3 可変"]
    got = recover.extract_fields(raw(spark, table), lines(spark, texts)).orderBy("field_pos").collect()
    assert [(r["seq"], r["name"], r["lineage"], r["mode"]) for r in got] == [
        (1, "一/a", "table", "numeric"), (1, "一/b", "table", "text"), (2, "二", "text", "numeric"),
        (3, "加算①/a", "range+text", "numeric"), (4, "加算①/b", "range+text", "text"), (5, "加算②/a", "range+text", "numeric"), (6, "加算②/b", "range+text", "text"),
        (9, "九", "table", "numeric"), (12, "末", "text", "text"),
    ]
    assert got[3]["description"] == "子" and got[4]["description"] is None and [c["code"] for c in got[2]["codes"]] == ["1", "2"]
    counts = recover.lineage_counts(spark.createDataFrame([(r["section"], r["lineage"]) for r in got], "section string, lineage string")).collect()[0]["counts"]
    assert counts == {"table": 3, "text": 2, "range+text": 4}


def test_other_tiers(spark):
    fields = [("1", "一", "", "数字", "1", "固定", ""), ("13", "原", "", "英数", "2", "可変", "")]
    texts = ["10 加算①～④ 説明", "～", "13", "", "2 印①～③", "～", "   区分  数字  1  固定  初", "   値  漢字  2  固定", "7", "   区分 数字 1 固定"]
    got = recover.extract_fields(raw(spark, fields), lines(spark, texts)).orderBy("field_pos").collect()
    assert [(r["seq"], r["name"], r["lineage"], r["description"]) for r in got] == [
        (1, "一", "table", None),
        (2, "印①/区分", "range+text-subs", "初"), (3, "印①/値", "range+text-subs", None), (4, "印②/区分", "range+text-subs", None), (5, "印②/値", "range+text-subs", None), (6, "印③/区分", "range+text-subs", None), (7, "印③/値", "range+text-subs", None),
        (10, "加算①/原", "range+template", "説明"), (11, "加算②/原", "range+template", None), (12, "加算③/原", "range+template", None), (13, "加算④/原", "range+template", None),
    ]
    assert recover.extract_fields(raw(spark, []), lines(spark, texts)).count() == 0
    assert recover.extract_fields(raw(spark, fields), lines(spark, [])).filter(F.col("lineage") != "table").count() == 0
