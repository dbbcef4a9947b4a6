import json

from pyspark.sql import functions as F

from kumiko.operators import expand, groups, pages
from kumiko.sources import catalog, snapshot

FIELDS = "master_id string, field_pos int, seq int, name string, short_name string, mode string, max_bytes int, item_format string, description string, codes array<struct<code:string,name:string>>, flags map<string,string>"
SOURCE = {"kind": "master", "sourcePdf": "master_0_20260101.pdf", "sourceUrl": None, "sourceSha256": "x", "sourceVersion": "20260101"}


def test_round_trip(spark, tmp_path):
    root = str(tmp_path)
    rows = [("m", 1, 2, "two", None, "text", 3, None, "d", [("1", "x"), ("2", "y")], {"f": "1"}), ("m", 0, 1, "one\n改", "s", None, None, "固定", None, [], {}), ("k", 0, 7, "seven", None, None, None, None, None, None, None)]
    masters = spark.createDataFrame([(1, "k", "K", "sub", 4, 5), (0, "m", "M", None, 1, 3), (2, "e", "E", None, 6, 6)], "pos int, master_id string, master_name string, sub_name string, start int, stop int")
    fields = spark.createDataFrame(rows, FIELDS)
    raw = spark.createDataFrame([("m",), ("m",), ("m",)], "master_id string")
    stats = snapshot.section_stats(masters, raw, fields.withColumn("lineage", F.lit("table")))
    assert stats[0] == {"masterId": "m", "masterName": "M", "subName": None, "pages": {"start": 1, "end": 3}, "rawRecordCount": 3, "fieldCount": 2, "sourceCounts": {"table": 2}} and stats[2]["sourceCounts"] == {}
    assert snapshot.write_masters(spark, root, "20260101", masters, fields, SOURCE, stats, {"reader": "1"}) == 3
    got = catalog.fields(spark, root, "20260101").orderBy("master_id", "field_pos").collect()
    assert [(r["master_id"], r["seq"], r["name"], r["short_name"], r["max_bytes"], [tuple(c) for c in r["codes"]], r["flags"]) for r in got] == [("k", 7, "seven", None, None, [], None), ("m", 1, "one\n改", "s", None, [], None), ("m", 2, "two", None, 3, [("1", "x"), ("2", "y")], {"f": "1"})]
    assert json.loads((tmp_path / "20260101" / "sections.debug.json").read_text())[0]["rawRecordCount"] == 3
    assert "改" in (tmp_path / "20260101" / "m.json").read_text()

    tables = "pos int, table_id string, table_name string, kind string, pages array<struct<start:int,end:int>>, codes array<struct<code:string,name:string>>, groups array<struct<targetCode:string,targetName:string,sources:array<struct<code:string,name:string>>,note:string>>"
    pairs, merged = (0, "p", "P", "codeNamePairs", [(1, 2)], [("1", "x")], None), (1, "g", "G", "nayoseGroups", [(3, 3)], None, [("5", "t", [("1", "s")], "n"), ("6", "u", [], "")])
    source = {**SOURCE, "kind": "appendix", "sourcePdf": "master_2_20260101.pdf"}
    assert snapshot.write_code_tables(spark, root, "20260101", spark.createDataFrame([pairs, merged], tables), source) == []
    assert snapshot.write_code_tables(spark, root, "20260101", spark.createDataFrame([pairs], tables), source) == ["g.json"]
    assert sorted(x.name for x in (tmp_path / "20260101").glob("*.json")) == ["e.json", "k.json", "m.json", "manifest.json", "p.json", "sections.debug.json"]
    manifest = snapshot.read_manifest(spark, root, "20260101")
    # the other kind's entries and sources stay in place
    assert [m["masterId"] for m in manifest["masters"]] == ["m", "k", "e"] and [s["kind"] for s in manifest["sources"]] == ["master", "appendix"] and manifest["dependencies"] == {"reader": "1"}
    assert [(m["fieldCount"], m["subName"]) for m in manifest["masters"]] == [(2, None), (1, "sub"), (0, None)] and manifest["codeTables"][0]["rowCount"] == 1
    snapshot.put_source(manifest, {**SOURCE, "sourceSha256": "y"})
    assert [(s["kind"], s["sourceSha256"]) for s in manifest["sources"]] == [("master", "y"), ("appendix", "x")]

    snapshot.seed(spark, root, "20260201", "appendix")
    new = snapshot.read_manifest(spark, root, "20260201")
    assert new["version"] == "20260201" and new["codeTables"] == [] and len(new["masters"]) == 3 and [s["kind"] for s in new["sources"]] == ["master"]
    assert not (tmp_path / "20260201" / "p.json").exists() and catalog.fields(spark, root, "20260201").count() == 3
    snapshot.seed(spark, root, "20260201")  # there already
    assert snapshot.read_manifest(spark, root, "20260201")["codeTables"] == [] and snapshot.read_manifest(spark, root, "20270101") is None


WORDS = "doc string, page int, text string, x0 double, top double, bottom double"
RECTS = "doc string, page int, x0 double, x1 double, top double, height double"


def ruled_pages():
    """Two pages: on the second a group goes on before a new one; the source below a rule of the first page's last group."""
    words = [("d", 1, "コード", 62.0, 90.0, 100.0), ("d", 1, "コード", 62.0, 400.0, 410.0)]
    rects = []

    def rule(page, y, which):
        rects.append(("d", page, *((56.0, 98.0) if which == "t" else (206.0, 258.0)), y, 0.5))

    def word(page, x, y, text):
        words.append(("d", page, text, x, y, y + 8))

    for y in (101.5, 150.0, 200.0):
        rule(1, y, "t")
    for y in (101.5, 120.0, 150.0, 152.0, 180.0, 230.0):  # the last is too tall a row
        rule(1, y, "s")
    word(1, 60.0, 110.0, "８４９"), word(1, 110.0, 112.0, "second"), word(1, 110.0, 105.0, "first 1"), word(1, 430.0, 110.0, "note")
    word(1, 60.0, 160.0, "8001"), word(1, 110.0, 160.0, "B"), word(1, 60.0, 165.0, "8002")
    word(1, 210.0, 105.0, "12"), word(1, 265.0, 105.0, "src a"), word(1, 210.0, 130.0, "7x"), word(1, 210.0, 160.0, "3"), word(1, 270.0, 160.0, "src b")
    word(1, 60.0, 210.0, "12345")
    for y in (70.0, 130.0):
        rule(2, y, "t")
    for y in (70.0, 90.0, 130.0, 150.0):
        rule(2, y, "s")
    word(2, 110.0, 80.0, "more"), word(2, 430.0, 80.0, "extra"), word(2, 210.0, 75.0, "44"), word(2, 265.0, 75.0, "src c")
    word(2, 60.0, 135.0, "850"), word(2, 110.0, 135.0, "C"), word(2, 210.0, 135.0, "5"), word(2, 265.0, 135.0, "src d")
    return words, rects


def test_groups_go_on_over_pages(spark):
    words, rects = ruled_pages()
    pages_of = spark.createDataFrame([("d", 1, 300.0), ("d", 2, 300.0), ("d", 3, 300.0)], "doc string, page int, height double")
    w, r = spark.createDataFrame(words, WORDS), spark.createDataFrame(rects, RECTS)
    assert [(x["page"], x["body"]) for x in groups.body_starts(w, pages_of).orderBy("page").collect()] == [(1, 102.0), (2, 60.0), (3, 60.0)]
    got = groups.grouped_codes(w, r, pages_of).orderBy("group_pos").collect()
    assert [(x["target_code"], x["target_name"], [tuple(s) for s in x["sources"]], x["note"]) for x in got] == [
        ("849", "first1second", [("12", "srca")], "note"),
        ("8001", "Bmore", [("3", "srcb"), ("44", "srcc")], "extra"),
        ("850", "C", [("5", "srcd")], ""),
    ]
    again = [(d, 3, *rest) for d, p, *rest in rects if p == 2], [(d, 3, *rest) for d, p, *rest in words if p == 2]
    more = groups.grouped_codes(w.union(spark.createDataFrame(again[1], WORDS)), r.union(spark.createDataFrame(again[0], RECTS)), pages_of).orderBy("group_pos").collect()
    assert more[2]["target_name"] == "Cmore" and more[1]["target_name"] == "Bmore" and len(more) == 4
    assert groups.grouped_codes(w.limit(0), r, pages_of).count() == 0

    ranges = spark.createDataFrame([("d", "merged", 1, 2), ("d", "flat", 4, 5), ("d", "flat", 8, 8)], "doc string, kind string, start int, stop int")
    specs = spark.createDataFrame([(0, "flat", "f", "F", "codeNamePairs"), (1, "merged", "g", "G", "nayoseGroups"), (2, "none", "n", "N", "codeNamePairs")], "pos int, page_kind string, table_id string, table_name string, kind string")
    pairs = spark.createDataFrame([("d", "flat", 1, "2", "b"), ("d", "flat", 0, "1", "a")], "doc string, page_kind string, pos int, code string, name string")
    tables = groups.code_tables(ranges, specs, pairs, groups.grouped_codes(w, r, pages_of).withColumn("page_kind", F.lit("merged"))).orderBy("pos").collect()
    assert [(t["table_id"], [tuple(p) for p in t["pages"]]) for t in tables] == [("f", [(4, 5), (8, 8)]), ("g", [(1, 2)])]
    assert [c["code"] for c in tables[0]["codes"]] == ["1", "2"] and [g["targetCode"] for g in tables[1]["groups"]] == ["849", "8001", "850"]


def test_header_of_two_rows(spark):
    head, second = ["項 番", "項目名", None, "形式", None, None, "内容", "共通\n区分"], [None, None, None, "ﾓｰﾄﾞ", "最大ﾊﾞｲﾄ", "項目形式", None, None]
    tables = {0: [["title"] * 8, head, second, ["1", "a", "sub", "数字", "2", "固定", "text", " x "], [" ", None, "", "", "", "", "", "flag only"], ["2", "b"]], 1: [["項番", "項目名", "内容"], ["モードなし"], ["1", "n", "c"]], 2: [head, second], 3: [["項番", "項目名", "内容"], ["no", "mode", "here"], ["9", "n", "c"]]}
    cells = spark.createDataFrame([("d", 1, t, i, row) for t, rows in tables.items() for i, row in enumerate(rows)], "doc string, page int, table_no int, row_no int, cells array<string>")
    got = expand.field_rows(cells).orderBy("table_no", "row_no").collect()
    assert [(r["table_no"], r["seq_raw"], r["name"], r["sub_name"], r["mode_raw"], r["max_bytes_raw"], r["item_format_raw"], r["content"], r["flags"]) for r in got] == [
        (0, "1", "a", "sub", "数字", "2", "固定", "text", {"共通区分": "x"}), (0, "2", "b", "", "", "", "", "", {}), (1, "1", "n", "", "", "", "", "c", {}), (3, "9", "n", "", "", "", "", "c", {}),
    ]


def test_headings_and_lines(spark):
    ids = {"甲マスター": "ko", "乙マスター": "otsu"}
    texts = ["（１） 甲マスター（旧）\n（２） 乙マスター", "ア 基本テーブル", "(２)乙マスター\nア 基本テーブル", "イ 加算テーブル（注）\n（１）甲マスター", "（９） 丙マスター\nウ 別のテーブル", "（１）甲マスター", "エ 何かテーブル", None]
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc string, page int, text string")
    got = pages.headings(df, ids, ("乙マスター",)).orderBy("page").collect()
    assert [(r["page"], r["section"], r["name"], r["sub_name"]) for r in got] == [(1, "ko", "甲マスター", None), (3, "otsu", "乙マスター", None), (4, "otsu_イ", "乙マスター", "加算テーブル（注）"), (5, "otsu_ウ", "乙マスター", "別のテーブル"), (6, "ko", "甲マスター", None)]
    one = spark.createDataFrame([("a\fb\r\nc\u2028d\n\ne\n",), ("",), (None,), ("x",)], "t string").select(pages.page_lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in one] == [x.splitlines() for x in ("a\fb\r\nc\u2028d\n\ne\n", "", "", "x")]
    sections = spark.createDataFrame([("d", "s", 2, 3)], "doc string, section string, start int, stop int")
    assert [r["line"] for r in pages.layout_lines(df, sections).orderBy("line_no").collect()] == ["ア 基本テーブル", "(２)乙マスター", "ア 基本テーブル"]
