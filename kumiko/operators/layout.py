"""Records, ranges and definitions out of the lines of a page layout.

lines: section, line_no, line. A section is a run of pages of one document; all windows and groups are within a section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Modes and formats as printed, ends of names that a column break has cut, header marks.
MODES = ("数字", "英数カナ", "英数", "漢字", "カナ")
FORMATS = ("固定", "可変")
CUT_ENDS = ("グルー", "コ", "ロ", "プ", "判", "者", "ー", "グ")
HEADER_MARKS = ("形    式", "項 目 名")
LABEL_LENGTH, SUB_LABEL_LENGTH = 20, 15
#: How far a range's end is looked for, and how far without a range mark.
LOOK_AHEAD, LOOK_NEAR = 59, 5

_D = "[0-9０-９]"
_TAIL = rf"(\S.*?)\s+({'|'.join(MODES)})\s+(\({_D}+\)|{_D}+)\s+({'|'.join(FORMATS)})(?:\s+(.*))?$"
ROW = rf"(?Us)^\s*({_D}{{1,3}})\s+{_TAIL}"
SUB_ROW = rf"(?Us)^\s+{_TAIL}"
TILDE_ROW = rf"(?Us)^\s*[～〜~]\s*{_TAIL}"
NUMBERED = rf"(?U)^\s*({_D}{{1,3}})\s+\S"
NUMBER_AND_MORE = rf"(?U)^\s*({_D}+)\s+\S"
NUMBER_ALONE = rf"(?U)^\s*({_D}+)\s*$"
TILDE = r"(?U)^\s*[～〜~](\s|$)"
FOOTER = rf"(?U)^\s*-\s*{_D}+\s*-\s*$"
_LABEL = rf"(?:[{T.CIRCLED}]|{_D}{{1,2}})"
RANGE_HEADER = rf"(?Us)^\s*({_D}+)\s+(.+?{_LABEL}\s*[～〜~\-]\s*{_LABEL})(?:\s+({_D}+))?(.*)$"
FRAGMENT = r"(?U)^(\S{1,8})\s{2,}(\S.*)$"
NAME_FRAGMENT = r"^[぀-ヿ一-鿿・／]+$"


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return T.half_digits(F.regexp_extract(line, pattern, group)).try_cast("int")


def _upto() -> Window:
    return Window.partitionBy("section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def text_records(lines: DataFrame) -> DataFrame:
    """section, line_no, seq, name, group, mode_raw, max_bytes_raw, item_format_raw, content of lines that are whole rows.

    Other lines go on with the row before until an empty, header, footer or numbered line. A short line without a number
    that goes on with nothing names the group of the rows after it.
    """
    line = F.rtrim(F.coalesce("line", F.lit("")))
    bare = T.strip_u(line)
    ends = (bare == "") | bare.contains(HEADER_MARKS[0]) | bare.contains(HEADER_MARKS[1]) | (bare.startswith("-") & bare.endswith("-"))
    kinds = lines.select("section", "line_no", line.alias("line"), bare.alias("bare"), F.when(ends, "end").when(line.rlike(ROW), "row").when(line.rlike(NUMBERED), "end").otherwise("more").alias("kind"))
    opened = F.last(F.when(F.col("kind") != "more", F.col("kind")), ignorenulls=True).over(_upto())
    marked = kinds.withColumn("rec", F.sum((F.col("kind") == "row").cast("int")).over(_upto())).withColumn("open", F.coalesce(opened == "row", F.lit(False)))
    plain = ~F.col("bare").rlike("|".join(MODES + FORMATS) + r"|\p{Nd}") & (F.length("bare") <= LABEL_LENGTH)
    label = F.last(F.when((F.col("kind") == "more") & ~F.col("open") & plain, F.col("bare")), ignorenulls=True).over(_upto())
    kept = marked.withColumn("group", F.coalesce(label, F.lit(""))).filter("open and kind <> 'end'")
    row = F.struct("line_no", *(F.regexp_extract("line", ROW, i).alias(n) for i, n in enumerate(("seq", "name", "mode_raw", "max_bytes_raw", "item_format_raw", "content"), 1)), "group")
    records = kept.groupBy("section", "rec").agg(F.min_by(row, "line_no").alias("r"), F.array_sort(F.collect_list(F.when(F.col("kind") == "more", F.struct("line_no", "bare")))).alias("more"))

    def step(state: Column, x: Column) -> Column:
        fragment, rest = F.regexp_extract(x["bare"], FRAGMENT, 1), F.regexp_extract(x["bare"], FRAGMENT, 2)
        glued = state["name"].rlike(f"({'|'.join(CUT_ENDS)})$") & fragment.rlike(NAME_FRAGMENT)
        return F.struct(
            F.when(glued, F.concat(state["name"], fragment)).otherwise(state["name"]).alias("name"),
            T.strip_u(F.concat(state["content"], F.lit("\n"), F.when(glued, T.strip_u(rest)).otherwise(x["bare"]))).alias("content"),
        )

    done = F.aggregate("more", F.struct(T.strip_u(F.col("r.name")).alias("name"), T.strip_u(F.col("r.content")).alias("content")), step)
    return records.withColumn("d", done).select("section", "r.line_no", T.half_digits(F.col("r.seq")).cast("int").alias("seq"), "d.name", "r.group", "r.mode_raw", T.half_digits(F.col("r.max_bytes_raw")).alias("max_bytes_raw"), "r.item_format_raw", "d.content")


def _headers(lines: DataFrame) -> DataFrame:
    found = lines.withColumn("line", F.rtrim("line")).filter(F.col("line").rlike(RANGE_HEADER))
    part = lambda i: F.regexp_extract("line", RANGE_HEADER, i)
    return found.select("section", "line_no", T.half_digits(part(1)).cast("int").alias("lo"), T.strip_u(part(2)).alias("name"), T.half_digits(part(3)).alias("max_bytes"), T.strip_u(part(4)).alias("tail"))


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines with gapless places, so that the lines after a line are found by equality."""
    w = Window.partitionBy("section").orderBy("line_no")
    return lines.select("section", F.row_number().over(w).alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))


def seq_ranges(lines: DataFrame) -> DataFrame:
    """section, range_no (place of its header), lo, hi, name, max_bytes, description.

    A header is a number and a name that ends with a range of labels. Its end is looked for in the LOOK_AHEAD lines after it:
    a lone number (after a range mark, or near by and larger), or what the next numbered line implies. Search goes on after
    the lines looked at, so headers among them don't count.
    """
    placed = _numbered(lines)
    heads = _headers(placed)
    ahead = heads.select("section", F.col("line_no").alias("head"), F.explode(F.sequence(F.lit(1), F.lit(LOOK_AHEAD))).alias("off")).withColumn("line_no", F.col("head") + F.col("off"))
    after = ahead.join(placed, ["section", "line_no"]).groupBy("section", F.col("head").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("off", F.rtrim("line").alias("line")))).alias("after"))
    none = F.array().cast("array<struct<off:int,line:string>>")
    rows = heads.join(after, ["section", "line_no"], "left").withColumn("after", F.coalesce("after", none))
    lo, labels = F.col("lo"), T.label_count(F.col("name"))
    kind = "struct<tilde:boolean,hi:int,done:boolean,next:int,texts:array<string>>"

    def step(state: Column, x: Column) -> Column:
        line, bare = x["line"], T.strip_u(x["line"])
        rest = T.strip_u(F.regexp_replace(line, r"(?U)^\s*[～〜~]\s*", ""))
        alone, more = _number(line, NUMBER_ALONE), _number(line, NUMBER_AND_MORE)
        expected = lo + labels - 1
        implied = F.when((labels > 0) & (more <= expected), expected).otherwise(more - 1)
        add = lambda t: F.concat(state["texts"], F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>")))
        new = lambda tilde, hi, done, nxt, texts: F.struct(tilde.alias("tilde"), hi.alias("hi"), F.lit(done).alias("done"), nxt.alias("next"), texts.alias("texts")).cast(kind)
        no = F.lit(None).cast("int")
        return (
            F.when(state["done"], state)
            .when(line.rlike(TILDE), new(F.lit(True), no, False, x["off"] + 1, add(rest)))
            .when(alone.isNotNull() & (state["tilde"] | ((x["off"] <= LOOK_NEAR) & (alone > lo))), new(state["tilde"], alone, True, x["off"] + 1, state["texts"]))
            .when(more.isNotNull() & state["tilde"], new(state["tilde"], implied, True, x["off"], state["texts"]))
            .otherwise(new(state["tilde"], no, False, x["off"] + 1, add(bare)))
        )

    first = F.when(F.col("tail") != "", F.array("tail")).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(False).alias("tilde"), F.lit(None).cast("int").alias("hi"), F.lit(False).alias("done"), F.lit(1).alias("next"), first.alias("texts")).cast(kind)
    rows = rows.withColumn("s", F.aggregate("after", start, step)).drop("after")

    # headers are few; the chain of those that count is folded over their places alone
    places = rows.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("line_no", (F.col("line_no") + F.col("s.next")).alias("next")))).alias("all"))
    chain = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("kept")),
        lambda a, x: F.when(x["line_no"] >= a["next"], F.struct(x["next"].alias("next"), F.concat(a["kept"], F.array(x["line_no"])).alias("kept"))).otherwise(a),
    )
    counted = places.select("section", F.explode(chain["kept"]).alias("line_no"))
    return rows.join(counted, ["section", "line_no"]).filter("s.hi is not null").select("section", F.col("line_no").alias("range_no"), "lo", "s.hi", "name", "max_bytes", T.strip_u(F.array_join("s.texts", "\n")).alias("description"))


def boilerplate(bare: Column) -> Column:
    """Page footers and parts of a table's header, unless the line has a mode."""
    header = (bare.contains("項番") & bare.contains("項 目 名")) | bare.isin("形 式", "形    式", "ﾓｰﾄﾞ", "ﾊﾞｲﾄ", "ﾊﾞｲﾄ 形式") | (bare.contains("ﾓｰﾄﾞ") & (bare.contains("ﾊﾞｲﾄ") | bare.contains("形式")))
    return bare.rlike(FOOTER) | (header & ~bare.rlike("|".join(MODES)))


def sub_definitions(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """section, range_no, sub_pos (from 0), name, mode_raw, max_bytes_raw, item_format_raw, content: one cycle of the items that
    a range repeats.

    The cycle ends where a row names an item for the second time, or at a numbered line beyond the range.
    """
    placed = _numbered(lines)
    heads = _headers(placed)
    first = heads.groupBy("section", "lo").agg(F.min(F.struct("line_no", "tail")).alias("h"))
    begun = ranges.select("section", "range_no", "lo", "hi").join(first, ["section", "lo"])
    after = begun.join(placed, "section").filter("line_no > h.line_no").select("section", "range_no", "hi", "line_no", F.rtrim("line").alias("line"))
    head = begun.select("section", "range_no", "hi", F.col("h.line_no").alias("line_no"), F.concat(F.lit(" "), "h.tail").alias("line")).filter(F.col("line").rlike(SUB_ROW))
    bare = T.strip_u(F.col("line"))
    number = _number(F.col("line"), NUMBER_AND_MORE)
    tilde = F.col("line").rlike(TILDE)
    kind = (
        F.when((bare == "") | boilerplate(bare), "skip")
        .when(number > F.col("hi"), "stop")
        .when(number.isNotNull() | F.col("line").rlike(NUMBER_ALONE), "skip")
        .when(tilde & F.col("line").rlike(TILDE_ROW), "tilde")
        .when(tilde, "skip")
        .when(F.col("line").rlike(SUB_ROW), "sub")
        .when((F.length(bare) <= SUB_LABEL_LENGTH) & ~bare.rlike(r"\p{Nd}"), "skip")
        .otherwise("text")
    )
    rows = after.withColumn("kind", kind).unionByName(head.withColumn("kind", F.lit("sub"))).filter("kind <> 'skip'")
    part = lambda i: F.when(F.col("kind") == "tilde", F.regexp_extract("line", TILDE_ROW, i)).otherwise(F.regexp_extract("line", SUB_ROW, i))
    is_sub = F.col("kind").isin("sub", "tilde")
    rows = rows.withColumn("name", F.when(is_sub, part(1)))
    again = is_sub & (F.row_number().over(Window.partitionBy("section", "range_no", "name").orderBy("line_no")) > 1)
    w = Window.partitionBy("section", "range_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("again", again)
    over = F.max(((F.col("kind") == "stop") | (F.col("again") & (F.col("kind") == "sub"))).cast("int")).over(w)
    kept = rows.withColumn("over", over).filter("over = 0 and not again").withColumn("sub_pos", F.sum(is_sub.cast("int")).over(w) - 1).filter("sub_pos >= 0")
    found = F.struct("name", part(2).alias("mode_raw"), T.half_digits(part(3)).alias("max_bytes_raw"), part(4).alias("item_format_raw"), T.strip_u(part(5)).alias("content"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("line_no", T.strip_u(F.col("line")).alias("t"))))), lambda x: x["t"])
    out = kept.groupBy("section", "range_no", "sub_pos").agg(F.min_by(found, "line_no").alias("r"), texts.alias("texts"))
    return out.select("section", "range_no", "sub_pos", "r.name", "r.mode_raw", "r.max_bytes_raw", "r.item_format_raw", F.concat_ws("\n", F.nullif("r.content", F.lit("")), "texts").alias("content"))
