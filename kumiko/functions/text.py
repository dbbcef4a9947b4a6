"""Scalar text functions as Column -> Column; white space and digits are Unicode's unless a name says otherwise."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Full-width digits, circled digits, range marks.
WIDE_DIGITS = "０１２３４５６７８９"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
TILDES = "～〜~-"


def strip_u(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squash_space(x: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def half_digits(x: Column) -> Column:
    return F.translate(x, WIDE_DIGITS, "0123456789")


def wide_digits(x: Column) -> Column:
    return F.translate(x, "0123456789", WIDE_DIGITS)


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; meant for building key columns once, not for queries."""
    return x.str.normalize("NFKC")


def code_key(x: Column) -> Column:
    """The key that codes are compared by: NFKC, ends stripped."""
    return strip_u(nfkc(x))


def flat_key(x: Column) -> Column:
    """NFKC without any white space."""
    return squash_space(nfkc(x))


def appendix_code(x: Column) -> Column:
    """White space out, then NFKC, then digits to half width."""
    return half_digits(nfkc(squash_space(x)))


def _digit_class() -> str:
    """A Java character class of all digits, as Unicode's numeric types have them (circled and raised ones, but no fractions)."""
    from itertools import groupby

    found = [i for i in range(sys.maxunicode + 1) if chr(i).isdigit()]
    runs = [[i for _, i in run] for _, run in groupby(enumerate(found), lambda x: x[1] - x[0])]
    return "[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs) + "]"


DIGIT = _digit_class()


def all_digits(x: Column, least: int = 1, most: int | None = None) -> Column:
    """Whether a text is digits alone, of any script and form."""
    return F.coalesce(x.rlike(f"^{DIGIT}{{{least},{'' if most is None else most}}}$"), F.lit(False))


def literal_pattern(keyword: str) -> str:
    """A Java pattern that finds `keyword` as it stands, in any case."""
    return "(?iu)\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_keyword(x: Column, keyword: str) -> Column:
    """Whether the text has the keyword, in any case."""
    if keyword.isascii() and not {"k", "s", "i"} & set(keyword.lower()):  # no letter beyond ASCII folds to these
        return F.coalesce(F.contains(F.lower(x), F.lit(keyword.lower())), F.lit(False))
    return F.coalesce(x.rlike(literal_pattern(keyword)), F.lit(False))


def snippet(text: Column, keyword: str, width: int = 60) -> Column:
    """The keyword's first place with half of `width` characters on each side; dots where text was cut.

    Line feeds become spaces. A keyword with a space may so be found across lines; others are looked up in the text as it is.
    """
    half = width // 2
    flat = (lambda x: F.translate(x, "\n", " "))
    at = F.locate(keyword.lower(), F.lower(flat(text) if " " in keyword else text)) - 1
    start = F.greatest(at - half, F.lit(0))
    stop = F.least(F.length(text), at + len(keyword) + half)
    found = F.concat(F.when(start > 0, "…").otherwise(""), strip_u(flat(F.substr(text, start + 1, stop - start))), F.when(stop < F.length(text), "…").otherwise(""))
    head = F.concat(strip_u(flat(F.substring(text, 1, width))), F.when(F.length(text) > width, "…").otherwise(""))
    return F.when(at < 0, head).otherwise(found)


def split_lines(x: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(x, "\n"), strip_u), lambda s: s != "")


def first_line(x: Column) -> Column:
    return F.get(split_lines(x), F.lit(0))


def joined_modes(lines: Column, suffix: str = "カナ") -> Column:
    """Lines where one that is only `suffix` is joined to the line before."""
    step = lambda out, s: F.when((s == suffix) & (F.size(out) > 0), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.get(out, F.size(out) - 1), s)))).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(lines, F.array().cast("array<string>"), step)


def range_of(x: Column) -> Column:
    """struct(lo, hi) of the first `N~M` in a text with 0 < N <= M, else null."""
    pattern = rf"(?U)(\d+)\s*[{TILDES}]\s*(\d+)"
    lo, hi = (F.regexp_extract(half_digits(x), pattern, i).try_cast("int") for i in (1, 2))
    return F.when((lo > 0) & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def _circled_number(c: Column) -> Column:
    return F.when(c != "", F.instr(F.lit(CIRCLED), c))


def _label_ends(x: Column) -> tuple[Column, Column, Column, Column]:
    text = half_digits(x)
    circled, plain = rf"(?U)([{CIRCLED}])\s*[{TILDES}]\s*([{CIRCLED}])", rf"(?U)(\d+)\s*[{TILDES}]\s*(\d+)"
    return (
        _circled_number(F.regexp_extract(text, circled, 1)),
        _circled_number(F.regexp_extract(text, circled, 2)),
        F.regexp_extract(text, plain, 1).try_cast("int"),
        F.regexp_extract(text, plain, 2).try_cast("int"),
    )


def label_count(x: Column) -> Column:
    """How many labels a notation like ①～⑩ or 1～10 stands for; 0 if it has none."""
    c1, c2, p1, p2 = _label_ends(x)
    plain = F.when(p1 < p2, p2 - p1 + 1)
    return F.coalesce(F.when(c1.isNotNull(), F.greatest(c2 - c1 + 1, F.lit(0))).otherwise(plain), F.lit(0))


def group_labels(x: Column, expected: Column) -> Column:
    """The labels, if there are `expected` of them, else an empty array; circled ones decide alone."""
    c1, c2, p1, p2 = _label_ends(x)
    none = F.array().cast("array<string>")
    circled = F.when((c1 <= c2) & (c2 - c1 + 1 == expected), F.transform(F.sequence(c1, F.greatest(c1, c2)), lambda i: F.substr(F.lit(CIRCLED), i, F.lit(1)))).otherwise(none)
    plain = F.when((p1 < p2) & (p2 - p1 + 1 == expected), F.transform(F.sequence(p1, F.greatest(p1, p2)), lambda i: i.cast("string"))).otherwise(none)
    return F.when(c1.isNotNull() & c2.isNotNull(), circled).otherwise(plain)


def without_labels(x: Column) -> Column:
    return strip_u(F.regexp_replace(F.regexp_replace(x, rf"(?U)[{CIRCLED}]\s*[{TILDES}]\s*[{CIRCLED}]", ""), rf"(?U)[0-9０-９]+\s*[{TILDES}]\s*[0-9０-９]+", ""))


def pick_or_last(items: Column, i: Column) -> Column:
    """Element `i` (0-based), else the last, else the empty string."""
    return F.coalesce(F.try_element_at(items, i + 1), F.try_element_at(items, F.lit(-1)), F.lit(""))


def leading_int(x: Column) -> Column:
    return F.nullif(F.regexp_extract(half_digits(strip_u(x)), r"^(\d+)", 1), F.lit("")).try_cast("int")


def byte_size(x: Column) -> Column:
    """struct(size, sub, raw): `(n)` is a sub-item's size, `n` a size, anything else stays raw."""
    text = half_digits(strip_u(x))
    sub = text.rlike(r"^[(（]\d+[)）]$")
    plain = text.rlike(r"^\d+$")
    return F.struct(F.when(sub | plain, F.regexp_extract(text, r"(\d+)", 1).try_cast("int")).alias("size"), F.coalesce(sub, F.lit(False)).alias("sub"), F.when(~(sub | plain), x).alias("raw"))


#: Field modes by their printed name.
MODES = {"数字": "numeric", "英数": "alphanumeric", "漢字": "text", "英数カナ": "alphanumeric", "カナ": "text"}


def mode_of(x: Column, modes: dict[str, str] | None = None) -> Column:
    """The mode's name; an unknown one passes through, an empty one is null."""
    pairs = F.create_map(*(F.lit(v) for kv in (modes or MODES).items() for v in kv))
    return F.nullif(F.coalesce(F.try_element_at(pairs, x), x), F.lit(""))


def composite_name(name: Column, sub_name: Column) -> Column:
    return F.concat_ws("/", F.nullif(name, F.lit("")), F.nullif(sub_name, F.lit("")))


def first_number_and_name(cells: Column) -> Column:
    """struct(code, name): the first all-digit cell and the first cell after it that isn't empty."""
    flat = F.transform(cells, lambda c: squash_space(F.coalesce(c, F.lit(""))))
    at = F.array_position(F.transform(flat, lambda c: half_digits(c).rlike(r"^\d+$")), F.lit(True)).cast("int")
    rest = F.filter(F.slice(flat, at + 1, F.size(flat)), lambda c: c != "")
    return F.when(at > 0, F.struct(half_digits(F.get(flat, at - 1)).alias("code"), F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("name")))


def kind_from_file(name: Column) -> Column:
    """master or appendix by the number in `master_<n>_<yyyymmdd>.pdf`, else null."""
    n = F.regexp_extract(name, r"master_(\d+)_\d{8}\.pdf", 1)
    return F.when(n.isin("0", "1"), "master").when(n == "2", "appendix")


def version_from_file(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit("")), F.lit("unknown"))


def safe_cell(cells: Column, i: Column | int) -> Column:
    """Cell `i` (0-based), stripped; the empty string where there is none."""
    return F.coalesce(strip_u(F.get(cells, F.lit(i) if isinstance(i, int) else i)), F.lit(""))


#: Fixed value (pattern): codes are one to three letters or digits before a colon, in either width; a name follows.
CODE_LINE = r"(?U)^([0-9A-Za-z０-９Ａ-Ｚａ-ｚ]{1,3})[:：]\s*(\S.*)$"
WIDE_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, and (as patterns) the beginnings of lines that explain instead of going on with a name.
SENTENCE_ENDS = ("。", "．")
EXPLANATIONS = (
    "[「『（(＜<※]", "なお", "また", "ただし", "ただ", "その", "さらに", "そして", "つまり", "したがって", "これらの",
    r"注\s", "注[0-9０-９]", "項番", "漢字[:：]", "半角", "全角", "該当", "対象", "コメント", "点数", "金額", "詳細",
    r"例\s", "例[0-9０-９]", "未使用", "使用しない", "設定", "算定", "以下の", "以上の", "任意",
    "参照", "参考", "備考", "出力", "入力", "記載", "記録", "返戻",
)
LONGEST_NAME = 80


def code_lines(text: Column) -> Column:
    """array<struct(code, name)> of the code lines in a text, by one fold over its lines.

    A code line opens a name; following lines go on with it until an empty line, an end of sentence, an explanation or a name
    of LONGEST_NAME characters. Fewer than two codes are none.
    """
    kind = "struct<open:boolean,out:array<struct<code:string,name:string>>>"
    head = F.regexp_extract

    def step(state: Column, line: Column) -> Column:
        code, rest = head(line, CODE_LINE, 1), head(line, CODE_LINE, 2)
        out = state["out"]
        last = F.try_element_at(out, F.lit(-1))
        stop = (line == "") | F.coalesce(last["name"].rlike("[" + "".join(SENTENCE_ENDS) + "]$"), F.lit(False)) | line.rlike("(?U)^(" + "|".join(EXPLANATIONS) + ")") | (F.coalesce(F.length(last["name"]), F.lit(0)) >= LONGEST_NAME)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["code"].alias("code"), F.concat(last["name"], line).alias("name"))))
        return (
            F.when(code != "", F.struct(F.lit(True).alias("open"), F.concat(out, F.array(F.struct(half_digits(F.translate(code, WIDE_LETTERS, NARROW_LETTERS)).alias("code"), rest.alias("name")))).alias("out")))
            .when(~state["open"], state)
            .when(stop, F.struct(F.lit(False).alias("open"), out.alias("out")))
            .otherwise(F.struct(F.lit(True).alias("open"), longer.alias("out")))
        ).cast(kind)

    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<code:string,name:string>>").alias("out")).cast(kind)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip_u)
    found = F.aggregate(lines, start, step, lambda s: s["out"])
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<struct<code:string,name:string>>"))
