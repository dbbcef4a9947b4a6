"""Pages of documents: kinds, runs of equal kind, sections by their headings, and what a section lacks.

Defined results. Null texts are empty. Pages are told by doc and page, which are unique. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sequence import forward_fill

#: What an appendix is called, and in how many first characters its label stands.
APPENDIX = "別紙"
LABEL_CHARACTERS = 300


def appendix_label(text: Column) -> Column:
    """The label of an appendix page (`別紙` and a number, perhaps with a part), digits and dashes made narrow; else null."""
    found = F.regexp_extract(F.substring(text, 1, LABEL_CHARACTERS), rf"({APPENDIX}\s*[0-9０-９]+(?:[-－][0-9０-９]+)?)", 1)
    return F.nullif(F.translate(T.half_digits(T.squash_space(found)), "－", "-"), F.lit(""))


def kind_by_prefix(label: Column, kinds: dict[str, str]) -> Column:
    """The kind of the first prefix that fits, in the order given."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(kinds.items()):
        out = F.when(label.startswith(prefix), kind).otherwise(out)
    return out


def page_kinds(pages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """doc, page, kind: a page without a label is of the kind of the last labelled page before it."""
    label = appendix_label(F.col("text"))
    # a label of no known kind ends the kind before it
    marked = pages.withColumn("_kind", F.when(label.isNotNull(), F.coalesce(kind_by_prefix(label, kinds), F.lit(""))))
    return forward_fill(marked, ["doc"], ["page"], F.col("_kind"), "kind").select("doc", "page", F.nullif("kind", F.lit("")).alias("kind"))


def page_ranges(kinds: DataFrame) -> DataFrame:
    """doc, kind, start, stop: closed runs of consecutive pages of a kind."""
    base = kinds.filter("kind is not null")
    w = Window.partitionBy("doc", "kind").orderBy("page")
    runs = base.withColumn("_base", F.col("page") - F.row_number().over(w))
    return runs.groupBy("doc", "kind", "_base").agg(F.min("page").alias("start"), F.max("page").alias("stop")).drop("_base")


#: Fixed values (patterns): a master's heading, and that of a sub-table.
MASTER_HEADING = r"(?U)^[（(]\s*[０-９0-9]+\s*[）)]\s*([^\s（(]+?マスター)"
TABLE_HEADING = r"(?U)^([アイウエオカキクケコサシスセソタチツテト])\s+(.+?テーブル.*?)$"


def page_lines(text: Column) -> Column:
    """The lines of a page layout: they end at a line feed, a carriage return, a form feed or Unicode's own separators."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def layout_lines(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """section, line_no, line of each section's pages in order. pages: doc, page, text. sections: doc, section, start, stop."""
    inside = pages.join(sections.select("doc", "section", "start", "stop"), "doc").filter(F.col("page").between(F.col("start"), F.col("stop")))
    lines = inside.select("doc", "section", "page", F.posexplode(page_lines(F.col("text"))).alias("at", "line"))
    number = F.row_number().over(Window.partitionBy("doc", "section").orderBy("page", "at")) - 1
    return lines.select("section", number.alias("line_no"), "line")


def headings(pages: DataFrame, ids: dict[str, str], with_tables: tuple[str, ...] = ()) -> DataFrame:
    """doc, page, pos, section, name, sub_name: the heading that each page begins a section with.

    It is the page's first line that is a heading of a known master (`ids`: name to id) or, while the last such master is one of
    `with_tables`, a heading of a sub-table; its section is the master's id and the sub-table's label. Which lines count depends
    on the pages before, so a document's pages with such lines are folded in order; there is a row for each of them.
    """
    lines = pages.select("doc", "page", F.posexplode(T.split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    known = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))
    master, label = F.regexp_extract("line", MASTER_HEADING, 1), F.regexp_extract("line", TABLE_HEADING, 1)
    found = lines.select("doc", "page", "pos", F.when(F.array_contains(F.lit(list(ids)), master), master).alias("master"), F.nullif(label, F.lit("")).alias("label"), F.nullif(F.trim(F.regexp_extract("line", TABLE_HEADING, 2)), F.lit("")).alias("table"))
    of_page = found.filter("master is not null or label is not null").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "master", "label", "table"))).alias("lines"))
    of_doc = of_page.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("pages"))
    kind = "struct<now:string,out:array<struct<page:int,pos:int,name:string,label:string,sub_name:string>>>"

    def step(state: Column, page: Column) -> Column:
        may = F.coalesce(state["now"].isin(*with_tables), F.lit(False)) if with_tables else F.lit(False)
        first = F.get(F.filter(page["lines"], lambda x: x["master"].isNotNull() | may), F.lit(0))
        now = F.coalesce(first["master"], state["now"])
        sub = first["master"].isNull()
        new = F.struct(page["page"].cast("int").alias("page"), first["pos"].alias("pos"), now.alias("name"), F.when(sub, first["label"]).alias("label"), F.when(sub, first["table"]).alias("sub_name"))
        return F.when(first.isNull(), state).otherwise(F.struct(now.alias("now"), F.concat(state["out"], F.array(new)).alias("out"))).cast(kind)

    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().alias("out")).cast(kind)
    rows = of_doc.select("doc", F.explode(F.aggregate("pages", start, step)["out"]).alias("r")).select("doc", "r.*")
    return rows.select("doc", "page", "pos", F.concat_ws("_", F.try_element_at(known, F.col("name")), "label").alias("section"), "name", "sub_name")


def sections(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """doc, section, start, stop: a section begins at the first page with its heading and ends before the next section; the
    last one ends before the first appendix page after it, or with the document.

    pages: doc, page, text. headings: doc, page, pos, section (what stands on a page, in order); only a page's first counts.
    """
    first = headings.groupBy("doc", "page").agg(F.min_by("section", "pos").alias("section"))
    starts = first.groupBy("doc", "section").agg(F.min("page").alias("start"))
    is_appendix = F.coalesce(T.first_line(F.col("text")).startswith(APPENDIX), F.lit(False))
    edges = pages.groupBy("doc").agg(F.max("page").alias("last"), F.collect_list(F.when(is_appendix, F.col("page"))).alias("appendix"))
    nxt = F.lead("start").over(Window.partitionBy("doc").orderBy("start"))
    out = starts.withColumn("_next", nxt).join(edges, "doc")
    after = F.array_min(F.filter("appendix", lambda p: p > F.col("start")))
    return out.select("doc", "section", "start", F.coalesce(F.col("_next") - 1, after - 1, "last").alias("stop"))


def recoverable(ranges: DataFrame, defects: DataFrame) -> DataFrame:
    """The ranges (section, lo, hi) of which at least half (one at least) is defective; adds `overlap`. defects: section, seq."""
    d = defects.select("section", "seq").distinct().groupBy("section").agg(F.collect_set("seq").alias("_seqs"))
    overlap = F.size(F.filter("_seqs", lambda s: s.between(F.col("lo"), F.col("hi"))))
    span = F.col("hi") - F.col("lo") + 1
    return ranges.join(d, "section").withColumn("overlap", overlap).filter(F.col("overlap") >= F.greatest(F.lit(1), F.floor(span / 2))).drop("_seqs")
