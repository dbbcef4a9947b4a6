"""Rows out of rows: zipped lists, ranges of numbers, records out of table cells.

Defined results. Null cells are empty; a null list is as one without elements, and gives empty strings. Ranges that are null, empty
or not shared evenly give no rows. Of header cells that say the same the last one counts. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def zip_expand(df: DataFrame, lists: dict[str, Column], pos: str = "pos", once: dict[str, Column] | None = None) -> DataFrame:
    """One row for each place of the longest list; a shorter list repeats its last element; `once` columns stay on row 0."""
    width = F.greatest(F.lit(1), *(F.size(c) for c in lists.values())) if lists else F.lit(1)
    out = df.select("*", F.explode(F.sequence(F.lit(0), width - 1)).alias(pos))
    out = out.withColumns({n: T.pick_or_last(c, F.col(pos)) for n, c in lists.items()})
    return out.withColumns({n: F.when(F.col(pos) == 0, c) for n, c in (once or {}).items()})


def range_expand(df: DataFrame, lo: Column, hi: Column, k: Column) -> DataFrame:
    """Rows (cycle, sub, number) of a range that `k` sub-items share evenly: number = lo + cycle * k + sub; others stay out."""
    n = hi - lo + 1
    fit = df.filter((lo > 0) & (lo <= hi) & (k > 0) & (n % k == 0))
    cycles = fit.select("*", F.explode(F.sequence(F.lit(0), (n / k).cast("int") - 1)).alias("cycle"))
    return cycles.select("*", F.explode(F.sequence(F.lit(0), k - 1)).alias("sub")).withColumn("number", lo + F.col("cycle") * k + F.col("sub"))


#: What a header row says.
HEADER_WORDS = ("項番", "項目名", "内容")


def is_header(cells: Column, words: tuple[str, ...] = HEADER_WORDS) -> Column:
    """Whether all words stand in the row, white space aside."""
    flat = F.array_join(F.transform(cells, lambda c: T.squash_space(F.coalesce(c, F.lit("")))), "|")
    out = F.lit(True)
    for w in words:
        out = out & flat.contains(w)
    return out


def header_only(cells: Column, words: list[str]) -> Column:
    """Whether a row has some text and all of it is header words."""
    some = F.filter(F.transform(cells, lambda c: T.squash_space(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return (F.size(some) > 0) & F.forall(some, lambda c: c.isin(*words))


#: A header over several columns, and the columns of a second header row (as printed, in full width).
SPANNING = "形式"
SECOND = {"モード": "mode_raw", "最大バイト": "max_bytes_raw", "項目形式": "item_format_raw"}
FIRST = {"項番": "seq_raw", "項目名": "name", "内容": "content"}


def _wide(cell: Column) -> Column:
    """A header cell without white space, its words in full width."""
    out = T.squash_space(F.coalesce(cell, F.lit("")))
    for narrow, wide in (("ﾓｰﾄﾞ", "モード"), ("ﾊﾞｲﾄ", "バイト")):
        out = F.replace(out, F.lit(narrow), F.lit(wide))
    return out


def is_second_header(cells: Column) -> Column:
    return F.exists(F.transform(cells, _wide), lambda c: c.contains("モード"))


def _last_wins(entries: Column) -> Column:
    """A map of entries (k, v); of equal keys the last."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def two_row_map(first: Column, second: Column) -> Column:
    """column_map of a header of two rows; the column after the name is `sub_name` where the mode stands further on."""
    named = column_map(first, FIRST)
    pairs = F.create_map(*(F.lit(x) for kv in SECOND.items() for x in kv))
    below = F.transform(F.transform(second, _wide), lambda c, i: F.struct(F.try_element_at(pairs, c).alias("k"), i.alias("v")))
    both = F.map_concat(F.map_filter(named, lambda k, _: ~k.isin(*SECOND.values(), "sub_name")), _last_wins(F.filter(below, lambda e: e["k"].isNotNull())))
    name, mode = F.try_element_at(both, F.lit("name")), F.try_element_at(both, F.lit("mode_raw"))
    return F.when(mode > name + 1, F.map_concat(both, F.create_map(F.lit("sub_name"), name + 1))).otherwise(both)


def column_map(header: Column, names: dict[str, str]) -> Column:
    """map of our column names to 0-based places in a header row; other headers that aren't empty map to themselves."""
    flat = F.transform(header, lambda c: T.squash_space(F.coalesce(c, F.lit(""))))
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    entries = F.transform(flat, lambda c, i: F.struct(F.coalesce(F.try_element_at(pairs, c), c).alias("k"), i.alias("v")))
    return _last_wins(F.filter(entries, lambda e: (e["k"] != "") & (e["k"] != SPANNING)))


def row_record(cells: Column, places: Column, names: list[str]) -> Column:
    """struct of the named cells and `flags`, the map of all other header columns that hold something."""
    known = [F.coalesce(T.strip_u(F.get(cells, F.try_element_at(places, F.lit(n)))), F.lit("")).alias(n) for n in names]
    flags = F.map_filter(places, lambda k, _: ~k.isin(*names))
    filled = F.map_filter(F.transform_values(flags, lambda _, i: F.coalesce(T.strip_u(F.get(cells, i)), F.lit(""))), lambda _, v: v != "")
    return F.struct(*known, filled.alias("flags"))


def _first_header(cells: DataFrame, head: str, rows: str) -> DataFrame:
    w = Window.partitionBy("doc", "page", "table_no")
    found = F.min(F.when(is_header(F.col("cells")) & (F.col("row_no") < 3), F.col("row_no"))).over(w)
    return cells.withColumn(head, found).withColumn(rows, F.count("*").over(w)).filter(F.col(head).isNotNull() & (F.col(rows) >= 3))


def table_rows(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """Records of tables that have a header in one of their first three rows and three rows at least.

    cells: doc, page, table_no, row_no, cells. Rows without any text are left out.
    """
    w = Window.partitionBy("doc", "page", "table_no")
    known = _first_header(cells.select("doc", "page", "table_no", "row_no", "cells"), "_head", "_rows")
    header = F.max(F.when(F.col("row_no") == F.col("_head"), F.col("cells"))).over(w)
    body = known.withColumn("_header", header).filter("row_no > _head").filter(F.trim(F.array_join("cells", "")) != "")
    return body.select("doc", "page", "table_no", "row_no", row_record(F.col("cells"), column_map(F.col("_header"), names), list(names.values())).alias("r")).select("doc", "page", "table_no", "row_no", "r.*")


def field_rows(cells: DataFrame) -> DataFrame:
    """doc, page, table_no, row_no, seq_raw, name, sub_name, mode_raw, max_bytes_raw, item_format_raw, content and flags of tables
    with a header of two rows.

    The first row stands among a table's first three rows, the second is the next of these that names a mode, else the row
    after the first. Other headers are flags. Rows in which no named column holds anything are left out.
    """
    w = Window.partitionBy("doc", "page", "table_no")
    known = _first_header(cells.select("doc", "page", "table_no", "row_no", "cells"), "_head", "_rows")
    named = F.min(F.when((F.col("row_no") > F.col("_head")) & (F.col("row_no") < 3) & is_second_header(F.col("cells")), F.col("row_no"))).over(w)
    known = known.withColumn("_second", F.coalesce(named, F.col("_head") + 1))
    pick = lambda at: F.max(F.when(F.col("row_no") == F.col(at), F.col("cells"))).over(w)
    body = known.withColumns({"_top": pick("_head"), "_below": F.coalesce(pick("_second"), F.array().cast("array<string>"))}).filter("row_no > _second")
    columns = ["seq_raw", "name", "sub_name", *SECOND.values(), "content"]
    rows = body.select("doc", "page", "table_no", "row_no", row_record(F.col("cells"), two_row_map(F.col("_top"), F.col("_below")), columns).alias("r")).select("doc", "page", "table_no", "row_no", "r.*")
    return rows.filter(F.concat(*columns) != "")


def pairs_first_wins(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """code and name of each row that begins with a number; of equal codes of a table the first in document order."""
    from .lookup import first_of

    found = cells.select(table, "page", "table_no", "row_no", T.first_number_and_name(F.col("cells")).alias("p")).filter("p is not null")
    rows = found.select(table, "page", "table_no", "row_no", "p.code", "p.name")
    return first_of(rows, [table, "code"], ["page", "table_no", "row_no"])
