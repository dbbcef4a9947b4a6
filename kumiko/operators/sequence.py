"""Order-dependent operators: gaps, fills, islands, bands, look-ahead. Each partitions by key columns, so no table is gathered.

Defined results. Null keys are a key of their own. Nulls in an order column come first; rows that tie in all order columns stand
in no fixed order, so give enough of them. Null numbers, starts and edges count as absent in gaps, islands and bands, and repeated
ones once. Empty tables give none. Columns that a table has besides are kept, or left out, as each function says; values on
the way take names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused


def _upto(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _gaps(df: DataFrame, keys: list[str], number: str, nxt: str) -> DataFrame:
    """The distinct numbers with the next one of their key in `nxt`."""
    w = Window.partitionBy(*keys).orderBy(number)
    return df.select(*keys, number).filter(F.col(number).isNotNull()).distinct().withColumn(nxt, F.lead(number).over(w))


def missing_numbers(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, lo, hi, expected and missing: the integers between least and largest `number` that don't occur, ascending."""
    runs = missing_runs(df, keys, number)
    return runs.select(*keys, "lo", "hi", "expected", F.flatten(F.transform("runs", lambda r: F.sequence(r["gap_from"], r["gap_to"]))).alias("missing"))


def missing_runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, lo, hi, expected, missing_count and runs: sorted structs (gap_from, gap_to) of the missing integers.

    A run is two numbers however long it is, so one stray large number costs nothing.
    """
    nxt = unused("next", df)
    gap = F.when(F.col(nxt) - F.col(number) > 1, F.struct((F.col(number) + 1).alias("gap_from"), (F.col(nxt) - 1).alias("gap_to")))
    found = _gaps(df, keys, number, nxt).groupBy(*keys).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"), F.array_sort(F.collect_list(gap)).alias("runs"))
    expected = F.col("hi") - F.col("lo") + 1
    return found.select(*keys, "lo", "hi", expected.alias("expected"), (expected - F.col("n")).alias("missing_count"), "runs")


def number_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, gap_from, gap_to: missing runs, found from neighbours alone (no arrays, for large groups)."""
    nxt = unused("next", df)
    return _gaps(df, keys, number, nxt).filter(F.col(nxt) - F.col(number) > 1).select(*keys, (F.col(number) + 1).alias("gap_from"), (F.col(nxt) - 1).alias("gap_to"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the last value that isn't null, up to the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def islands(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """keys, label, island (from 0 by start), n: maximal runs of rows with an equal label."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = unused("begins", df)
    new = df.withColumn(begins, F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    run = new.withColumn("island", F.sum(begins).over(_upto(keys, order)) - 1)
    return run.groupBy(*keys, "island", label).agg(F.count("*").alias("n"), *(F.min(c).alias(f"first_{c}") for c in order), *(F.max(c).alias(f"last_{c}") for c in order))


def number_islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, start, stop: closed intervals of consecutive integers."""
    w = Window.partitionBy(*keys).orderBy(number)
    base = unused("base", df)
    runs = df.select(*keys, number).filter(F.col(number).isNotNull()).distinct().withColumn(base, F.col(number) - F.row_number().over(w))
    return runs.groupBy(*keys, base).agg(F.min(number).alias("start"), F.max(number).alias("stop")).drop(base)


def end_from_next(df: DataFrame, keys: list[str], start: str, end: Column, step: Column, name: str = "stop", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`: the next row's start less `step`, or `end` for the last row."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    return df.withColumn(name, F.coalesce(F.lead(start).over(w) - step, end))


def bands(df: DataFrame, keys: list[str], edge: str, last: Column | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """keys, lo, hi: half-open bands between distinct edges; `last` closes the final band, else there is none."""
    w = Window.partitionBy(*keys).orderBy(edge)
    out = df.select(*keys, F.col(edge).alias("lo")).filter("lo is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("lo")
    hi = F.lead("lo").over(w)
    out = out.withColumn("hi", F.coalesce(hi, last) if last is not None else hi).filter(F.col("hi").isNotNull())
    size = F.col("hi") - F.col("lo")
    return out.filter((size >= least) & (size <= most) if most is not None else size >= least)


def continued(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "record") -> DataFrame:
    """Adds `name`: the number of the record that a row belongs to; a row that doesn't start one goes with the row before."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_upto(keys, order)))


def joined_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "\n", name: str = "text") -> DataFrame:
    """keys and the texts of each group, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), sep).alias(name))


def until_repeat(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows before the first one whose value has occurred already."""
    again = F.when(F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) > 1, 1).otherwise(0)
    mark, seen = unused("again", df), unused("seen", df)
    return df.withColumn(mark, again).withColumn(seen, F.max(mark).over(_upto(keys, order))).filter(F.col(seen) == 0).drop(mark, seen)


def look_ahead(df: DataFrame, keys: list[str], order: list[str], wanted: Column, value: Column, rows: int, name: str) -> DataFrame:
    """Adds `name`: the value of the first wanted row among the next `rows` rows, null if there is none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn(name, F.first(F.when(wanted, value), ignorenulls=True).over(w))


def first_after(df: DataFrame, keys: list[str], order: list[str], wanted: Column, value: Column, name: str) -> DataFrame:
    """Adds `name`: the value of the first wanted row after each row."""
    # from the end backwards it is the last one up to the row before, which a running window keeps
    back = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(wanted, value), ignorenulls=True).over(back))


def paired(df: DataFrame, keys: list[str], order: list[str], child: Column, name: str = "parent") -> DataFrame:
    """Adds `name`: for a child row, whether the row before can be its parent (isn't a child itself)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    mark = unused("child", df)
    return df.withColumn(mark, child).withColumn(name, F.col(mark) & F.coalesce(~F.lag(mark).over(w), F.lit(False))).drop(mark)


def occupancy(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The `n` most frequent values of the columns with their counts (n), ties in order of the values."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)
