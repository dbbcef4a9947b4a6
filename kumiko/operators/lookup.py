"""Catalogue listings, point lookups, code lookups in both directions, nearest keys, limits.

Defined results. Null names and sub-names are left out of titles. A null key equals no wanted one; in `first_of` null keys are one
key. Rows that tie in all order columns have no fixed first. Empty tables give no rows (`limited`: total counts none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused


def latest(df: DataFrame, version: str = "version") -> DataFrame:
    """The rows of the largest version, which is found first, so that a partitioned table is pruned by it."""
    top = df.agg(F.max(version)).collect()[0][0]
    return df.filter(F.col(version).eqNullSafe(F.lit(top)))


def listing(df: DataFrame, name: str, sub_name: str, sep: str = " / ") -> Column:
    return F.concat_ws(sep, F.col(name), F.nullif(F.col(sub_name), F.lit("")))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    n = unused("n", df)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def all_of(df: DataFrame, key: str, wanted) -> DataFrame:
    """All rows of a key, in the table's order."""
    return df.filter(F.col(key) == F.lit(wanted))


def with_children(df: DataFrame, children: DataFrame, key: str, of: str, name: str = "has_children") -> DataFrame:
    """Adds `name`: whether the row has a child. Children are made distinct before they are shuffled, not counted."""
    mark, at = unused("mark", df, children), unused("of", df)
    there = children.select(F.col(of).alias(at)).filter(F.col(at).isNotNull()).distinct().withColumn(mark, F.lit(True))
    return df.join(there, df[key] == there[at], "left").select(*(df[c] for c in df.columns), F.coalesce(mark, F.lit(False)).alias(name))


def pair_lookup(pairs: DataFrame, code: str, wanted) -> DataFrame:
    """The pairs of a code, with match = 'code'."""
    return pairs.filter(F.col(code) == F.lit(wanted)).withColumn("match", F.lit("code"))


def nearest(df: DataFrame, key: str, wanted: int, n: int = 5) -> DataFrame:
    """The `n` distinct keys nearest to `wanted`, ties to the smaller."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.abs(F.col(key) - wanted), key).limit(n)


def limited(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first `n` rows with the table's row count (total) and whether rows were cut (truncated); n <= 0 or None: all."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(n) if n and n > 0 else df
    return rows.join(F.broadcast(total)).withColumn("truncated", F.lit(bool(n and n > 0)) & (F.col("total") > (n or 0)))


def code_lookup(fields: DataFrame, codes: DataFrame, keys: list[str], number: str, wanted: int, code: str) -> DataFrame:
    """All codes equal to `code` (by code_norm) of the first field with that number; later fields of the number don't count."""
    first = first_of(fields.filter(F.col(number) == wanted), [k for k in keys if k != "field_pos"], ["field_pos"])
    return codes.filter(F.col("code_norm") == code).join(first.select(*keys), keys, "left_semi")


def group_lookup(groups: DataFrame, sources: DataFrame, group: str, code: Column, codes: DataFrame | None = None) -> DataFrame:
    """group, match and source: groups that have the code as their target, else as a source; one hit a group, the target first.

    groups: group, target_code; sources: group, code and, if there are, pos and name, of which `source` tells the first that
    matches (null for a target). `codes`: a table of wanted codes (column `wanted`), or None for `code`.
    """
    rest = [c for c in ("pos", "code", "name") if c in sources.columns]
    key = [group] if codes is None else ["wanted", group]
    if codes is None:
        target, source = groups.filter(F.col("target_code") == code), sources.filter(F.col("code") == code)
    else:
        target, source = groups.join(codes, F.col("target_code") == F.col("wanted")), sources.join(codes, F.col("code") == F.col("wanted"))
    first = source.groupBy(*key).agg(F.min(F.struct(*rest)).alias("source"))
    hits = target.select(*key, F.lit("target").alias("match"))
    return hits.withColumn("source", F.lit(None).cast(first.schema["source"].dataType)).unionByName(first.withColumn("match", F.lit("source")).join(hits.select(*key), key, "left_anti"))
