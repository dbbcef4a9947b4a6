"""Keyword search over several corpora with one hit schema.

Defined results. The keyword is literal and its case doesn't matter. Null and empty texts never match. Hits stand in the order of
the documents that they come from (`entity_pos`, `pos`); repeated rows are hits of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: How many codes or sources of a hit are shown.
SHOWN = 5


def matching(columns: dict[str, Column], keyword: str) -> Column:
    """The names of the columns that have the keyword, in order."""
    return F.array_compact(F.array(*(F.when(T.contains_keyword(c, keyword), F.lit(n)) for n, c in columns.items())))


def hits(df: DataFrame, corpus: str, key: Column, columns: dict[str, Column], keyword: str, title: Column, fallback: str | None = None) -> DataFrame:
    """type, key, title, where (names of matching columns, joined) and snippet of the first matching column.

    `fallback`: a name that is reported only if no other column matches. Each column is matched once, before the filter.
    """
    found = df.select(key.alias("key"), title.alias("title"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("t"), matching(columns, keyword).alias("w")).filter(F.size("w") > 0)
    main = F.filter("w", lambda n: n != fallback) if fallback else F.col("w")
    where = F.when(F.size(main) == 0, F.col("w")).otherwise(main)
    text = reduce(lambda out, n: F.when(F.get("w", F.lit(0)) == n, F.col("t")[n]).otherwise(out), reversed(columns), F.lit(None).cast("string"))
    return found.select(F.lit(corpus).alias("type"), "key", "title", F.array_join(where, ",").alias("where"), T.snippet(text, keyword).alias("snippet"))


def search(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _some(items: Column | str, keep) -> Column:
    return F.coalesce(F.filter(items, keep), F.array().cast("array<struct<code:string,name:string>>"))


def master_hits(fields: DataFrame, keyword: str) -> DataFrame:
    """entity_pos, pos, type, masterId, masterName, seq, name, where, snippet and codes of the fields that match.

    fields: entity_pos, field_pos, master_id, master_name, seq, name, short_name, description, codes. `where` is name, shortName
    and description, or `code` where only codes match. The snippet is the description's.
    """
    codes = _some("codes", lambda c: T.contains_keyword(c["name"], keyword))
    rows = fields.select("*", matching({"name": F.col("name"), "shortName": F.col("short_name"), "description": F.col("description")}, keyword).alias("_where"), codes.alias("_codes"))
    where = F.when(F.size("_where") == 0, F.array(F.lit("code"))).otherwise(F.col("_where"))
    return rows.filter((F.size("_where") > 0) | (F.size("_codes") > 0)).select(
        "entity_pos", F.col("field_pos").alias("pos"), F.lit("master").alias("type"), F.col("master_id").alias("masterId"), F.col("master_name").alias("masterName"), "seq", F.coalesce("name", F.lit("")).alias("name"),
        where.alias("where"), F.when(F.array_contains("_where", "description"), T.snippet(F.col("description"), keyword)).alias("snippet"), F.slice("_codes", 1, SHOWN).alias("codes"),
    )


def pair_hits(pairs: DataFrame, keyword: str) -> DataFrame:
    """entity_pos, pos, type, codeTableId, codeTableName, kind, code and name of the pairs whose code or name matches.

    pairs: entity_pos, pos, table_id, table_name, kind, code, name.
    """
    found = pairs.filter(T.contains_keyword(F.col("name"), keyword) | T.contains_keyword(F.col("code"), keyword))
    return found.select("entity_pos", "pos", F.lit("codeTable").alias("type"), F.col("table_id").alias("codeTableId"), F.col("table_name").alias("codeTableName"), "kind", "code", "name")


def group_hits(groups: DataFrame, keyword: str) -> DataFrame:
    """entity_pos, pos, type, codeTableId, codeTableName, kind, targetCode, targetName, where, sources and snippet of the groups
    whose target, note or sources match.

    groups: entity_pos, group_pos, table_id, table_name, kind, target_code, target_name, note, sources. The snippet is the note's.
    """
    target = T.contains_keyword(F.col("target_name"), keyword) | T.contains_keyword(F.col("target_code"), keyword)
    sources = _some("sources", lambda s: T.contains_keyword(s["name"], keyword) | T.contains_keyword(s["code"], keyword))
    rows = groups.select("*", target.alias("_target"), T.contains_keyword(F.col("note"), keyword).alias("_note"), sources.alias("_sources"))
    where = F.array_compact(F.array(F.when(F.col("_target"), F.lit("targetName")), F.when(F.col("_note"), F.lit("note")), F.when(F.size("_sources") > 0, F.lit("sources"))))
    return rows.withColumn("_where", where).filter(F.size("_where") > 0).select(
        "entity_pos", F.col("group_pos").alias("pos"), F.lit("codeTable").alias("type"), F.col("table_id").alias("codeTableId"), F.col("table_name").alias("codeTableName"), "kind",
        F.col("target_code").alias("targetCode"), F.col("target_name").alias("targetName"), F.col("_where").alias("where"), F.slice("_sources", 1, SHOWN).alias("sources"), F.when(F.col("_note"), T.snippet(F.col("note"), keyword)).alias("snippet"),
    )
