"""Differences between versions, upserts and snapshots. A null count is none; null keys match nothing and so stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused

#: A change of more than one fifth is reported.
CHANGE = (1, 5)


def diff_counts(now: DataFrame, before: DataFrame, key: str, count: str) -> DataFrame:
    """key, count, baseline, delta, status (added, changed, same) and large, for each entity of `now`."""
    old = before.select(key, F.coalesce(count, F.lit(0)).alias("baseline"))
    out = now.select(key, F.coalesce(count, F.lit(0)).alias(count)).join(old, key, "left")
    delta = F.col(count) - F.col("baseline")
    status = F.when(F.col("baseline").isNull(), "added").when(delta != 0, "changed").otherwise("same")
    a, b = CHANGE
    large = F.coalesce((F.col("baseline") > 0) & (F.abs(delta) * b > F.col("baseline") * a), F.lit(False))
    return out.select(key, count, "baseline", delta.alias("delta"), status.alias("status"), large.alias("large"))


def added_removed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key and change: ids that only one of the versions has."""
    a, b = now.select(key).distinct(), before.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("added")).union(b.join(a, key, "left_anti").withColumn("change", F.lit("removed")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def seed_snapshot(rows: DataFrame, version: str, source: str | None, new: str, keep: Column) -> DataFrame:
    """A new version: the kept rows of `source` (None: the latest other version); no rows if the version is there already.

    The versions are gathered once, as they are few; their rows aren't.
    """
    found = sorted(r[0] for r in rows.select(version).filter(F.col(version).isNotNull()).distinct().collect())
    others = [v for v in found if v != new]
    source = source if source is not None else (others[-1] if others else None)
    return rows.filter(F.lit(new not in found) & (F.col(version) == F.lit(source)) & keep).withColumn(version, F.lit(new))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Distinct keys that only the older table has."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def replace_recovered(fields: DataFrame, recovered: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """`fields` without the rows that recovered ones replace (of those, only where `only` holds), and the recovered rows."""
    hit = unused("hit", fields, recovered)
    marks = recovered.select(*keys).distinct().withColumn(hit, F.lit(True))
    joined = fields.join(marks, keys, "left")
    gone = F.coalesce(hit, F.lit(False)) & (only if only is not None else F.lit(True))
    return joined.filter(~gone).drop(hit).unionByName(recovered, allowMissingColumns=True)


def by_priority(parts: list[tuple[str, DataFrame]], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of several sources with their `lineage`; of equal keys those of the first source that has them."""
    out = None
    for lineage, df in parts:
        df = df.withColumn("lineage", F.lit(lineage))
        out = df if out is None else out.unionByName(df.join(out.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return out.orderBy(*order) if order else out
