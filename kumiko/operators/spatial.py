"""Interval joins: values in bands, words in boxes. A null place lies in no band or box; bands of a key don't overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .names import unused


def band_join(points: DataFrame, bands: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds lo and hi of the half-open band [lo, hi) of the same keys that holds `at`, for bands that don't overlap.

    Bands and points are merged in order of place, and each point takes the last band begun: a sort instead of a nested loop.
    """
    place, kind, band = (unused(n, points, bands) for n in ("place", "kind", "band"))
    b = bands.select(*keys, F.col("lo").alias(place), F.lit(0).alias(kind), F.struct("lo", "hi").alias(band))
    p = points.withColumn(place, F.col(at)).withColumn(kind, F.lit(1))
    both = b.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(place, kind).rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.col(band)["lo"], F.col(band)["hi"]
    out = both.withColumn(band, F.last(band, ignorenulls=True).over(w)).filter((F.col(kind) == 1) & (F.col(place) >= lo) & (F.col(place) < hi))
    return out.select(*points.columns, lo.alias("lo"), hi.alias("hi"))


def box_join(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """All pairs of a point and a box (x_lo, x_hi, y_lo, y_hi, closed on all sides). Boxes may overlap; their table is a
    parameter table, and is broadcast only as far as Spark's own size check allows."""
    return points.join(boxes, F.col(x).between(F.col("x_lo"), F.col("x_hi")) & F.col(y).between(F.col("y_lo"), F.col("y_hi")))


def box_text(joined: DataFrame, keys: list[str], top: str, left: str, text: str, sep: str = "", name: str = "text") -> DataFrame:
    """The words of each box in reading order, joined."""
    words = F.array_sort(F.collect_list(F.struct(F.col(top).alias("a"), F.col(left).alias("b"), F.col(text).alias("c"))))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(words, lambda w: w["c"]), sep).alias(name))


def regions(words: DataFrame, rects: DataFrame, page_height: float, least: float = 5.0, target: Column | None = None) -> DataFrame:
    """page, y_top, y_bot, target_code: bands between thin rules that hold a target code (3 or 4 digits), the topmost one."""
    from .sequence import bands

    edges = rects.filter("height < 2").select("page", F.bround("top", 1).alias("top"))
    found = bands(edges, ["page"], "top", F.lit(page_height), least)
    token = target if target is not None else T.all_digits(F.col("text"), 3, 4)
    inside = band_join(words.filter(token), found, ["page"], "top")
    return inside.groupBy("page", "lo", "hi").agg(F.min_by("text", F.struct("top", "x0")).alias("target_code")).select("page", F.col("lo").alias("y_top"), F.col("hi").alias("y_bot"), "target_code")


def attach_to_regions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (page, y_top, y_bot, ...) with the target_code of the region that holds their middle, else of the one before."""
    mid = rows.withColumn("mid", (F.col("y_top") + F.col("y_bot")) / 2)
    r = found.select("page", F.col("y_top").alias("_at"), F.lit(0).alias("_kind"), F.col("target_code").alias("_code"))
    both = r.unionByName(mid.withColumn("_at", F.col("mid")).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("page").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("target_code", F.last("_code", ignorenulls=True).over(w)).filter("_kind = 1 and target_code is not null")
    return out.select(*rows.columns, "target_code")
