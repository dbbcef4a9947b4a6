"""What tables have lost, recovered from the page layout: numbered ranges in three tiers, then single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import layout, records
from .pages import recoverable
from .versioning import replace_recovered


def defects(fields: DataFrame) -> DataFrame:
    """section, seq: numbers that are missing between a section's least and largest, or whose field has no name."""
    edges = fields.groupBy("section").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    every = edges.select("section", F.explode(F.sequence("lo", "hi")).alias("seq"))
    missing = every.join(fields.select("section", "seq"), ["section", "seq"], "left_anti")
    return missing.union(fields.filter("name = ''").select("section", "seq")).distinct()


def orphans(raw: DataFrame) -> DataFrame:
    """Raw rows without a number that have sub-names."""
    return raw.filter((T.strip_u(F.coalesce("seq_raw", F.lit(""))) == "") & (T.strip_u(F.coalesce("sub_name", F.lit(""))) != ""))


def _labels(k: Column) -> Column:
    """The range's labels if it is `k` items repeated, else an empty array."""
    n = F.col("hi") - F.col("lo") + 1
    return F.when((k > 0) & (n % k == 0), T.group_labels(F.col("name"), (n / k).cast("int"))).otherwise(F.array().cast("array<string>"))


def _cycles(rows: DataFrame, item: list[Column], content: Column) -> DataFrame:
    """A row for each number of a range. rows: section, range_no, lo, hi, name, k, labels; `item` and `content` may use the
    places `cycle` and `sub`."""
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("hi") - F.col("lo"))).alias("i"))
    each = each.withColumn("cycle", (F.col("i") / F.col("k")).cast("int")).withColumn("sub", (F.col("i") % F.col("k")).cast("int"))
    title = F.concat(T.without_labels(F.col("name")), F.get("labels", F.col("cycle")))
    return each.select("section", "range_no", "i", (F.col("lo") + F.col("i")).alias("seq"), title.alias("name"), *item, content.alias("content"), F.map_from_arrays(F.array(), F.array()).cast(records.FLAGS).alias("flags"))


def _ranged(rows: DataFrame, lineage: str) -> DataFrame:
    return records.as_fields(rows.withColumn("field_pos", F.struct(F.col("range_no").cast("long").alias("pos"), "i")), lineage, codes=False)


def from_orphans(ranges: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of the ranges that fit a child without a parent (the first that does), and the ranges left."""
    lists = records.lists_of()
    child = orphans(raw).select("section", "pos", F.col("content").alias("child_content"), *(c.alias(f"_{n}") for n, c in lists.items()))
    k = F.size("_sub_name")
    fit = ranges.join(child, "section").withColumns({"k": k, "labels": _labels(k)}).filter(F.size("labels") > 0)
    best = fit.withColumn("_rank", F.row_number().over(Window.partitionBy("section", "range_no").orderBy("pos"))).filter("_rank = 1")
    item = [T.pick_or_last(F.col(f"_{n}"), F.col("sub")).alias(n) for n in records.RAW[2:6]]
    text = F.coalesce(F.nullif("child_content", F.lit("")), "description")
    rows = _cycles(best, item, F.when(F.col("i") == 0, text))
    return _ranged(rows, "range+text"), ranges.join(best.select("section", "range_no"), ["section", "range_no"], "left_anti")


def from_definitions(ranges: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of the ranges whose cycle of two items or more the layout shows, and the ranges left."""
    cells = ("name", "mode_raw", "max_bytes_raw", "item_format_raw", "content")
    cycle = subs.groupBy("section", "range_no").agg(F.array_sort(F.collect_list(F.struct("sub_pos", *(F.col(c) for c in cells)))).alias("subs"))
    k = F.size("subs")
    fit = ranges.join(cycle, ["section", "range_no"]).withColumns({"k": k, "labels": _labels(k)}).filter("k >= 2 and size(labels) > 0")
    of = lambda c: F.get("subs", F.col("sub"))[c]
    rows = _cycles(fit, [of("name").alias("sub_name"), *(of(c).alias(c) for c in cells[1:4])], F.when(F.col("cycle") == 0, of("content")))
    return _ranged(rows, "range+text-subs"), ranges.join(fit.select("section", "range_no"), ["section", "range_no"], "left_anti")


def from_template(ranges: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of ranges whose every number has a label, modelled on the range's first field that is there."""
    last = fields.groupBy("section", "seq").agg(F.max_by(F.struct("name", "short_name", "mode", "max_bytes", "item_format"), "field_pos").alias("t"))
    inside = ranges.join(last, "section").filter("seq between lo and hi")
    model = inside.groupBy("section", "range_no").agg(F.min_by("t", "seq").alias("t"))
    rows = ranges.join(model, ["section", "range_no"]).withColumns({"k": F.lit(1), "labels": _labels(F.lit(1))}).filter("size(labels) > 0")
    short = F.coalesce(F.nullif("t.short_name", F.lit("")), "t.name").alias("short_name")
    made = _cycles(rows, [short, F.col("t.mode").alias("mode"), F.col("t.max_bytes").alias("max_bytes"), F.col("t.item_format").alias("item_format")], F.when(F.col("i") == 0, F.nullif("description", F.lit(""))))
    return made.select(
        "section", "seq", F.concat("name", F.lit("/"), "short_name").alias("name"), "short_name", "mode", "max_bytes", "item_format", F.col("content").alias("description"),
        F.array().cast(records.CODES).alias("codes"), "flags", F.lit("range+template").alias("lineage"), F.struct(F.col("range_no").cast("long").alias("pos"), "i").alias("field_pos"),
    )


def extract_fields(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """All fields of sections (records.FIELD), numbered by field_pos in order of seq, those of tables first.

    raw: section, pos and records.RAW, flags. lines: section, line_no, line. Recovered ranges replace all fields of their
    numbers; single rows of the layout replace fields without a name only. What several steps read is checkpointed: it is made
    once, outlives executors, and keeps the plans of later steps small.
    """
    fields = cut(records.normalized(raw.withColumn("pos", F.col("pos").cast("long"))))
    bad = cut(defects(fields))
    ranges = cut(recoverable(layout.seq_ranges(lines), bad))
    first, left = from_orphans(ranges, raw)
    left = cut(left)
    second, rest = from_definitions(left, cut(layout.sub_definitions(lines, left)))
    ranged = cut(first.unionByName(second).unionByName(from_template(cut(rest), fields)))
    fields = replace_recovered(fields, ranged, ["section", "seq"])
    still = bad.join(ranged.select("section", "seq"), ["section", "seq"], "left_anti")
    found = cut(layout.text_records(lines)).join(still, ["section", "seq"], "left_semi")
    single = cut(records.as_fields(
        found.select("section", F.struct(F.col("line_no").cast("long").alias("pos"), F.lit(0).alias("i")).alias("field_pos"), "seq", "name", F.lit("").alias("sub_name"), "mode_raw", "max_bytes_raw", "item_format_raw", "content", F.map_from_arrays(F.array(), F.array()).cast(records.FLAGS).alias("flags")),
        "text",
    ))
    fields = replace_recovered(fields, single, ["section", "seq"], F.col("name") == "")
    tier = F.when(F.col("lineage") == "table", 0).when(F.col("lineage") == "text", 2).otherwise(1)
    w = Window.partitionBy("section").orderBy("seq", tier, "field_pos")
    return fields.select(*records.FIELD, (F.row_number().over(w) - 1).alias("field_pos"))


def lineage_counts(fields: DataFrame) -> DataFrame:
    """section and a map of lineage to the number of its fields."""
    counts = fields.groupBy("section", "lineage").agg(F.count("*").alias("n"))
    return counts.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lineage", "n")))).alias("counts"))
