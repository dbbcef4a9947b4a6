"""Records of table rows: parents with their children, multi-line rows, continued rows, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of a raw row beside section, pos and flags.
RAW = ("seq_raw", "name", "sub_name", "mode_raw", "max_bytes_raw", "item_format_raw", "content")
#: Columns of a field, in order.
FIELD = ("section", "seq", "name", "short_name", "mode", "max_bytes", "item_format", "description", "codes", "flags", "lineage")
FLAGS = "map<string,string>"
CODES = "array<struct<code:string,name:string>>"


def filled(flags: Column) -> Column:
    """The flags that say something."""
    return F.map_filter(flags, lambda _, v: v != "")


def lists_of(row: str = "") -> dict[str, Column]:
    """The lines of each listed column of a raw row (or of the struct `row`)."""
    at = lambda n: F.coalesce(F.col(f"{row}{n}"), F.lit(""))
    out = {n: T.split_lines(at(n)) for n in ("seq_raw", "sub_name", "max_bytes_raw", "item_format_raw")}
    return {**out, "mode_raw": T.joined_modes(T.split_lines(at("mode_raw")))}


def expanded(raw: DataFrame) -> DataFrame:
    """Rows (section, pos, i, RAW, flags) with parents and children merged and multi-line rows taken apart.

    raw: section, pos, RAW, flags; null counts as empty. A child (no number, but a sub-name) takes the row just before it as
    its parent if that one is plain. One row becomes one array of rows, so all but the neighbour's lookup is local to the row.
    """
    clean = raw.select("section", "pos", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW), F.coalesce("flags", F.map_from_arrays(F.array(), F.array()).cast(FLAGS)).alias("flags"))
    child = (T.strip_u(F.col("seq_raw")) == "") & (T.strip_u(F.col("sub_name")) != "")
    multi = F.col("seq_raw").contains("\n") & (F.col("sub_name").contains("\n") | F.col("mode_raw").contains("\n"))
    kinds = clean.withColumn("_kind", F.when(child, "child").when(multi, "multi").otherwise("plain"))
    w = Window.partitionBy("section").orderBy("pos")
    near = kinds.withColumn("_p", F.when(F.lag("_kind").over(w) == "plain", F.lag(F.struct(*RAW)).over(w))).withColumn("_next", F.lead("_kind").over(w))
    rows = near.filter(~((F.col("_kind") == "plain") & F.coalesce(F.col("_next") == "child", F.lit(False))))

    own, above = lists_of(), lists_of("_p.")
    rows = rows.withColumns({f"_{n}": c for n, c in own.items()})
    mine = {n: F.when((F.size(f"_{n}") == 0) & (F.col("_kind") == "child") & F.col("_p").isNotNull(), above[n]).otherwise(F.col(f"_{n}")) for n in ("mode_raw", "max_bytes_raw", "item_format_raw")}
    subs = F.when((F.col("_kind") == "multi") & (F.size("_sub_name") == 0), T.split_lines(F.col("name"))).otherwise(F.col("_sub_name"))
    rows = rows.withColumns({**{f"_{n}": c for n, c in mine.items()}, "_sub_name": subs, "_above": above["seq_raw"]})

    wide = F.greatest(*(F.size(f"_{n}") for n in ("sub_name", "mode_raw", "max_bytes_raw", "item_format_raw")))
    lead = F.get(F.split("_p.name", "\n"), F.lit(0))
    rows = rows.withColumns({"_k": wide, "_range": T.range_of(F.array_join("_above", " ")), "_lead": lead})
    n = F.col("_range.hi") - F.col("_range.lo") + 1
    rows = rows.withColumn("_n", F.when(n % F.col("_k") == 0, n)).withColumn("_labels", T.group_labels(F.col("_p.name"), (F.col("_n") / F.col("_k")).cast("int")))

    def made(i: Column, seq: Column, name: Column | str, at: Column, content: Column) -> Column:
        picked = [T.pick_or_last(F.col(f"_{c}"), at).alias(c) for c in RAW[2:6]]
        return F.struct(i.alias("i"), seq.alias("seq_raw"), (F.lit(name) if isinstance(name, str) else name).alias("name"), *picked, F.when(i == 0, content).otherwise("").alias("content"))

    both = T.strip_u(F.concat_ws("\n", F.nullif("_p.content", F.lit("")), F.nullif("content", F.lit(""))))
    short = T.strip_u(F.col("_lead"))
    base = T.without_labels(F.col("_lead"))
    stem = F.when(base != "", base).otherwise(short)
    k = F.col("_k")
    cycle = lambda i: (i / k).cast("int")
    cycles = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: made(i, (F.col("_range.lo") + i).cast("string"), F.concat(stem, F.coalesce(F.get("_labels", cycle(i)), F.lit(""))), (i % k).cast("int"), both))
    numbers = lambda i: F.when(F.size("_above") == k, F.get("_above", i)).otherwise(F.coalesce(F.get("_above", F.lit(0)), F.lit("")))
    children = F.transform(F.sequence(F.lit(0), k - 1), lambda i: made(i, numbers(i), short, i, both))
    width = F.greatest(k, F.size("_seq_raw"))
    parts = F.transform(F.sequence(F.lit(0), width - 1), lambda i: made(i, T.pick_or_last(F.col("_seq_raw"), i), "", i, F.col("content")))
    same = lambda name: F.array(F.struct(F.lit(0).alias("i"), *(name.alias(c) if c == "name" else F.col(c) for c in RAW)))
    paired = (F.col("_kind") == "child") & F.col("_p").isNotNull()
    out = (
        F.when(paired & F.col("_n").isNotNull(), cycles)
        .when(paired, children)
        .when((F.col("_kind") == "multi") & (width > 1), parts)
        .when(F.col("_kind") == "plain", same(F.regexp_replace("name", "\n", "")))
        .otherwise(same(F.col("name")))
    )
    return rows.select("section", "pos", "flags", F.explode(out).alias("r")).select("section", "pos", "r.i", *(F.col(f"r.{c}") for c in RAW), "flags")


def normalized(raw: DataFrame) -> DataFrame:
    """Fields (FIELD and field_pos) of raw rows: a row without a number adds its text to the row before.

    Rows before a section's first number belong to no field and are left out.
    """
    w = Window.partitionBy("section").orderBy("pos", "i")
    rows = expanded(raw).withColumn("seq", T.leading_int(F.col("seq_raw")))
    starts = F.col("seq").isNotNull() | (F.row_number().over(w) == 1)
    rows = rows.withColumn("_starts", starts).withColumn("_rec", F.sum(F.col("_starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("pos", "i")
    merged = rows.groupBy("section", "_rec").agg(
        F.min(place).alias("field_pos"),
        F.min_by(F.struct("seq", *RAW, "flags"), place).alias("r"),
        F.array_sort(F.collect_list(F.struct("pos", "i", "content"))).alias("_all"),
    ).filter("r.seq is not null")
    texts = F.transform("_all", lambda x: x["content"])
    content = F.aggregate(F.slice(texts, F.lit(2), F.size(texts)), F.col("r.content"), lambda done, x: T.strip_u(F.concat(done, F.lit("\n"), x)))
    return as_fields(merged.select("section", "field_pos", "r.seq", "r.name", "r.sub_name", "r.mode_raw", "r.max_bytes_raw", "r.item_format_raw", content.alias("content"), "r.flags"), "table")


def as_fields(rows: DataFrame, lineage: str, codes: bool = True) -> DataFrame:
    """Fields of rows: section, field_pos, seq, name, sub_name, mode_raw, max_bytes_raw, item_format_raw, content, flags."""
    name, sub = F.nullif("name", F.lit("")), F.nullif("sub_name", F.lit(""))
    return rows.select(
        "section", "seq", F.concat_ws("/", name, sub).alias("name"), F.when(name.isNotNull(), sub).alias("short_name"),
        T.mode_of(F.array_join(T.joined_modes(T.split_lines(F.coalesce("mode_raw", F.lit("")))), "")).alias("mode"),
        T.byte_size(F.col("max_bytes_raw"))["size"].alias("max_bytes"), F.nullif("item_format_raw", F.lit("")).alias("item_format"), F.nullif("content", F.lit("")).alias("description"),
        (T.code_lines(F.col("content")) if codes else F.array().cast(CODES)).alias("codes"), filled(F.col("flags")).alias("flags"), F.lit(lineage).alias("lineage"), "field_pos",
    )
