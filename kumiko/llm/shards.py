"""Shards by balanced label propagation over links between equal texts.

Documents begin in the shard that their id's hash gives, in proportion to the shards' room. In each round a linked document wants to go where most of its
neighbours are; neighbours are the documents of equal text, so a text's count in each shard (one join, one sum) tells. Shards
take what their quota allows: texts are accepted in order of their hash until the histogram of wants by hash reaches the
room that is left, counting in what wants to leave. Rounds go on until none is accepted. A text with more documents than a shard's quota can't go to one shard; its documents fill shards one after
another, so it is cut as few times as can be. Documents without links then move to even the counts out: law `rows`, counts
of any two shards are at most one apart.

Counts by shard, histograms and texts larger than a share of a quota (at most 4 times the shards) are all that reaches the
driver. No group is gathered: ranks come from common.ranked.

Defined results. Null text: no bytes, CRC of none, linked to other null texts (not to empty ones). Null doc_id stands first.
Repeated rows are rows of their own; extra columns are ignored. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Slices of the hash by which wants are accepted.
SLICES = 4096
#: A text with more than this part of a shard's quota is placed by itself.
LARGE = 0.25


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _accepted(wants: list, room: list[int]) -> dict[int, int]:
    """For each shard the slices below which wants fit into its room. wants: rows (shard, slice, n)."""
    out, taken = {s: SLICES for s in range(len(room))}, [0] * len(room)
    for r in sorted(wants, key=lambda r: r["slice"]):
        s = r["want"]
        if r["slice"] >= out[s]:
            continue
        if taken[s] + r["n"] > room[s]:
            out[s] = r["slice"]
        else:
            taken[s] += r["n"]
    return out


def _home(room: list[int]) -> Column:
    """A shard for a document by its id's hash, in proportion to the shards' room."""
    point = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sum(room))))
    out, upto = F.lit(len(room) - 1), sum(room)
    for s in reversed(range(len(room))):
        out = F.when(point < upto, F.lit(s)).otherwise(out)
        upto -= room[s]
    return out


def _lookup(values: dict[int, int] | list[int]):
    """An array literal of values by shard."""
    items = [values[s] for s in range(len(values))]
    return F.array(*[F.lit(int(x)) for x in items])


def propagate(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of `docs`."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        common.crc_text(text).alias("text_crc32"),
        F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.col("text").isNull()).alias("link"),
    )
    base = common.cut(base.withColumn("slice", F.pmod(F.xxhash64("link"), F.lit(SLICES)).cast("int")))
    texts = common.cut(base.groupBy("link", "slice").agg(F.count("*").alias("copies")).filter("copies > 1"))
    n = base.count()
    quota = quotas(n, shards)
    least = max(1, min(quota, default=1))
    large = texts.filter(F.col("copies") > least * LARGE).orderBy(F.desc("copies"), "link").collect()  # at most shards / LARGE + 1
    room = list(quota)
    pieces: list[tuple] = []  # large texts, dealt to shards in runs of ranks
    for row in large:
        at, left = 0, row["copies"]
        fitting = [s for s in range(shards) if room[s] >= left]
        for s in [min(fitting, key=lambda s: (room[s], s))] if fitting else sorted(range(shards), key=lambda s: (-room[s], s)):
            take = min(left, room[s])
            if take:
                pieces.append((row["link"], at, at + take, s))
                at, left, room[s] = at + take, left - take, room[s] - take
    fixed = docs.sparkSession.createDataFrame(pieces, base.select("link", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("to")).schema)
    big = F.broadcast(docs.sparkSession.createDataFrame([(r["link"],) for r in large], base.select("link").schema))

    linked = base.join(texts.select("link"), "link", "left_semi").join(big, "link", "left_anti")
    linked = linked.select("link", "slice", "doc_id", "size", "text_crc32", _home(room).alias("shard"))
    # members of a text are interchangeable, so a round needs only how many are in each shard
    held = common.cut(linked.groupBy("link", "slice", "shard").agg(F.count("*").alias("n")).withColumn("home", F.col("shard")))
    while True:  # a text moves once at most, as all of it is in one shard then
        sizes = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        votes = held.groupBy("link", "shard").agg(F.sum("n").alias("n"))
        best = votes.groupBy("link").agg(F.max(F.struct("n", F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 20)), "shard")).alias("b")).select("link", F.col("b.shard").alias("want"))
        wanted = held.join(best, "link")
        rows = wanted.filter("shard <> want").groupBy("want", "slice").agg(F.sum("n").alias("n")).collect()  # shards * SLICES at most
        leaving = {r["shard"]: r["n"] for r in wanted.filter("shard <> want").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        limit = _accepted(rows, [room[s] - sizes.get(s, 0) + leaving.get(s, 0) for s in range(shards)])
        if not any(r["slice"] < limit[r["want"]] for r in rows):
            break
        moved = F.when(F.col("slice") < F.element_at(_lookup(limit), F.col("want") + 1), F.col("want")).otherwise(F.col("shard"))
        held = common.cut(wanted.select("link", "slice", moved.alias("shard"), "n", "home"))
    moves = held.groupBy("link", "home").agg(F.first("shard").alias("to"))  # a text's members of one home move together
    placed = linked.withColumnRenamed("shard", "home").join(moves, ["link", "home"]).select("doc_id", "size", "text_crc32", F.col("to").alias("shard"))

    if large:
        mine = common.ranked(base.join(big, "link").select("link", "doc_id", "size", "text_crc32"), "link", ["doc_id"], "rank")
        piece = F.broadcast(fixed.withColumnRenamed("link", "of"))
        dealt = mine.join(piece, (F.col("link") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        placed = placed.union(dealt.select("doc_id", "size", "text_crc32", F.col("to").alias("shard")))
    placed = common.cut(placed)

    # documents without links even the counts out
    single = base.join(texts.select("link"), "link", "left_anti").select("doc_id", "size", "text_crc32", _home(room).alias("shard"))
    single = common.ranked(single, "shard", ["doc_id"], "rank")
    taken = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    have = {r["shard"]: r["count"] for r in single.groupBy("shard").count().collect()}
    # linked documents may outgrow a quota by chance; then some of them move as well
    over = {s: max(0, taken.get(s, 0) - quota[s]) for s in range(shards)}
    if any(over.values()):
        ranked = common.ranked(placed, "shard", ["doc_id"], "rank")
        stay = F.col("rank") < F.element_at(_lookup([quota[s] for s in range(shards)]), F.col("shard") + 1)
        spare = ranked.filter(~stay).select("doc_id", "size", "text_crc32", "shard")
        placed = ranked.filter(stay).drop("rank")
        base_rank = F.element_at(_lookup([have.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
        single = single.union(common.ranked(spare, "shard", ["doc_id"], "more").select("doc_id", "size", "text_crc32", "shard", (F.col("more") + base_rank).alias("rank")))
        for s in range(shards):
            have[s] = have.get(s, 0) + over[s]
    free = {s: quota[s] - min(taken.get(s, 0), quota[s]) for s in range(shards)}
    keep = {s: min(have.get(s, 0), free[s]) for s in range(shards)}
    gaps = [(s, free[s] - keep[s]) for s in range(shards)]
    flows, at = [], {s: keep[s] for s in range(shards)}
    for to, gap in gaps:
        for s in range(shards):
            take = min(gap, have.get(s, 0) - at[s])
            if take > 0:
                flows.append((s, at[s], at[s] + take, to))
                at[s], gap = at[s] + take, gap - take
    flows += [(s, 0, keep[s], s) for s in range(shards) if keep[s]]
    table = F.broadcast(docs.sparkSession.createDataFrame(flows, "home int, lo long, hi long, to int"))
    evened = single.join(table, (F.col("shard") == F.col("home")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    whole = placed.select("doc_id", "size", "text_crc32", "shard").union(evened.select("doc_id", "size", "text_crc32", F.col("to").alias("shard")))
    out = common.ranked(whole, "shard", ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
