"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, beside op8's three bits.

SimHash bits can't tell 0.8: such sets differ in about ten of 64 bits. So sets get further keys, sets that share one are
candidates where their sizes allow 0.8, and whole sets decide. Keys of a set of `a` shingles:

- up to SMALL shingles: the first a - ceil(0.8 a) + 1 of them in order of their hashes. Two sets that are alike share one of
  these, without exception.
- from 0.8 SMALL shingles on: BANDS bands of ROWS min-hashes each. Two sets that are exactly 0.8 alike miss all of them with a
  probability of (1 - 0.8 ** ROWS) ** BANDS, 6e-7, and sets that are more alike with less.

So any two sets that are alike both have keys of one kind. Sets that keys join, directly or over others, are a family. A pivot, the
set that shares most keys, stands for its family: each set is compared with the pivot alone, and holds what differs from it,
D(a) = a xor pivot. As a xor b = D(a) xor D(b), a pair that is alike either is alike with the pivot on both sides, or its
differences share (|D(a)| + |D(b)| - (|a| + |b|) / 9) / 2 shingles or more. So the first shared one stands early in both, and an
exact prefix join of the differences (shingles that the pivot lacks come first) finds such pairs. What most of a family shares is
in no difference, so members that are unlike each other don't meet, however many they are.

Words are those of golay_simhash (ASCII lower case, white space); fewer than five make one shingle. Texts without words are
alike. Equal sets are one node; shingles and sets are told by 64-bit hashes. A null doc_id is never the one that stays unless
its group has no other; rows of equal doc_id and text count as one. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, golay_simhash

SHINGLE = 5
SMALL = 40
BANDS, ROWS = 36, 5
#: Sets of a family that are compared with one copy of their pivot.
SPREAD = 1000
#: Words of 64 bits in which a set's shingles are counted modulo two.
PARITY = 8
_BASE = 0x9E3779B97F4A7C15
#: A multiplier for each min-hash, and one for each place in a band.
_FACTORS = (common.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_PLACES = common.mixed(np.arange(7, 7 + ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words (fewer words: all of them) of a text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    out = np.full(n, np.uint64(min(len(words), size)), np.uint64)
    for k in range(min(len(words), size)):
        out = out * np.uint64(_BASE) + codes[k : k + n]
    return np.unique(common.mixed(out))


def node(shingles: np.ndarray) -> int:
    """A set's name."""
    return int(common.mixed(np.array([common.mixed(shingles ^ np.uint64(_BASE)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0])


def keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a sorted set; two sets that are 0.8 alike share one (see above)."""
    n, out = len(shingles), []
    if n <= SMALL:
        out.append(common.mixed(shingles[: n - (4 * n + 4) // 5 + 1] + np.uint64(_BASE)) if n else shingles)
    if 5 * n >= 4 * SMALL:
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, n, 512):
            least = np.minimum(least, (low[lo : lo + 512, None] * _FACTORS).min(axis=0))
        bands = least.reshape(BANDS, ROWS).astype(np.uint64)
        out.append(common.mixed((common.mixed(bands + np.uint64(1)) * _PLACES).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)))
    return np.concatenate(out)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        fps, nodes, sizes, found = [], [], [], []
        for text in block.column("text").to_pylist():
            shingles = shingle_set(text)
            fps.append(golay_simhash.fingerprint(golay_simhash.shingle_hashes(text)))
            nodes.append(node(shingles))
            sizes.append(len(shingles))
            found.append(keys(shingles).tobytes())
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("text_hash"), long(fps), long(nodes), pa.array(sizes, pa.int64()), common.binary_array(found)],
            names=["doc_id", "text_hash", "fp", "node", "size", "keys"],
        )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (as in golay_simhash), node, size and keys of each row."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _described, "doc_id long, text_hash long, fp long, node long, size long, keys binary"
    )


def _dealt(parts: int):
    """Rows (part, rows): key, node and size of many sets' keys of one part, three 8-byte integers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("keys").to_pylist()
            count = np.array([len(x) // 8 for x in data], np.int64)
            if not count.sum():
                continue
            h = np.frombuffer(b"".join(data), np.uint64)
            rows = np.stack([h.view(np.int64), np.repeat(batch.column("node").to_numpy(), count), np.repeat(batch.column("size").to_numpy(), count)], axis=1)
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(part[lead]), common.binary_array([rows[a:b].tobytes() for a, b in zip(lead, np.append(lead[1:], len(part)), strict=True)])], names=["part", "rows"])

    return run


def met(rows: np.ndarray) -> np.ndarray:
    """Of rows (key, node, size) those whose key another set of a fitting size has too."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    fits = (rows[1:, 0] == rows[:-1, 0]) & (5 * rows[:-1, 2] >= 4 * rows[1:, 2])
    return rows[np.concatenate([fits, [False]]) | np.concatenate([[False], fits])]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = met(np.frombuffer(b"".join(data), np.int64).reshape(-1, 3))
        for lo in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[lo : lo + 100_000, k])) for k in range(3)], names=["h", "node", "size"])

    now, data = None, []
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if part != now and data:
                yield from out(data)
                data = []
            now = part
            data.append(x)
    if data:
        yield from out(data)


def parity(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((shingles % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        found = [shingle_set(t) for t in block.column("text").to_pylist()]
        lists = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), parity)]
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("node", "pivot", "many")), *lists], names=["node", "pivot", "many", "shingles", "parity"])


def _is(docs: DataFrame, doc_id: Column, text_hash: Column) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(doc_id) & F.xxhash64(docs["text"]).eqNullSafe(text_hash)


def _name(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _row(docs: DataFrame) -> Column:
    return _name(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))


def sets_of(members: DataFrame, docs: DataFrame, held: DataFrame) -> DataFrame:
    """The members (node, pivot, many) with shingles and parity; the text of one row is read again for each.

    A row's name and text_hash give its doc_id, as xxhash64 maps 64-bit integers one to one, so they join in its place.
    """
    some = held.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("of")).join(members, "node")  # copies are one row before they meet
    some = common.stored(some.select("node", "pivot", "many", F.col("of.text_hash").alias("text_hash"), _name(F.col("of.doc_id"), F.col("of.text_hash")).alias("name")), "candidates")
    rows = docs.select(_row(docs).alias("name"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.filter(common.sieve(some, F.col("name"))(F.col("name"))).groupBy("name", "text_hash").agg(F.first("text").alias("text"))
    texts = some.join(rows, ["name", "text_hash"]).select("node", "pivot", "many", "text")
    return common.stored(texts.mapInArrow(_sets, "node long, pivot long, many long, shingles array<long>, parity array<long>"), "sets")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are 0.8 alike or more."""
    found = lambda c: sets.filter(common.sieve(pairs, F.col(c))(F.col("node"))).select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(found("a"), "a").join(found("b"), "b").filter(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def families(rows: DataFrame) -> DataFrame:
    """node, pivot and many (sets of the family) of each node of the rows (h, node, size)."""
    lead = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("l"), F.count("*").alias("n"))
    stars = common.stored(rows.join(lead, "h").groupBy("node", F.col("l.node").alias("to")).agg(F.sum("n").alias("n")), "stars")
    shared = stars.groupBy("node").agg(F.sum("n").alias("n"))
    members = golay_simhash.components(stars.select(F.col("node").alias("a"), F.col("to").alias("b"))).join(shared, "node")
    per = members.groupBy("root").agg(F.max(F.struct("n", "node"))["node"].alias("pivot"), F.count("*").alias("many"))
    return common.stored(members.join(per, "root").select("node", "pivot", "many"), "families")


def differences(sets: DataFrame) -> DataFrame:
    """node, pivot, parity, size, d (shingles that differ from the pivot's), linked (alike with it) and early: the first of these d.

    With a partner b, a shared shingle at place p needs 18 (d - p) >= 9 (d + d_b) - (a + b); as b <= 5 a / 4, d_b >= 0 and
    d_b >= d - (a + b) / 9, p is a / 4 and (d + a / 4) / 2 at most. A set that is alike with the pivot only looks for others
    that are not (9 d_b > b + pivot), so there 18 p <= 9 d + a - pivot.
    """
    copies = F.floor(F.col("many") / SPREAD)
    centre = sets.filter("node = pivot").select("pivot", F.col("shingles").alias("centre"), F.explode(F.sequence(F.lit(0), copies)).alias("copy"))
    own = sets.withColumn("copy", F.pmod(F.xxhash64("node"), copies + 1))
    apart = own.join(centre, ["pivot", "copy"]).select(
        "node", "pivot", "parity", F.size("shingles").alias("size"), F.size("centre").alias("whole"),
        F.concat(F.sort_array(F.array_except("shingles", "centre")), F.sort_array(F.array_except("centre", "shingles"))).alias("apart"),
    )
    apart = apart.withColumn("d", F.size("apart")).withColumn("linked", F.expr("9 * d <= size + whole"))
    places = F.expr("least(size div 4, (4 * d + size) div 8, if(linked, floor((9 * d + size - whole) / 18), d))").cast("int")
    return common.stored(apart.select("node", "pivot", "parity", "size", "d", "linked", F.slice("apart", 1, F.greatest(places + 1, F.lit(0))).alias("early")), "differences")


def links(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that keep every component of the graph of 0.8 alike sets together."""
    nodes = held.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    whole = held.agg(F.sum(F.octet_length("keys") / 8)).collect()[0][0] or 0
    parts = max(common.partitions(held), int(whole) // golay_simhash.BUCKET_ROWS + 1)
    dealt = nodes.mapInArrow(_dealt(parts), "part long, rows binary").repartition(parts, "part").sortWithinPartitions("part")
    rows = common.stored(dealt.mapInArrow(_met, "h long, node long, size long"), "met")
    sets = sets_of(families(rows), docs, held.select("doc_id", "text_hash", "node"))
    apart = differences(sets)
    root = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("node")).alias("root")
    places = apart.select("node", "pivot", "parity", "size", "d", root, F.posexplode("early").alias("p", "shingle"))
    x, y = places.alias("x"), places.alias("y")
    odd = " + ".join(f"bit_count(x.parity[{k}] ^ y.parity[{k}])" for k in range(PARITY))
    meet = F.expr(
        "x.shingle = y.shingle and x.pivot = y.pivot and x.node < y.node and x.root <> y.root and 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)"
        " and 18 * least(x.d - x.p, y.d - y.p) >= 9 * (x.d + y.d) - (x.size + y.size)"
        f" and 9 * ({odd}) <= x.size + y.size"
    )
    pairs = common.stored(x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    return common.cut(alike(pairs, sets).union(apart.filter("linked").select("pivot", "node")))


def roots(docs: DataFrame, held: DataFrame) -> DataFrame:
    """node and root (the group's name) of each node with links: groups of near copies and of golay_simhash's links."""
    distinct = common.cut(held.groupBy("fp").agg(F.min("node").alias("node")))
    bits = golay_simhash.links(distinct.select("fp"), distinct.count())
    name = lambda c: distinct.select(F.col("fp").alias(c), F.col("node").alias(f"of_{c}"))
    edges = bits.join(name("a"), "a").join(name("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    edges = edges.union(held.select("fp", F.col("node").alias("a")).distinct().join(distinct, "fp").select("a", F.col("node").alias("b")))
    return common.cut(golay_simhash.components(edges.union(links(docs, held)).filter("a <> b")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row (with all columns) of each group: that of the smallest doc_id (null last), of rows that share it the smaller hash."""
    held = common.stored(described(docs), "described")
    rows = common.stored(held.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "members")
    # the first row of each node, then of each group: rows of one text never meet in one task
    first = held.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    first = first.join(roots(docs, held), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    first = first.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & rows["text_hash"].eqNullSafe(first["text_hash"])
    gone, again = common.unused(docs, "gone"), common.unused(docs, "again")
    spare = common.stored(rows.join(first, same, "left_anti").select(F.struct("doc_id", "text_hash").alias(gone)), "spare")
    several = common.stored(rows.join(first, same, "left_semi").filter("n > 1").select(F.struct("doc_id", "text_hash").alias(again)), "several")
    # only rows that a sieve of the spare ones lets through are moved; all others stay as they are
    maybe = common.sieve(spare, _name(F.col(f"{gone}.doc_id"), F.col(f"{gone}.text_hash")))(_row(docs))
    doubtful = docs.filter(maybe)
    kept = docs.filter(~maybe).union(doubtful.join(spare, _is(doubtful, spare[gone]["doc_id"], spare[gone]["text_hash"]), "left_anti"))
    if several.isEmpty():
        return kept
    # repeated rows of one document: one of them stays
    some = common.sieve(several, _name(F.col(f"{again}.doc_id"), F.col(f"{again}.text_hash")))(_row(kept))
    doubtful = kept.filter(some)
    is_several = _is(doubtful, several[again]["doc_id"], several[again]["text_hash"])
    return kept.filter(~some).union(doubtful.join(several, is_several, "left_anti")).union(doubtful.join(several, is_several, "left_semi").dropDuplicates(["doc_id", "text"]))
