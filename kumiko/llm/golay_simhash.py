"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12) is perfect: each 23-bit
word is within three bits of one codeword. A segment's indices are those of the codewords of the word itself and of all words
one bit away (six at most); two segments at most one bit apart share the index of either. Three errors over three segments
either leave a segment without any, and of the other two one with one at most, or there is one in each (pigeonhole). So
fingerprints within three bits share a key of one of two kinds: a whole segment with an index of another, or an index of each
of the first two with a half of the third that has no error. A key fixes 30 bits or more of 64, so buckets stay small
where fingerprints are many. Those that share a key are compared bit by bit.

Only distinct fingerprints are keyed, so copies never meet. In each bucket a search from member to member gives a spanning
forest of its links, not all pairs: a dense family costs a row for each member, and all links count for the components.

Components: min labels by alternating large-star and small-star steps on the forest's edges, each step a join and a sum in
Spark with its lineage cut, until nothing changes.

Defined results. Null and empty texts have no words and fingerprint zero, which links like any other. A null doc_id never is
a component's smallest unless all are null (then component_id is null). Rows stay one to one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
ERRORS = 3
#: The segments' bits and the Golay code's generator polynomial.
SEGMENTS = (23, 23, 18)
GENERATOR = 0xAE3
#: Key rows that one task sorts at a time, and fingerprints whose keys a task holds before it hands them on.
BUCKET_ROWS = 2_000_000
HELD = 20_000


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words (fewer words: all of them) of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # both know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        fps = np.array([fingerprint(shingle_hashes(t)) for t in block.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of each row."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


class Golay:
    """Decodes 23-bit words to the index of the nearest codeword."""

    def __init__(self):
        powers = []
        for i in range(23):
            r = 1 << i
            for b in range(i, 10, -1):
                if r >> b & 1:
                    r ^= GENERATOR << (b - 11)
            powers.append(r)
        words = np.arange(1 << 12)
        self.low, self.high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(12):
            self.low ^= np.where(words >> i & 1, powers[i], 0)
        for i in range(11):
            self.high ^= np.where(words[: 1 << 11] >> i & 1, powers[12 + i], 0)
        self.error = np.zeros(1 << 11, np.int64)  # by syndrome
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = 1 << a | 1 << b | 1 << c
                    self.error[self.syndrome(np.int64(e))] = e

    def syndrome(self, word):
        return self.low[word & 0xFFF] ^ self.high[word >> 12]

    def index(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self.error[self.syndrome(word)]) >> 11

    def keys(self, word: np.ndarray, bits: int) -> np.ndarray:
        """A row of indices for each word, its own first: those of words up to one bit away; -1 where one repeats."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        out = np.sort(self.index(word[:, None] ^ flips), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        width = int((out >= 0).sum(axis=1).max()) if len(out) else 1
        return -np.sort(-out, axis=1)[:, :width]


_golay: list[Golay] = []


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (kind of key, what it fixes) and, for each, the place of its fingerprint."""
    if not _golay:
        _golay.append(Golay())
    shift, words, near = 0, [], []
    for bits in SEGMENTS:
        words.append((fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64))
        near.append(_golay[0].keys(words[-1], bits))
        shift += bits
    keys, of, kind = [], [], 0

    def add(key: np.ndarray, good: np.ndarray) -> None:
        nonlocal kind
        keys.append((np.int64(kind) << 40 | key)[good])
        of.append(np.nonzero(good)[0])
        kind += 1

    for i, j in ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)):  # segment i as it is, j up to one error
        add(words[i][:, None] << 12 | np.maximum(near[j], 0), near[j] >= 0)
    a, b = near[0][:, :, None], near[1][:, None, :]
    half = SEGMENTS[2] // 2
    for part in (words[2] & ((1 << half) - 1), words[2] >> half):  # one error in each segment: half of the third has none
        add((part[:, None, None] << 24) | (np.maximum(a, 0) << 12) | np.maximum(b, 0), (a >= 0) & (b >= 0))
    return np.concatenate(keys), np.concatenate(of)


def _keyed(parts: int):
    """Rows (part, keys, fps): many keys of one part in a row, as 8-byte integers."""

    def hand_on(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, of = pair_keys(fps)
        part = (common.mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, values, part = keys[order], fps[of[order]], part[order]
        lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        stop = np.append(lead[1:], len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[lead]), common.binary_array([keys[a:b].tobytes() for a, b in zip(lead, stop, strict=True)]), common.binary_array([values[a:b].tobytes() for a, b in zip(lead, stop, strict=True)])],
            names=["part", "keys", "fps"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield from hand_on(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield from hand_on(np.concatenate(held))

    return run


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest: distinct fingerprints joined where they differ in at most ERRORS bits."""
    out, left = [], fps
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ np.uint64(x)) <= ERRORS
            if near.any():
                found = left[near].tolist()
                out += [(x, y) for y in found]
                queue += found
                left = left[~near]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    if len(keys) < 2:
        return fps[:0], fps[:0]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(lead, len(keys)))
    a, b = [], []
    whole = np.repeat(size, size)
    for d in range(1, 6):  # small buckets: each member with the next ones
        i = np.flatnonzero((whole[:-d] <= 6) & (keys[d:] == keys[:-d])) if len(keys) > d else np.zeros(0, np.int64)
        near = np.bitwise_count(fps[i] ^ fps[i + d]) <= ERRORS
        a.append(fps[i][near])
        b.append(fps[i + d][near])
    more: list[tuple[int, int]] = []
    for s, n in zip(lead[size > 6].tolist(), size[size > 6].tolist(), strict=True):
        more += forest(fps[s : s + n])
    a.append(np.array([x for x, _ in more], np.uint64))
    b.append(np.array([y for _, y in more], np.uint64))
    pairs = np.unique(np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], axis=1), axis=0) if sum(map(len, a)) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, keys, fps = None, [], []

    def out() -> pa.RecordBatch:
        a, b = bucket_links(np.concatenate(keys), np.concatenate(fps))
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    for batch in batches:
        for part, k, f in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "fps")), strict=True):
            if part != now and keys:
                yield out()
                keys, fps = [], []
            now = part
            keys.append(np.frombuffer(k, np.int64))
            fps.append(np.frombuffer(f, np.uint64))
    if keys:
        yield out()


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that keep every component of the graph of at most ERRORS bits together."""
    parts = max(common.partitions(distinct), n * 110 // BUCKET_ROWS + 1)
    keyed = distinct.select("fp").mapInArrow(_keyed(parts), "part long, keys binary, fps binary")
    dealt = keyed.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for all nodes of the edges (a, b)."""
    edges = common.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: larger neighbours go to the smallest one
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.cut(moved.union(least.select("u", "m")).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()


def golay_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of each row."""
    held = common.stored(fingerprints(docs), "fingerprints")
    distinct = common.cut(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = common.cut(links(distinct, distinct.count()))
    found = components(edges).join(distinct, F.col("node") == F.col("fp"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    label = found.select("fp", "root").join(least, "root").select("fp", "component_id")
    whole = distinct.join(label, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return held.join(whole, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
