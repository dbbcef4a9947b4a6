"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items become windows of `size` words. A window's words are ordered by rarity, counted over all documents. For exact
containment the necessary prefix of that order is one word, so each window is indexed by its rarest word. A document word that
is in the index gives candidates; the length bound (the window must fit into the document before and after that word) and the
positional bound (the rarest word stands at a fixed offset) place each candidate, which is then verified word by word.

The index goes to the executors in passes of at most PASS_WORDS benchmark words each, so its size is bounded whatever the
benchmark's; the passes are one chain over the documents, without a shuffle.

Defined results. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts have no words. An
item of fewer words than the window is one window; one of none never occurs. A null item_id counts as the empty string; items
that share an id count once. Rows stay one to one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
PASS_WORDS = 1_000_000
#: Every byte that isn't part of a word becomes a space, A-Z become a-z.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Index:
    """The distinct windows of some items, by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.items = sorted({i for i, _ in items})
        place = {i: n for n, i in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [self.vocabulary[w] for w in words]
            for s in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + size]), set()).add(place[item])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.windows = np.full((len(found), size), -1, np.int64)
        for i, w in enumerate(found):
            self.windows[i, : len(w)] = w
        self.of = [np.array(sorted(x), np.int64) for x in found.values()]

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest word (ties: the smaller word, then the first place) and indexes by it."""
        rank = np.lexsort((np.arange(len(counts)), counts))
        rarity = np.empty(len(counts) + 1, np.int64)
        rarity[rank] = np.arange(len(counts))
        rarity[-1] = len(counts)  # padding
        self.offset = np.argmin(rarity[self.windows], axis=1) if len(self.windows) else np.zeros(0, np.int64)
        key = self.windows[np.arange(len(self.windows)), self.offset]
        self.by_key = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.by_key], np.arange(len(counts) + 1))

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur in documents (`ends`: where each begins, and the last end), and which."""
        none = np.zeros(0, np.int64)
        at = np.flatnonzero(ids >= 0)
        many = self.first[ids[at] + 1] - self.first[ids[at]]
        at, many = at[many > 0], many[many > 0]
        starts, windows = [], []
        # candidates in pieces of bounded size
        total = np.cumsum(many)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 500_000)))
            p, n = at[lo:hi], many[lo:hi]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = self.by_key[np.repeat(self.first[ids[p]], n) + inner]
            s = np.repeat(p, n) - self.offset[w]
            doc = np.searchsorted(ends, np.repeat(p, n), side="right") - 1
            ok = (s >= ends[doc]) & (s + self.lengths[w] <= ends[doc + 1])
            s, w = s[ok], w[ok]
            for j in range(self.windows.shape[1]):
                want = self.windows[w, j]
                ok = (want < 0) | (ids[np.minimum(s + j, len(ids) - 1)] == want)
                s, w = s[ok], w[ok]
                if not len(s):
                    break
            starts.append(s)
            windows.append(w)
            lo = hi
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (none, none)


def _counts(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        for block in common.blocks(batches):
            words: list[bytes] = []
            for text in block.column("text").to_pylist():
                words += words_of(text)
            total += np.bincount(index.ids(words) + 1, minlength=len(total))
        seen = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[1:][seen])], names=["word", "n"])

    return run


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            words: list[bytes] = []
            ends = [0]
            for text in block.column("text").to_pylist():
                words += words_of(text)
                ends.append(len(words))
            bounds = np.array(ends)
            starts, windows = index.matches(index.ids(words), bounds)
            doc = np.searchsorted(bounds, starts, side="right") - 1
            order = np.argsort(doc, kind="stable")
            starts, windows, cut = starts[order], windows[order], np.searchsorted(doc[order], np.arange(block.num_rows + 1))
            spans, items = [], []
            for i, (old_spans, old_items) in enumerate(zip(block.column("spans").to_pylist(), block.column("items").to_pylist(), strict=True)):
                a, b = cut[i], cut[i + 1]
                s, w = starts[a:b], windows[a:b]
                # spans as start, end, start, end: union within the document
                edge = np.zeros(ends[i + 1] - ends[i] + 1, np.int64)
                np.add.at(edge, s - ends[i], 1)
                np.add.at(edge, s - ends[i] + index.lengths[w], -1)
                for x, y in zip(old_spans[::2], old_spans[1::2], strict=True):
                    edge[x] += 1
                    edge[y] -= 1
                hit = np.cumsum(edge) > 0
                spans.append(np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8))).tolist())
                here = {j for x in np.unique(w).tolist() for j in index.of[x].tolist()}
                items.append(old_items + [index.items[j] for j in here])
            new = {"n_words": pa.array(np.diff(bounds)), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            names = block.schema.names
            yield pa.RecordBatch.from_arrays([new[c] if c in new else block.column(c) for c in names], names=names)

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )


def _found(texts: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """The rows (doc_id, text and others) with n_words, spans and items."""
    spark = texts.sparkSession
    common.small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    passes = max(1, -(-n_bytes // (PASS_WORDS * 2)))  # a word and what parts it from the next are two bytes at least
    out = texts.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()  # a pass's share of the benchmark
        index = Index([(r["item_id"], words_of(r["text"])) for r in part], size)
        counts = np.zeros(len(index.vocabulary), np.int64)
        for word, n in texts.select("text").mapInArrow(_counts(index), "word long, n long").groupBy("word").agg(F.sum("n")).collect():
            counts[word] = n
        index.order(counts)
        out = out.mapInArrow(_search(index), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (ids found, sorted) and spans (first word and end of
    each hit run, in turn) of each row of `docs`."""
    out = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size)
    return out.mapInArrow(_summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of `docs` (with all columns) that no window of the benchmark occurs in."""
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    clean = _found(docs.select("text", row), benchmark, size).filter(F.size("spans") == 0)
    return clean.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
