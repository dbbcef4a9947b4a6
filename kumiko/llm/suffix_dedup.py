"""Substring duplicates by suffix arrays that are built in two stages.

`two_stage_suffix_array` types each suffix by its successor: the suffixes smaller than their successors are sorted directly,
all others are induced from them by one scan over the buckets of first bytes. `adjacent_prefixes` then gives what neighbours
have in common. A corpus-wide array isn't built: repeats.py brings the spans that can hold a repeated window into blocks of
bounded size, and each block gets its array. A window repeats where neighbours share all of its bytes.

Defined results. Null and empty texts: no bytes, nothing removed. Rows with equal doc_id and text are two documents (each
repeats the other). Extra columns are ignored. A window lies within one text; a text shorter than the window keeps all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

#: Bytes of a window, and of the k-gram that anchors it.
WINDOW, GRAM = 200, 40


def two_stage_suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions of all suffixes of a uint8 array, in order of their first `depth` bytes at least (None: whole).

    A suffix that ends is smaller than any that goes on. Suffixes equal over `depth` bytes stand together, in any order.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    # smaller than the successor: the next differing byte is larger; runs of equal bytes take their end's type
    run_end = np.ones(n, bool)
    run_end[:-1] = text[:-1] != text[1:]
    last = np.flatnonzero(run_end)
    rises = np.zeros(len(last), bool)
    rises[:-1] = text[last[:-1]] < text[last[1:]]
    runs = np.diff(np.concatenate([[-1], last]))
    smaller = np.repeat(rises, runs)
    to_end = np.repeat(last, runs) - np.arange(n)  # bytes until the run ends
    whole = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda i: whole[i : i + depth]), np.int64)
    counts = np.bincount(text, minlength=256)
    heads = np.concatenate([[0], np.cumsum(counts)])
    order = np.empty(n, np.int64)
    rank = np.empty(n, np.int64)
    # in each bucket of a first byte the larger-than-successor suffixes stand before the directly sorted ones
    of_byte = text[direct]
    for byte in np.flatnonzero(counts):
        mine = direct[of_byte == byte] if len(direct) else direct
        tail = heads[byte + 1]
        order[tail - len(mine) : tail] = mine
        rank[mine] = np.arange(tail - len(mine), tail)
    induced = np.flatnonzero(~smaller)
    induced = induced[np.argsort(text[induced], kind="stable")]
    bounds = np.searchsorted(text[induced], np.arange(257))
    for byte in np.flatnonzero(np.diff(bounds)):
        mine = induced[bounds[byte] : bounds[byte + 1]]
        # the end of a run depends on a smaller bucket that is complete by now; the rest of the run on its end
        at = heads[byte]
        depths = to_end[mine]
        ready = mine[depths == 0]
        after = np.where(ready + 1 < n, rank[np.minimum(ready + 1, n - 1)], -1)
        ready = ready[np.argsort(after, kind="stable")]
        rest = mine[depths > 0]
        pending = rest[np.argsort(to_end[rest], kind="stable")]
        limits = np.searchsorted(to_end[pending], np.arange(1, (int(to_end[pending].max()) if len(pending) else 0) + 2))
        k = 0
        while True:
            order[at : at + len(ready)] = ready
            rank[ready] = np.arange(at, at + len(ready))
            at += len(ready)
            if k + 1 >= len(limits) or limits[k] >= len(pending):
                break
            nxt = pending[limits[k] : limits[k + 1]]
            ready = nxt[np.argsort(rank[nxt + 1], kind="stable")]
            k += 1
    return order


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first of `order`, the bytes (`depth` at most) that it has in common with the one before."""
    n, out = len(text), np.zeros(max(0, len(order) - 1), np.int64)
    open_ = np.arange(len(out))
    words = np.ndarray(n, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))  # the 8 bytes from each place on
    for step in range(0, depth, 8):
        a, b = order[open_] + step, order[open_ + 1] + step
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        if not len(open_):
            break
        differs = words[a] ^ words[b]
        room = np.minimum(8, np.minimum(depth - step, n - np.maximum(a, b)))
        # bits below the lowest that differs: 64 where none does
        got = np.minimum(np.bitwise_count((differs & (~differs + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3, room)
        out[open_] += got
        open_ = open_[got == 8]
    return out


def _may_repeat(units: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """Which windows have a hash that another one has too; all that repeat are among them."""
    hashes = repeats.window_hashes(repeats.bytes_as_units(units), size)[windows]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(windows), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _repeated(units: np.ndarray, group: np.ndarray, windows: np.ndarray, owner: np.ndarray, offset: np.ndarray, kind: repeats.Kind) -> np.ndarray:
    out = np.zeros(len(windows), bool)
    open_ = np.flatnonzero(_may_repeat(units, windows, kind.size))
    if not len(open_):
        return out
    # the array is built of the bytes that these windows have
    starts = windows[open_]
    edge = np.zeros(len(units) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + kind.size, -1)
    inside = np.cumsum(edge[:-1]) > 0
    units, starts = units[inside], (np.cumsum(inside) - 1)[starts]
    order = two_stage_suffix_array(units, kind.size)
    slot = np.full(len(units), -1, np.int64)
    slot[starts] = np.arange(len(starts))
    order = order[slot[order] >= 0]
    equal = adjacent_prefixes(units, order, kind.size) >= kind.size
    bad = np.zeros(len(order), bool)
    bad[1:] |= equal
    bad[:-1] |= equal
    out[open_[slot[order[bad]]]] = True
    return out


def kept_bytes(data: bytes | np.ndarray, covered: np.ndarray) -> bytes:
    return np.asarray(data)[~covered].tobytes()


def _reduce(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            data, ends = common.utf8(block.column("text"))
            marks = repeats._mark(block.column("mark").to_numpy()).tolist()
            rows = []
            for i, (settled, found) in enumerate(zip(block.column("settled").to_pylist(), block.column("found").to_pylist(), strict=True)):
                mine = data[ends[i] : ends[i + 1]]
                cover = repeats.covered(len(mine), marks[i], size, settled, found)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
                kept = kept_bytes(mine, cover)
                rows.append((len(mine), int(cover.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype(np.int64).tolist(), kept.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges", "kept_text"],
            )

    return run


def _rewrite(size: int, columns: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            data, ends = common.utf8(block.column("text"))
            marks = repeats._mark(block.column("mark").to_numpy()).tolist()
            texts: list[str | None] = []
            for i, (old, settled, found) in enumerate(zip(block.column("text"), block.column("settled").to_pylist(), block.column("found").to_pylist(), strict=True)):
                cover = repeats.covered(int(ends[i + 1] - ends[i]), marks[i], size, settled, found)
                texts.append(kept_bytes(data[ends[i] : ends[i + 1]], cover).decode("utf-8", "ignore") if old.is_valid else None)
            row = block.column("row")
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([(new[c] if c in new else row.field(c)).cast(t) for c, t in zip(columns, types, strict=True)], names=columns)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` with all columns, their text (and n_chars, where there is one) without what repeats."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = repeats.Kind("bytes", window, gram, earlier=False)
    spans = repeats.repeated_spans(docs, kind, _repeated, carry=True)
    return spans.mapInArrow(_rewrite(window, docs.columns, [to_arrow_type(f.dataType) for f in docs.schema.fields]), docs.schema)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Removes every byte that a `window`-byte string covers which also starts elsewhere in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges (start and end of each removed run, in turn) and, if
    `with_text`, kept_text (the remaining bytes; what is left of a cut character is dropped), one row for each row.
    """
    kind = repeats.Kind("bytes", window, gram, earlier=False)
    spans = repeats.repeated_spans(docs, kind, _repeated)
    out = spans.mapInArrow(_reduce(window, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>, kept_text string")
    return out.withColumn("doc_id", repeats.given_id(F.col("doc_id")))
