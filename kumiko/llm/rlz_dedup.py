"""Substring duplicates by relative Lempel-Ziv parsing over words.

Spans of documents that share an anchor are a block (see repeats.py), in order of (doc_id, place); what stands before a span is
its reference. Each span is factored greedily: from a word on, the match with the reference's indexed place is taken as far as
words agree (`factors`); where a factor ends, runs across its boundary are looked up once more, so one that the reference has
elsewhere isn't missed. Factors of `window` words or more are the duplicate spans. Members of one class (equal spans) get what
their hashes say, without a parse of each; see repeats.py.

Defined results. Words are runs of bytes other than the six ASCII white spaces, compared by 64-bit hashes. Null and empty
texts have no words. Texts with fewer words than the window keep all. Rows with equal doc_id and text are one document with
the same result; of two texts under one doc_id one counts as first. Null doc_ids stand before all others, in order of a hash
of their text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

#: Words of a window, and of the k-gram that anchors it.
WINDOW, GRAM = 20, 6


def factors(units: np.ndarray, begins: np.ndarray, ends: np.ndarray, group: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy factors (place, source, length) of each span relative to what stands before in its group, of `size` units or more.

    The reference's runs of `size` units are indexed by their first places. From a unit on whose run is in the index, the match
    with that place is taken as far as units agree within both spans; a match shorter than `size` (runs of one hash that
    differ) is none. The next factor may begin at the first run that the last one doesn't hold whole: so runs across a
    factor's boundary are looked up too, and one that the reference has elsewhere begins a factor of its own.
    """
    runs = np.maximum(ends - begins - size + 1, 0)
    owner = np.repeat(np.arange(len(begins)), runs)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + begins[owner]
    if not len(place):
        return []
    hashed = repeats.window_hashes(units, size)[place] + common.mixed(group[owner].view(np.uint64))
    _, first, where = np.unique(hashed, return_index=True, return_inverse=True)
    indexed = first[where]  # the first run of the same hash
    out, after = [], -1
    for w in np.flatnonzero(indexed < np.arange(len(place))).tolist():
        at, source = int(place[w]), int(indexed[w])
        if at < after:  # within the last factor
            continue
        source, room = int(place[source]), int(ends[owner[w]]) - at
        room = min(room, int(ends[owner[indexed[w]]]) - source)
        differs = np.flatnonzero(units[at : at + room] != units[source : source + room])
        length = int(differs[0]) if len(differs) else room
        if length >= size:
            out.append((at, source, length))
            after = at + length - size + 1
    return out


def _later(units: np.ndarray, group: np.ndarray, windows: np.ndarray, owner: np.ndarray, offset: np.ndarray, kind: repeats.Kind) -> np.ndarray:
    """Spans stand in order of (anchor, doc_id, place), so what stands before a span is its reference."""
    lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    begins, ends = windows[lead], windows[np.append(lead[1:], len(windows)) - 1] + kind.size
    edge = np.zeros(len(units) + 1, np.int64)
    for at, _, length in factors(units, begins, ends, group, kind.size):
        edge[at] += 1
        edge[at + length - kind.size + 1] -= 1
    return (np.cumsum(edge[:-1]) > 0)[windows]


def _reduce(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            data, ends = common.utf8(block.column("text"))
            starts, stops, firsts = repeats.word_bounds(data, ends)
            raw = data.tobytes()
            marks = repeats._mark(block.column("mark").to_numpy()).tolist()
            rows = []
            for i, (settled, found) in enumerate(zip(block.column("settled").to_pylist(), block.column("found").to_pylist(), strict=True)):
                a, b = starts[firsts[i] : firsts[i + 1]], stops[firsts[i] : firsts[i + 1]]
                cover = repeats.covered(len(a), marks[i], size, settled, found)
                left = ~cover
                kept = b" ".join([raw[x:y] for x, y in zip(a[left].tolist(), b[left].tolist(), strict=True)])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
                rows.append((len(a), int(cover.sum()), hashlib.sha256(kept).hexdigest(), edge.astype(np.int64).tolist(), kept.decode() if with_text else None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "edges", "kept_text"],
            )

    return run


def rlz_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Removes the words of every `window`-word sequence that also starts earlier (smaller doc_id, or earlier in the text).

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), edges (first word and end of each removed
    run, in turn) and, if `with_text`, kept_text; one row for each row of `docs`.
    """
    kind = repeats.Kind("words", window, gram, earlier=True)
    spans = repeats.repeated_spans(docs, kind, _later)
    out = spans.mapInArrow(_reduce(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, edges array<long>, kept_text string")
    return out.withColumn("doc_id", repeats.given_id(F.col("doc_id")))
