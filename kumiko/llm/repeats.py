"""Exact search for repeated windows (runs of units: bytes or words) over a whole corpus, without a row for each window.

Shared by the two operators that remove repeated passages. The plan:

1. Each window of `size` units picks an anchor: its k-gram with the least hash, the leftmost of ties. Equal windows pick
   equal anchors at equal offsets, and neighbouring windows mostly share one, so there are about 2 / (size - k + 2) anchors
   a unit. A row is an anchor's hash `h`, the hash `c` of all units that its windows span, and where they are.
2. Equal rows (h, c) of a block are combined before the shuffle: one goes on for all, the others are settled there. Then the
   rows are sorted by (h, c). Anchors with an equal span (a class) have equal windows, so those are settled at once;
   copies of a document, however many, stop here. Anchors whose `h` stands once have no repeated window and go.
3. What is left is one member of each class where an `h` has several classes: places where a passage begins or ends. Their
   spans are read from the texts again and compared in blocks by the operator's own method.

An `h` of more than HOT classes doesn't go into one block: its windows are dealt out in short runs, by a hash of what all windows
of a run have in common, and go through the same comparison; equal windows stand in equal runs. A group of runs that is longer than
a block is dealt out once more, its windows one by one, by a hash of the window. Where a block of equal windows grows too long, the
first of them goes on into the next block for the others to be compared with. So no step holds a group of unbounded size, and every
window is judged.

Which members a class has is told by its 64-bit hashes `h` and `c`; the operator's own comparison sees one member of each class
where windows may also repeat in another class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Odd multiplier of the rolling hash, its inverse modulo 2 ** 64, and the units that one vectorised step works on.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 18
#: Classes of one anchor hash up to which they are compared in one block, and the units of a block.
HOT = 1 << 11
BLOCK_UNITS = 200_000
#: A hot hash's windows are dealt out in runs of a window's length divided by this.
RUNS = 10
#: Bytes of text whose anchors are combined before the shuffle: what bounds the rows that one passage of all texts can have.
HELD_BYTES = 16 << 20
#: An anchor's row packs a, m (12 bits each) and two flags: it needs no comparison; its class has other members in its block.
SETTLED, MORE = 1 << 24, 1 << 25
#: Where a span starts is a long: 23 bits of the text's hash, which tell rows of equal doc_id apart, and 40 bits of position.
POSITION_BITS = 40

_UP, _DOWN = common.powers(BASE, CHUNK + 4096), common.powers(INVERSE, CHUNK + 4096)
_BYTE = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bytes_as_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (one more at the end)."""
    word = ~_space(data)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    before[ends] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word
    after[ends] = False
    stops = np.flatnonzero(word & ~after[1:]) + 1
    return starts, stops, np.searchsorted(starts, ends)


def words_as_units(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(stops, lo + CHUNK, side="right")))
        hi = int(stops[to - 1])
        up, down = (_UP, _DOWN) if hi - lo < len(_UP) else (common.powers(BASE, hi - lo + 1), common.powers(INVERSE, hi - lo + 1))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[at:to] - lo, stops[at:to] - lo
        out[at:to] = common.mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def anchors(units: np.ndarray, ends: np.ndarray, size: int, k: int) -> dict[str, np.ndarray]:
    """The anchors of all windows of `size` units that lie within one text; `ends`: where each text starts, and the last end.

    Returns arrays, one value an anchor: h, c, text (index), start (unit in the text where its first window starts),
    a (units from there to the k-gram), m (windows).
    """
    parts: list[tuple[np.ndarray, ...]] = []
    reach = size - k + 1
    # windows that cross a text's end don't count
    stop = np.repeat(np.maximum(ends[1:] - size + 1, ends[:-1]), np.diff(ends)) if len(units) else np.zeros(0, np.int64)
    for lo in range(0, max(0, len(units) - size + 1), CHUNK):
        n = min(CHUNK, len(units) - size + 1 - lo)  # windows
        span = n + size - 1
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(units[lo : lo + span] * _UP[:span], out=total[1:])
        grams = span - k + 1
        hashed = common.mixed((total[k:] - total[:grams]) * _DOWN[:grams])
        # position in the low bits: one minimum finds the least hash and its leftmost place
        best = (hashed & np.uint64(0xFFFFFFFFFF000000)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= reach:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < reach:
            best = np.minimum(best[: len(best) - (reach - width)], best[reach - width :])
        place = (best[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        good = np.arange(lo, lo + n) < stop[lo : lo + n]
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | ~good[:-1]
        first = np.flatnonzero(good & new)
        if not len(first):
            continue
        last_ok = np.ones(n, bool)
        last_ok[:-1] = (place[1:] != place[:-1]) | ~good[1:]
        last = np.flatnonzero(good & last_ok)
        # two texts may share neither a window nor a run: a run also ends where a text's windows end
        p, m = place[first], last - first + 1
        c = common.mixed((total[last + size] - total[first]) * _DOWN[first] + common.mixed(((p - first) << 16 | m).astype(np.uint64)))
        parts.append((hashed[p], c, first + lo, p - first, m))
    if not parts:
        none = np.zeros(0, np.int64)
        return {"h": none, "c": none, "text": none, "start": none, "a": none, "m": none}
    h, c, start, a, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.searchsorted(ends, start, side="right") - 1
    return {"h": h.view(np.int64), "c": c.view(np.int64), "text": text, "start": start - ends[text], "a": a, "m": m}


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of a short run of units."""
    n = len(units)
    up, down = (_UP, _DOWN) if n < len(_UP) else (common.powers(BASE, n + 1), common.powers(INVERSE, n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(units * up[:n], out=total[1:])
    return common.mixed((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


class Kind:
    """What the search works on: bytes or words."""

    def __init__(self, name: str, size: int, k: int, earlier: bool):
        if not 0 < k <= size < 4096:
            raise ValueError("k must be within the window, and a window under 4096 units")
        self.name, self.size, self.k, self.earlier = name, size, k, earlier

    def run(self) -> int:
        """Windows of a run at most, where an anchor's windows are dealt out."""
        return max(1, self.size // RUNS)

    def units(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the units and where each text's units start."""
        if self.name == "bytes":
            return bytes_as_units(data), ends
        starts, stops, firsts = word_bounds(data, ends)
        return words_as_units(data, starts, stops), firsts

    def raw(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a segment is cut from: the bytes, or the words' hashes."""
        return (data, ends) if self.name == "bytes" else self.units(data, ends)


def _mark(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 0x7FFFFF) << POSITION_BITS


#: Null doc_ids are told apart by their text while rows are joined by doc_id: they take the first ids of all (which are taken for
#: null), so that texts without ids don't meet in one task.
NO_ID, NO_IDS = -(1 << 63), 1 << 39


def given_id(doc_id: Column) -> Column:
    """The id, or null where `marked` has put another in its place."""
    return F.when(doc_id >= NO_ID + NO_IDS, doc_id)


def marked(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the text and its mark, which tells rows of one doc_id apart; and, if asked for, the whole row in `row`."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    # never null as Spark sees it, so both joins of the texts read one exchange
    cols = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).bitwiseOR(mark.bitwiseAND(F.lit(NO_IDS - 1)))).alias("doc_id"), F.col("text"), mark.alias("mark")]
    # the text isn't carried twice
    return docs.select(*cols, *([F.struct(*(c for c in docs.columns if c != "text")).alias("row")] if carry else []))


_ANCHORS = "h long, c long, doc_id long, at long, am int"


def _anchor_rows(kind: Kind) -> Callable:
    def rows(held: list[tuple]) -> pa.RecordBatch:
        h, c, doc, at, am = (np.concatenate(x) for x in zip(*held, strict=True))
        h, flags, keep = _combined(h, c, doc, at, kind.earlier)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, c, doc, at, (flags | am).astype(np.int32))], names=["h", "c", "doc_id", "at", "am"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for block in common.blocks(batches):
            data, ends = common.utf8(block.column("text"))
            got = anchors(*kind.units(data, ends), kind.size, kind.k)
            size += len(data)
            if len(got["h"]):
                at = _mark(block.column("mark").to_numpy())[got["text"]] | got["start"]
                held.append((got["h"], got["c"], block.column("doc_id").to_numpy()[got["text"]], at, got["a"] << 12 | got["m"]))
            if held and size >= HELD_BYTES:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return run


def _combined(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settles all but the first of equal (h, c): h of each row (settled ones are dealt anywhere), flags, and which rows stay."""
    order = np.lexsort((at, doc, c, h))
    hs, cs, docs, ats = h[order], c[order], doc[order], at[order]
    same = np.zeros(len(h), bool)
    same[1:] = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
    lead = np.flatnonzero(~same)
    of = np.repeat(lead, np.diff(np.append(lead, len(h))))
    twin = same & (docs == docs[of]) & (ats == ats[of])  # a repeated row of one document
    flags = np.where(same, SETTLED, 0)
    followed = np.zeros(len(h), bool)
    followed[:-1] = same[1:]
    flags[~same & followed] |= MORE
    out_h, out_flags, keep = h.copy(), np.zeros(len(h), np.int64), np.ones(len(h), bool)
    out_h[order] = np.where(same, common.mixed((docs + ats * 31).view(np.uint64)).view(np.int64), hs)
    out_flags[order] = flags
    if earlier:
        keep[order] = ~twin
    return out_h, out_flags, keep


def _segment_rows(kind: Kind) -> Callable:
    """Reads the spans of open anchors from the texts: one row with the span, or for hot hashes one for each run of windows."""
    most = kind.run()
    core = kind.size - most + 1  # what all windows of a run have in common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            data, ends = common.utf8(block.column("text"))
            raw, firsts = kind.raw(data, ends)
            marks = _mark(block.column("mark").to_numpy()).tolist()
            out: list[tuple] = []
            for i, (doc, wanted) in enumerate(zip(block.column("doc_id").to_pylist(), block.column("open").to_pylist(), strict=True)):
                for x in wanted or ():
                    if x["at"] >> POSITION_BITS << POSITION_BITS != marks[i]:
                        continue
                    start, m = firsts[i] + (x["at"] & ((1 << POSITION_BITS) - 1)), x["am"] & 0xFFF
                    piece = raw[start : start + m + kind.size - 1]
                    if not x["hot"]:
                        out.append((x["h"], 0, doc, x["at"], x["am"], x["several"], piece.tobytes()))
                    else:
                        a = x["am"] >> 12 & 0xFFF
                        hashes = window_hashes(bytes_as_units(piece) if kind.name == "bytes" else piece, core).view(np.int64)
                        j = 0
                        while j < m:  # windows of offsets r * most to r * most + most - 1, counted to the anchor's k-gram
                            r = (a - j) // most
                            to = min(m, a - r * most + 1)
                            w = int(hashes[a - r * most]) ^ r  # the core starts where the run's last window would
                            out.append((x["h"], w or 1, doc, x["at"] + j, a - j << 12 | to - j, x["several"], piece[j : to + kind.size - 1].tobytes()))
                            j = to
                    if len(out) >= 2000:
                        yield _segments(out)
                        out = []
            if out:
                yield _segments(out)

    return run


_SEGMENT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
_SEGMENT_NAMES = ["h", "w", "doc_id", "at", "am", "several", "piece"]
_SEGMENTS = "h long, w long, doc_id long, at long, am int, several boolean, piece binary"


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SEGMENT_TYPES, strict=True)], names=_SEGMENT_NAMES)


def _spans(doc: list, at: list, n: list) -> pa.RecordBatch:
    """Windows that repeat, as rows without a piece, dealt anywhere; am holds how many stand in a row."""
    return _segments([(d, 0, d, x, k, False, None) for d, x, k in zip(doc, at, n, strict=True)])


def _single_windows(row: tuple, kind: Kind) -> Iterator[tuple]:
    """A row for each window of a run, dealt by the window's hash."""
    h, _, doc, at, am, several, piece = row
    raw = np.frombuffer(piece, np.uint8 if kind.name == "bytes" else np.uint64)
    for j, w in enumerate(window_hashes(bytes_as_units(raw) if kind.name == "bytes" else raw, kind.size).view(np.int64).tolist()):
        yield h, w or 1, doc, at + j, (am >> 12 & 0xFFF) - j << 12 | 1, several, raw[j : j + kind.size].tobytes()


def _compared(kind: Kind, judge: Callable, last: bool = True) -> Callable:
    """Rows come sorted by (h, w, doc_id, at); gives the spans of windows that repeat (see _spans; such rows pass through).

    Unless this is the `last` comparison, a group of runs longer than a block isn't judged: its windows go on one by one. In the last
    one all windows of a group that has a hash `w` are equal.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        # equal windows stand in one group, and in different spans of it
        rows = [r for i, r in enumerate(rows) if i and rows[i - 1][:2] == r[:2] or i + 1 < len(rows) and rows[i + 1][:2] == r[:2]]
        if not rows:
            return None
        group, doc, at, am, piece = ([r[i] for r in rows] for i in (0, 2, 3, 4, 6))
        m = np.array([x & 0xFFF for x in am], np.int64)
        a = np.array([x >> 12 & 0xFFF for x in am], np.int64)
        lengths = m + kind.size - 1
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        units = np.frombuffer(b"".join(piece), np.uint8 if kind.name == "bytes" else np.uint64)
        windows = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        owner = np.repeat(np.arange(len(m)), m)
        several = np.array([r[5] for r in rows], bool)
        bad = judge(units, np.array(group, np.int64), windows, owner, a[owner] - (windows - firsts[owner]), kind)
        if not kind.earlier:
            bad &= ~several[owner]  # those are settled; they only stand here for others to be compared with
        if not bad.any():
            return None
        step = np.flatnonzero(bad)
        new = np.ones(len(step), bool)
        new[1:] = (np.diff(step) != 1) | (np.diff(owner[step]) != 0)
        lead = np.flatnonzero(new)
        n = np.diff(np.append(lead, len(step)))
        who = owner[step[lead]]
        return _spans([doc[i] for i in who.tolist()], [at[i] + int(j) for i, j in zip(who.tolist(), (windows[step[lead]] - firsts[who]).tolist(), strict=True)], n.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, and the group that goes on
        on: list[tuple] = []  # rows that go on to the last comparison
        units, mine, now, before, first, wide = 0, 0, None, None, None, False
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _SEGMENT_NAMES), strict=True):
                if row[6] is None:
                    on.append(row)
                else:
                    same = row[:2] == now
                    if same and before == row[2:4]:  # a repeated row of one document
                        continue
                    before = row[2:4]
                    if not same:
                        now, first, mine, wide = row[:2], row, 0, False
                    if units >= BLOCK_UNITS and (not same or last and row[1]):
                        if (out := flush(held)) is not None:
                            yield out
                        held = [first] if same else []  # the others are compared with it
                        units = kind.size * len(held)
                    if wide:
                        on.extend(_single_windows(row, kind))
                    else:
                        held.append(row)
                        length = (row[4] & 0xFFF) + kind.size
                        units, mine = units + length, mine + length
                        if row[1] and not last and mine >= BLOCK_UNITS:
                            wide = True
                            while held and held[-1][:2] == now:
                                on.extend(_single_windows(held.pop(), kind))
                            units -= mine
                if len(on) >= 2000:
                    for k in range(0, len(on), 2000):
                        yield _segments(on[k : k + 2000])
                    on = []
        if on:
            yield _segments(on)
        if held and (out := flush(held)) is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, kind: Kind, judge: Callable, carry: bool = False) -> DataFrame:
    """The texts by doc_id (doc_id, text, mark, row, settled, found), where the two arrays hold what repeats.

    `settled` and `found` are arrays of (at, n): n windows in a row that repeat, the first at unit `at` of the text with
    that mark. `judge(units, group, windows, owner, offset, kind)` compares one block: it gets all units of the block's
    spans, each span's anchor hash, and for each window its first unit, its span and its offset, and says which repeat
    (with kind.earlier: which also stand in an earlier span).
    """
    common.small_batches(docs.sparkSession)
    n = common.partitions(docs)
    texts = marked(docs, carry)
    rows = marked(docs).mapInArrow(_anchor_rows(kind), _ANCHORS).repartition(n, "h")
    in_class = Window.partitionBy("h", "c").orderBy("doc_id", "at")
    in_hash = Window.partitionBy("h")
    first = F.first(F.struct("doc_id", "at")).over(in_class)
    judged = (
        rows.withColumn("first", F.row_number().over(in_class) == 1)
        .withColumn("later", ~F.struct("doc_id", "at").eqNullSafe(first))
        .withColumn("more", F.lead(F.lit(True), 1, False).over(in_class))
        .withColumn("classes", F.sum(F.col("first").cast("int")).over(in_hash))
    )
    settled = F.col("am").bitwiseAND(SETTLED) != 0
    several = F.col("more") | (F.col("am").bitwiseAND(MORE) != 0)
    dup = settled | F.col("later") if kind.earlier else settled | ~F.col("first") | several
    kept = judged.withColumn("dup", dup).withColumn("open", ~settled & F.col("first") & (F.col("classes") > 1)).filter("dup or open")
    table = common.stored(kept.select("doc_id", "h", "at", "am", "dup", "open", (F.col("classes") > HOT).alias("hot"), several.alias("several")), "anchors")
    by_doc = table.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("open"), F.struct("h", "at", "am", "hot", "several"))).alias("open"),
        F.collect_list(F.when(F.col("dup"), F.struct("at", F.col("am").bitwiseAND(0xFFF).alias("n")))).alias("settled"),
    )
    held = texts.repartition(n, "doc_id")
    open_texts = held.join(by_doc.filter(F.size("open") > 0).select("doc_id", "open"), "doc_id")
    pieces = open_texts.mapInArrow(_segment_rows(kind), _SEGMENTS).repartition(n, "h", "w").sortWithinPartitions("h", "w", "doc_id", "at")
    singles = pieces.mapInArrow(_compared(kind, judge, last=False), _SEGMENTS).repartition(n, "h", "w").sortWithinPartitions("h", "w", "doc_id", "at")
    spans = singles.mapInArrow(_compared(kind, judge), _SEGMENTS).select("doc_id", "at", F.col("am").alias("n"))
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    return held.join(by_doc.select("doc_id", "settled"), "doc_id", "left").join(found, "doc_id", "left")


def covered(length: int, mark: int, size: int, *lists: list | None) -> np.ndarray:
    """Which of a text's units some repeated window covers."""
    edge = np.zeros(length + 1, np.int64)
    for spans in lists:
        for x in spans or ():
            if x["at"] >> POSITION_BITS << POSITION_BITS == mark:
                at = x["at"] & ((1 << POSITION_BITS) - 1)
                edge[at] += 1
                edge[at + x["n"] + size - 1] -= 1
    return np.cumsum(edge[:-1]) > 0
