import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import kumiko.llm.rlz_dedup as rlz_dedup_module
import kumiko.llm.suffix_dedup as suffix_dedup_module
from kumiko.llm import repeats
from kumiko.llm.rlz_dedup import factors, rlz_dedup
from kumiko.llm.suffix_dedup import adjacent_prefixes, suffix_dedup, two_stage_suffix_array

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(rows, size):
    docs = sorted(set(rows), key=lambda r: (-1 << 64 if r[0] is None else r[0]))
    seen, out = set(), {}
    for doc, text in docs:
        words = SPACE.findall((text or "").encode())
        bad = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                bad[i : i + size] = [True] * size
            seen.add(w)
        kept = b" ".join(w for w, b in zip(words, bad) if not b)
        out[doc, text] = (len(words), sum(bad), hashlib.sha256(kept).hexdigest())
    return sorted(((d, *out[d, t]) for d, t in rows), key=str)


def brute_bytes(rows, size):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        bad = [False] * len(b)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                bad[i : i + size] = [True] * size
        spans = sum(x and not y for x, y in zip(bad, [False, *bad]))
        out.append((doc, len(b), sum(bad), spans, hashlib.sha256(bytes(x for x, y in zip(b, bad) if not y)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, words):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ab", "é", "ti", "on", "x"]) for _ in range(r.randint(1, 3)))
    passages = [" ".join(word() for _ in range(words)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, words * 2))))
            if r.random() < 0.3:
                cut = r.choice(passages).split(" ")
                parts.append("\n".join(cut[r.randint(0, words // 2) :]))
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " tail"), (n + 2, ""), (n + 3, None), (None, rows[5][1]), (n + 4, "ab " * 200), (n + 5, "a" * 900), (n + 6, rows[6][1]), (n + 6, rows[6][1]), (n + 7, "  \t\n")]
    return rows


SCHEMA = "doc_id long, text string, h int, at string"


@pytest.mark.parametrize("seed,hot", [(1, 1024), (2, 2), (3, 1)])
def test_words(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed, 60, 12)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = rlz_dedup(df, window=8, gram=3).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, 8)


@pytest.mark.parametrize("seed,hot", [(1, 1024), (2, 2), (3, 1)])
def test_bytes(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed, 60, 12)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    if seed == 3:
        monkeypatch.setattr(repeats, "BLOCK_UNITS", 100)  # blocks of equal windows are cut as well
    got = suffix_dedup(df, window=30, gram=10).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 30)


def test_chunks_do_not_matter(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 700, 700, 2300, 2310, 5000])
    units = repeats.bytes_as_units(data)

    def windows(got):
        return sorted((h, t, s + j, s + a) for h, t, s, a, m in zip(*(got[k].tolist() for k in ("h", "text", "start", "a", "m"))) for j in range(m))

    whole = windows(repeats.anchors(units, ends, 30, 10))
    monkeypatch.setattr(repeats, "CHUNK", 256)
    assert windows(repeats.anchors(units, ends, 30, 10)) == whole
    assert len(whole) == sum(max(0, n - 29) for n in np.diff(ends))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rlz_dedup(df).count() == 0 and suffix_dedup(df).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    r = np.random.default_rng(letters)
    for n in (0, 1, 2, 7, 500):
        t = r.integers(97, 97 + letters, n).astype(np.uint8)
        b = t.tobytes()
        order = two_stage_suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        want = []
        for i, j in zip(order, order[1:]):
            k = 0
            while k < 50 and max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            want.append(k)
        assert adjacent_prefixes(t, order, 50).tolist() == want
        deep = two_stage_suffix_array(t, 5)
        assert [b[i : i + 5] for i in deep] == sorted(b[i : i + 5] for i in range(n))


def parsed(units, spans, size, group=None):
    begins, ends = (np.array(x) for x in zip(*spans))
    return factors(np.array(units, np.uint64), begins, ends, np.zeros(len(spans), np.int64) if group is None else np.array(group), size)


def test_factors():
    # a whole match, extended beyond one window; then one whose first word has no source
    assert parsed([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], [(0, 5), (5, 10)], 3) == [(5, 0, 5)]
    assert parsed([1, 2, 3, 4, 5, 9, 2, 3, 4, 5], [(0, 5), (5, 10)], 3) == [(6, 1, 4)]
    # shorter than a window: no factor; another group: no reference
    assert parsed([1, 2, 3, 4, 1, 2, 8, 9], [(0, 4), (4, 8)], 3) == []
    assert parsed([1, 2, 3, 1, 2, 3], [(0, 3), (3, 6)], 3, [1, 2]) == []
    # a run across the boundary of a factor that stands elsewhere in the reference
    units = [1, 2, 3, 4, 7, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6]
    assert parsed(units, [(0, 5), (5, 9), (9, 15)], 3) == [(9, 0, 4), (11, 5, 4)]
    # a span is its own reference too
    assert parsed([1, 1, 1, 1, 1], [(0, 5)], 2) == [(1, 0, 4)]


def test_wrong_hashes_give_no_factor(monkeypatch):
    monkeypatch.setattr(repeats, "window_hashes", lambda units, size: np.zeros(len(units) - size + 1, np.uint64))
    assert parsed([1, 2, 3, 4, 5, 6], [(0, 3), (3, 6)], 3) == []


@pytest.mark.parametrize("module,name,none", [(rlz_dedup_module, "factors", []), (suffix_dedup_module, "adjacent_prefixes", None)])
def test_the_method_decides(spark, monkeypatch, module, name, none):
    """Without the operator's own comparison, repeats across classes are lost."""
    rows = corpus(1, 60, 12)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = []

    def counted(units, group, windows, owner, offset, kind, judge=module._later if none == [] else module._repeated):
        found.append(int(judge(units, group, windows, owner, offset, kind).sum()))
        return found[-1]

    units, ends = np.arange(40, dtype=np.uint64) % 20, np.array([0, 20, 40])
    if none is None:
        units = units.astype(np.uint8) + 97
    windows, owner = np.array([0, 1, 2, 20, 21, 22]), np.repeat([0, 1], 3)
    args = (units, np.zeros(2, np.int64), windows, owner, windows * 0, repeats.Kind("words" if none == [] else "bytes", 18, 3, none == []))
    assert counted(*args) == (3 if none == [] else 6)
    monkeypatch.setattr(module, name, lambda *a: none if none is not None else np.zeros(max(0, len(a[1]) - 1), np.int64))
    assert counted(*args) == 0


def test_many_texts_without_ids(spark):
    rows = [(None, f"{i} " + "the same eight words stand in each of them " * 2) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert repeats.marked(df).select("doc_id").distinct().count() == 40
    got = suffix_dedup(df, window=30, gram=10).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 30)


def long_passage_in_many_texts(n):
    """Spans around one passage of 197 bytes, no two texts of which share a window but the last two."""
    r = random.Random(7)
    other = lambda k: bytes(r.choice(b"klmnop") for _ in range(k))
    passage = bytes(r.choice(b"abcdef") for _ in range(197))
    texts = [other(180) + bytes([48 + i]) + passage + bytes([48 + i]) + other(180) for i in range(n)]  # another neighbour in each
    return [*texts, b"z" + texts[-1][150:-150] + b"z"]


def anchor_rows(texts):
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = repeats.anchors(repeats.bytes_as_units(data), ends, 200, 40)
    return [{k: int(v[i]) for k, v in got.items()} for i in range(len(got["h"]))]


def segments(texts, hot):
    """The segments of all anchors that several texts have."""
    import pyarrow as pa

    rows = anchor_rows(texts)
    often = {h for h, n in Counter(x["h"] for x in rows).items() if n > 1}
    wanted = [[{"h": x["h"], "at": x["start"], "am": x["a"] << 12 | x["m"], "hot": hot, "several": False} for x in rows if x["text"] == i and x["h"] in often] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts]), pa.array([0] * len(texts), pa.int64()), pa.array(wanted)], names=["doc_id", "text", "mark", "open"])
    kind = repeats.Kind("bytes", 200, 40, earlier=False)
    return sum(len(w) for w in wanted), [r for b in repeats._segment_rows(kind)(iter([batch])) for r in zip(*(b.column(c).to_pylist() for c in repeats._SEGMENT_NAMES))]


def test_hot_hashes_are_dealt_out_in_runs():
    texts = long_passage_in_many_texts(40)
    anchors, rows = segments(texts, hot=True)
    _, whole = segments(texts, hot=False)
    windows = lambda found: sorted((r[2], r[3] + j) for r in found for j in range(r[4] & 0xFFF))
    assert windows(rows) == windows(whole)  # every window, once
    assert len(rows) <= 10 * anchors and len(rows) < len(windows(rows)) / 8
    assert sum(len(r[6]) for r in rows) < 6 * sum(len(r[6]) for r in whole)


@pytest.mark.parametrize("block", [200_000, 3000])
def test_long_groups_of_runs_go_on_as_windows(monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_UNITS", block)
    texts = long_passage_in_many_texts(60)
    kind = repeats.Kind("bytes", 200, 40, earlier=False)
    found = []
    for hot in (False, True):
        rows = segments(texts, hot)[1]
        middle = 0
        for last in (False, True):
            rows.sort(key=lambda r: r[:4])
            rows = [r for b in repeats._compared(kind, suffix_dedup_module._repeated, last)(iter([repeats._segments(rows)])) for r in zip(*(b.column(c).to_pylist() for c in repeats._SEGMENT_NAMES))]
            middle = middle or sum(r[6] is not None for r in rows)
        assert all(r[6] is None for r in rows)
        assert (middle > 0) == (hot and block == 3000)
        found.append(sorted({(r[2], r[3] + j) for r in rows for j in range(r[4])}))
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    assert found[0] == found[1] == sorted((d, i) for d, t in enumerate(texts) for i in range(len(t) - 199) if count[t[i : i + 200]] > 1)
    assert found[0]


def test_arrays_hold_only_bytes_of_windows_that_may_repeat(monkeypatch):
    sizes = []
    array = suffix_dedup_module.two_stage_suffix_array
    monkeypatch.setattr(suffix_dedup_module, "two_stage_suffix_array", lambda text, depth=None: sizes.append(len(text)) or array(text, depth))
    texts = long_passage_in_many_texts(40)
    rows = sorted(segments(texts, hot=False)[1], key=lambda r: r[:4])
    kind = repeats.Kind("bytes", 200, 40, earlier=False)
    assert list(repeats._compared(kind, suffix_dedup_module._repeated)(iter([repeats._segments(rows)])))
    # no other texts than the last two share a window
    assert 0 < sum(sizes) <= sum(len(r[6]) for r in rows if r[2] >= 39) < sum(len(r[6]) for r in rows)
