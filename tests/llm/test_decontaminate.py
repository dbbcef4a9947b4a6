import hashlib
import random
import re

import pytest

from kumiko.llm import decontaminate as module
from kumiko.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, t in items:
            v = words(t)
            for s in range(max(1, len(v) - size + 1) if v else 0):
                win = v[s : s + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit[p : p + len(win)] = [True] * len(win)
                        found.add(item or "")
        out.append((doc, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_words", [1_000_000, 20])
def test_equals_brute_force(spark, monkeypatch, pass_words):
    monkeypatch.setattr(module, "PASS_WORDS", pass_words)
    r = random.Random(4)
    word = lambda: r.choice(["Ab", "c", "dé", "7x", "the", "THE", "zz"])
    items = [(str(i), " ".join(word() for _ in range(r.randint(0, 14)))) for i in range(12)] + [("9", "the the the the the the"), (None, "c dé c 7x"), ("s", None), ("10", "")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 12)))]
        if r.random() < 0.5:
            parts.append(r.choice(items)[1] or "")
        r.shuffle(parts)
        docs.append((i, r.choice([" ", "-", "\n", "."]).join(parts)))
    docs += [(98, None), (99, ""), (None, "the " * 3000), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate(df, bench, 6).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 6)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(some, bench).collect()[0]["contaminated"] is False
