import random
import zlib
from collections import Counter

import pytest

from kumiko.llm import shards


def check(rows, got, n):
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(n)) and (not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("rows", None)}


@pytest.mark.parametrize("case", ["pairs", "hot", "few", "all", "empty"])
def test_even_and_linked(spark, case):
    r = random.Random(1)
    n = 600
    rows = {
        "pairs": [(i, f"text {i // 3 if i < 150 else i}") for i in range(n)],
        "hot": [(i, "same" if i % 3 == 0 else f"é {i // 2}") for i in range(n)],
        "few": [(1, None), (2, None), (3, ""), (None, "x")],
        "all": [(i, "same") for i in range(50)] + [(7, "same")],
        "empty": [],
    }[case]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, shard int, link string")
    got = shards.propagate(df).collect()
    check(rows, got, 16)
    if case in ("pairs", "hot"):
        text = dict(rows)
        spread = {}
        for x in got:
            spread.setdefault(text[x["doc_id"]], set()).add(x["shard"])
        whole = sum(len(s) == 1 for t, s in spread.items() if list(text.values()).count(t) > 1 and t != "same")
        groups = sum(list(text.values()).count(t) > 1 and t != "same" for t in spread)
        assert whole >= 0.85 * groups
        if case == "hot":
            assert len(spread["same"]) <= 7  # 200 of 600 rows over shards of 37 or 38
