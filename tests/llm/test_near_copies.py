import random

import pytest
from pyspark.sql import functions as F

from kumiko.llm import common, golay_simhash, near_copies


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed):
    """Texts of a few words' alphabet's worth of lines, with edited copies of 1 to 12 changed words, and a line that most have."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    out = []
    for i in range(30):
        words = [word() for _ in range(r.choice((3, 5, 6, 9, 14, 40, 150, 400)))]
        if i % 3:
            words += line.split()
        out.append(" ".join(words))
    for _ in range(150):
        words = r.choice(out).split()
        for _ in range(r.randint(1, 1 + len(words) // 25)):
            k = r.randrange(len(words))
            words[k : k + r.randint(0, 1)] = [word()]
        out.append(" ".join(words))
    base = " ".join(word() for _ in range(120)).split()  # one wide group
    for _ in range(40):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word()
        out.append(" ".join(words))
    return out


def brute(texts):
    sets, fps = [grams(t) for t in texts], [golay_simhash.fingerprint(golay_simhash.shingle_hashes(t)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 3
            if near or a == sets[j] or (a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_against_brute_force(spark, seed):
    texts = [*corpus(seed), None, "", " \n", "one", "One"]
    want = {i for i, x in enumerate(brute(texts)) if x == i}
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = near_copies.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_keys_meet_where_sets_are_alike():
    import numpy as np

    r = random.Random(9)
    missed = tried = 0
    for n in [1, 2, 3, 5, 9, 17, 31, 32, 33, 39, 40, 41, 45, 49, 50, 60, 100, 400, 3000] * 12:
        whole = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        # sets of n at most that have 0.8 of their union, just
        some = np.sort(np.array(r.sample(whole.tolist(), max(1, -(-4 * n // 5))), np.uint64))
        tried += 1
        missed += not set(near_copies.keys(whole).tolist()) & set(near_copies.keys(some).tolist())
    assert missed == 0 and tried == 228


def test_names_and_rows_without_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "one text here", 1, 1, 1, 1, 1), (None, "some other words", 2, 1, 1, 1, 1), (None, words, 3, 1, 1, 1, 1), (4, words + " end", 4, 1, 1, 1, 1), (5, "alone", 5, 1, 1, 1, 1), (5, "alone", 5, 1, 1, 1, 1), (None, None, 6, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, again int, of int, node int, text_hash int")
    got = near_copies.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(x["gone"] for x in got.collect()) == [1, 2, 4, 5, 6]


def test_stage_takes_edited_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    edited = [*words[:58], "other", "end"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (None, "a lone one"), (None, "and another")], "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(x["text"] for x in got) == sorted([" ".join(words), "a lone one", "and another"])
    assert near_copies.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [common.SIEVE_BYTES, 128])
def test_a_sieve_lets_all_its_rows_through(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_BYTES", most)
    some = spark.range(3000).selectExpr("case id when 0 then 9223372036854775807L when 1 then -9223372036854775808L else xxhash64(id) end as h")
    others = spark.range(3000, 13000).selectExpr("xxhash64(id) as h")
    passes = common.sieve(some, F.col("h"))
    assert some.filter(passes("h")).count() == 3000
    through = others.filter(passes("h")).count()
    assert through < 200 if most > 128 else through > 5000
    assert others.filter(common.sieve(some.limit(0), F.col("h"))("h")).count() == 0


def test_a_full_sieve_changes_no_result(spark, monkeypatch):
    texts = corpus(3)
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), *((i, t) for i, t in enumerate(texts[:40])), *((None, t) for t in texts[:9])], "doc_id long, text string")
    rows = lambda: sorted((x["doc_id"], x["text"]) for x in near_copies.one_of_each(df).collect())
    want = rows()
    assert [i for i, _ in want] == sorted({i for i, x in enumerate(brute(texts)) if x == i})
    monkeypatch.setattr(common, "SIEVE_BYTES", 128)
    assert rows() == want
