import random

import numpy as np
import pytest
import xxhash

from kumiko.llm import golay_simhash as g


def test_code():
    code = g.Golay()
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 300)
    index = code.index(x)
    assert index.max() < 4096
    # the code is perfect: every word is within three bits of its codeword, and words of one codeword form a sphere
    assert len(np.unique(code.error)) == 2048 and (np.bitwise_count(code.error.astype(np.uint64)) <= 3).all()
    for bits in (23, 18):
        w = x & ((1 << bits) - 1)
        keys = code.keys(w, bits)
        assert keys.shape[1] <= 6
        y = w ^ (1 << r.integers(0, bits, 300))
        own = code.index(y)
        assert (keys == own[:, None]).any(axis=1).all()


def brute(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def family(seed, n):
    r = random.Random(seed)
    out = [0]
    for _ in range(n):
        x = r.choice(out) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed):
    fps = family(seed, 400)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = g.links(df, len(signed))
    got = {r["node"] & (2**64 - 1): r["root"] for r in g.components(edges).collect()}
    want = brute(fps)
    sets = {}
    for f, root in want.items():
        sets.setdefault(root, set()).add(f)
    mine = {}
    for f in want:
        mine.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, mine.values()))


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_whole(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 60):
        w = r.choice(base).split(" ")
        w[r.randrange(len(w))] = "Zz"
        rows.append((i, "  \n".join(w)))
    rows += [(60, None), (61, ""), (62, " \t"), (63, "one"), (64, "ÉT É"), (None, base[0]), (65, "x " * 5000), (3, base[3])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, fp int, node int")
    got = g.golay_simhash(df).collect()
    fp = {t: plain(t) for _, t in rows}
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["fingerprint"]) for x in got) == sorted((d is None, d or 0, f"{fp[t]:016x}") for d, t in rows)
    root = brute(list(fp.values()))
    least = {}
    for d, t in rows:
        if d is not None:
            least[root[fp[t]]] = min(d, least.get(root[fp[t]], d))
    assert {(x["fingerprint"], x["component_id"]) for x in got} == {(f"{f:016x}", least[root[f]]) for f in fp.values()}


def test_dense_family_needs_few_links():
    center = 0x0123456789ABCDEF
    fps = np.array([center] + [center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], np.uint64)
    assert len(g.forest(fps)) == len(fps) - 1


def test_empty(spark):
    assert g.golay_simhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0
