import random
from collections import Counter

import numpy as np

from kumiko.llm import language_id as li

VOWELS = {"aa": "aeiou", "bb": "öäüyø"}


def texts(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    word = lambda: "".join(r.choice("bcdfgklm") + r.choice(VOWELS[lang] if r.random() < 0.9 else "aö") for _ in range(r.randint(1, 4)))
    return [" ".join(word() for _ in range(r.randint(3, 60))).capitalize() + "." for _ in range(n)]


def test_probabilities_sum_to_one():
    counts = {"aa": Counter(w for t in texts("aa", 30, 1) for w in t.lower().strip(".").split())}
    model = li.fit(counts)
    letters = sorted({c for w in counts["aa"] for c in w})
    for context in ("", "ba", "zz", next(iter(counts["aa"]))):
        whole = 0.0
        for c in [*letters, " ", "?"]:
            # the probability of one character after a context, by difference of two word scores
            grams, word = li._grams([context + c] if c != " " else [context])
            contexts = li._contexts(grams, [])
            at = len(context)
            p = 1.0 / model.characters
            for n in range(li.ORDER):
                i = np.searchsorted(model.contexts[n], contexts[n][at])
                if i < len(model.contexts[n]) and model.contexts[n][i] == contexts[n][at]:
                    p *= model.context_values[n][i][0]
                i = np.searchsorted(model.grams[n], grams[n + 1][at])
                if i < len(model.grams[n]) and model.grams[n][i] == grams[n + 1][at]:
                    p += model.gram_values[n][i][0]
            whole += p
        assert abs(whole - 1) < 1e-3


def test_held_out_accuracy(spark):
    rows = [(i, t, lang) for lang in VOWELS for i, t in enumerate(texts(lang, 150, 2), 1000 * (lang == "bb"))]
    rows += [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 ... %%", "aa"), (9004, "bö", None), (None, rows[0][1], "aa"), (9005, "bada " * 4000, "aa")]
    df = spark.createDataFrame([(*x, 1.0, "n") for x in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = li.train(df.filter("doc_id % 2 = 0"), sample=60, calibration=20)
    got = {r["doc_id"]: r for r in li.identify(df, model).collect()}
    held = [(r["lang_pred"], lang) for i, _, lang in rows if i is not None and i < 9000 and i % 2 for r in [got[i]]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    for i in (9001, 9002, 9003):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert got[9005]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got) == len(rows)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = li.train(df)
    assert li.identify(df, model).collect()[0]["lang_pred"] == "und"
    assert li.identify(df.limit(0), model).count() == 0


def test_many_languages_are_learned_and_calibration_is_held_out(spark, monkeypatch):
    word = lambda k: "".join("abcdefghijklmnopq"[k // 17**i % 17] for i in range(3))
    rows = [(10 * k + d, f"{word(k)}{'xyz'[d]} {word(k)}", f"l{k:03}") for k in range(270) for d in range(1 if k == 0 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted, tested = {}, []
    fit, calibrate = li.fit, li.calibrate
    monkeypatch.setattr(li, "fit", lambda counts: (counted.update(counts), fit(counts))[1])
    monkeypatch.setattr(li, "calibrate", lambda model, texts, truth: (tested.extend(zip(texts, truth)), calibrate(model, texts, truth)))
    model = li.train(df, sample=800, calibration=2)
    assert model.languages == sorted({lang for _, _, lang in rows})
    assert {lang for _, lang in tested} == set(model.languages) - {"l000"}
    assert all(text.split()[0] not in counted[lang] for text, lang in tested)


def plain_model(words):
    """Interpolated Kneser-Ney of one language over plain dictionaries: P(character | characters before it)."""
    order = li.ORDER
    grams = {n: Counter() for n in range(1, order + 1)}
    for w, k in words.items():
        padded = " " * (order - 1) + w + " "
        for i in range(order - 1, len(padded)):
            grams[order][padded[i - order + 1 : i + 1]] += k
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])  # distinct characters seen to the left
    discount = {}
    for n, counts in grams.items():
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once else 0.5

    def p(context, char, n, size):
        if n == 0:
            return 1 / size
        of = context[len(context) - n + 1 :] if n > 1 else ""
        after = {g: c for g, c in grams[n].items() if g[:-1] == of}
        low = p(context, char, n - 1, size)
        if not after:
            return low
        total, d = sum(after.values()), discount[n]
        return max(after.get(of + char, 0) - d, 0) / total + d * len(after) / total * low

    return p


def test_against_plain_kneser_ney():
    counts = {lang: Counter(w for t in texts(lang, 12, 5) for w in t.lower().strip(".").split()) for lang in VOWELS}
    model = li.fit(counts)
    plain = {lang: plain_model(counts[lang]) for lang in counts}
    some = [*list(counts["aa"])[:6], *list(counts["bb"])[:6], "bab", "zzz", "ö"]
    got = model.word_scores(some)
    for i, w in enumerate(some):
        padded = " " * (li.ORDER - 1) + w + " "
        for j, lang in enumerate(model.languages):
            want = -sum(np.log2(plain[lang](padded[:k], padded[k], li.ORDER, model.characters)) for k in range(li.ORDER - 1, len(padded)))
            assert abs(got[i, j] - want) < 1e-3 * max(1, want)
    h, length = model.entropies(["bab zzz.", None])
    assert length.tolist() == [8, 0]
    assert np.allclose(h[0], (got[some.index("bab")] + got[some.index("zzz")]) / 8, atol=1e-4)
