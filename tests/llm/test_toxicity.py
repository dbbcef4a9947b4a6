import random

import numpy as np

from kumiko.llm import toxicity


def corpus(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(r.randint(5, 120))]
        toxic, low = r.random() < 0.25, r.random() < 0.3
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Badword,", "nastyxyz", "nastyqqq", "(nastyab)"]))
        if low:
            words.append("clickhere")
        docs.append((i, " ".join(words)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(500, 1)
    extra = [(9001, None), (9002, ""), (None, "badword"), (9003, "clean " * 5000 + "badword"), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 0, True) for d in docs + extra], "doc_id long, text string, quality int, toxic boolean")
    lab = spark.createDataFrame([x for x in labels if x[0] % 2] + [(9001, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df, chain).collect()}
    held = [(got[i]["toxic"], bool(t)) for i, _, t in labels if i % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not got[9001]["toxic"] and not got[9002]["toxic"] and got[None]["toxic"] and got[9003]["toxic"]
    assert len(chain.models) == 2 and len(chain.models[1].earlier) == 1
    kept = toxicity.without_toxic(df, chain)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_chain_passes_probabilities_on():
    r = np.random.default_rng(1)
    x = (r.random(400) < 0.5).astype(float)
    model = toxicity.fit_linear(np.zeros(0, int), np.zeros(0, int), x, 3, x[:, None])
    assert model.earlier[0] > 1


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, none)
    assert toxicity.score(df, chain).collect()[0]["toxic"] is False
    assert toxicity.score(df.limit(0), chain).count() == 0


def plain_fit(x, y, strength):
    """The same logistic model by plain Newton steps over a dense matrix; the last column is the bias."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(ridge + 1e-12), x.T @ (p - y) / len(y) + ridge * w)
        w = w - min(1.0, 5 / max(1e-9, np.abs(step).max())) * step
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_chain_against_dense_newton(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STRENGTH", 0.01)
    docs, labels = corpus(240, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most=60)
    names = sorted(chain.features, key=chain.features.get)
    x = np.array([[f in toxicity.text_features(t) for f in names] for _, t in docs], float)
    one, fold = np.ones((len(x), 1)), np.array([toxicity.zlib.crc32(str(i).encode()) % toxicity.FOLDS for i, _ in docs])
    y = np.array([[1 - q, t] for _, q, t in labels], float)
    # the second category is fitted with the first one's probabilities of folds that its model hasn't seen
    unseen = np.zeros(len(x))
    for k in range(toxicity.FOLDS):
        inside = fold != k
        w = plain_fit(np.hstack([x, one])[inside], y[inside, 0], 0.01)
        unseen[~inside] = 1 / (1 + np.exp(-(np.hstack([x, one]) @ w)[~inside]))
    first = plain_fit(np.hstack([x, one]), y[:, 0], 0.01)
    second = plain_fit(np.hstack([x, unseen[:, None], one]), y[:, 1], 0.01)
    p0 = 1 / (1 + np.exp(-np.hstack([x, one]) @ first))
    p1 = 1 / (1 + np.exp(-np.hstack([x, p0[:, None], one]) @ second))
    got = {r["doc_id"]: r for r in toxicity.score(df, chain).collect()}
    assert max(abs(got[i]["p_low_quality"] - p0[i]) for i, _ in docs) < 5e-3
    assert max(abs(got[i]["p_toxic"] - p1[i]) for i, _ in docs) < 5e-3
