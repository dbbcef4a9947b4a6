"""Toxicity by a classifier chain.

The categories of `CATEGORIES` are predicted one after another by linear (logistic) models. Each model after the first also
gets the probabilities of the earlier categories; in training these come from out-of-fold predictions, so no model sees a
probability that was fitted to the very row. Features are the words of a text and their beginnings of 4, 5 and 6 letters, as
present or absent: one bad line in a long text counts as much as in a short one.

The models are fitted on the driver on at most about SAMPLE labelled documents, chosen by a hash of doc_id, over at most
FEATURES features for each category (those with the largest log odds). Both are parameters; the model's size is bounded by
them. All documents are scored, over their whole texts.

Defined results. Null and empty texts have no features: their probability is the models' base. Without labelled rows, or with
one class only, a category's probability is that class's share (0 without rows). A null label is no label; of several labels
for a doc_id each counts. Rows stay one to one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The chain's order and each category's label as an expression of the columns of `labels`.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
SAMPLE = 16_384
FEATURES = 4096
LEAST_DOCUMENTS = 3
BEGINNINGS = (4, 5, 6)
FOLDS = 3
STRENGTH = 1e-4
STEPS, TOLERANCE = 100, 1e-5
THRESHOLD = 0.5
#: Words whose features a worker remembers at most.
CACHE = 1 << 19
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„…–—"


def word_features(word: str) -> set[str]:
    word = word.strip(_STRIP)
    return {word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)} if word else set()


def text_features(text: str | None) -> set[str]:
    out: set[str] = set()
    for word in set((text or "").lower().split()):
        out |= word_features(word)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """A logistic model: one weight for each feature, for each earlier category, and a bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def scores(self, rows: np.ndarray, columns: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[columns], n) + before @ self.earlier + self.bias


def fit_linear(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_features: int, before: np.ndarray) -> Linear:
    """Fits by limited-memory BFGS on all rows; rows and columns: where features are present."""
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(n_features), np.zeros(before.shape[1]), 40.0 if share else -40.0)
    sign = 1 - 2 * labels

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        scores = Linear(x[:n_features], x[n_features:-1], x[-1]).scores(rows, columns, n, before)
        error = (_sigmoid(scores) - labels) / n
        g = np.concatenate([np.bincount(columns, error[rows], n_features), before.T @ error, [error.sum()]])
        g[:-1] += STRENGTH * x[:-1]
        return float(np.logaddexp(0, sign * scores).mean() + STRENGTH / 2 * (x[:-1] @ x[:-1])), g

    x = np.zeros(n_features + before.shape[1] + 1)
    x[-1] = np.log(share / (1 - share))
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []  # steps, changes of the gradient
    for _ in range(STEPS):
        if np.abs(g).max() < TOLERANCE:
            break
        d, kept = g.copy(), []
        for s, y, r in reversed(past):
            kept.append(r * (s @ d))
            d -= kept[-1] * y
        if past:
            s, y, r = past[-1]
            d *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d += (a - r * (y @ d)) * s
        slope, step = g @ d, 1.0 if past else min(1.0, 1.0 / np.abs(g).sum())
        while True:
            new = x - step * d
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-10
        x, value, g = new, new_value, new_g
        if done:
            break
    return Linear(x[:n_features], x[n_features:-1], float(x[-1]))


@dataclass
class Chain:
    categories: list[str]
    features: dict[str, int]
    models: list[Linear]
    cache: dict[str, bytes] = field(default_factory=dict)

    def indices(self, text: str | None) -> np.ndarray:
        """The features that a text has, ascending."""
        if not text:
            return np.zeros(0, np.int32)
        cache = self.cache
        words = text.lower().split()
        try:
            found = b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = np.array([self.features[f] for f in word_features(w) if f in self.features], np.int32).tobytes()
            found = b"".join([cache[w] for w in words])
        return np.unique(np.frombuffer(found, np.int32))

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        each = [self.indices(t) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in each])
        columns = np.concatenate(each) if each else np.zeros(0, np.int32)
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, _sigmoid(model.scores(rows, columns, len(texts), out))])
        return out


def _counted(n: int):
    """Documents that have a feature, and those of them of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        each: list[Counter] = [Counter() for _ in range(n)]
        for batch in batches:
            for text, labels in zip(batch.column("text").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                features = text_features(text)
                total.update(features)
                for c, x in zip(each, labels, strict=True):
                    if x:
                        c.update(features)
        names = list(total)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([total[f] for f in names], pa.int64()), pa.array([[c[f] for c in each] for f in names], pa.list_(pa.int64()))], names=["feature", "n", "of"])

    return run


def _present(features: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features[f] for f in text_features(t) if f in features) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("labels"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "labels", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE, most: int = FEATURES) -> Chain:
    """Fits a chain on documents that have all labels."""
    common.small_batches(docs.sparkSession)
    categories = categories or CATEGORIES
    names = list(categories)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(x).cast("int").alias(f"label_{i}") for i, x in enumerate(categories.values()))).dropna()
    wanted = given.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, wanted)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(share)
    rows = texts.join(given.filter(share), "doc_id").select("doc_id", "text", F.array(*(F.col(f"label_{i}") for i in range(len(names)))).alias("labels"))
    rows = common.stored(rows, "labelled")
    counts = rows.agg(F.count("*").alias("n"), *(F.sum(F.get("labels", F.lit(i))).alias(f"c{i}") for i in range(len(names)))).collect()[0]
    seen = rows.mapInArrow(_counted(len(names)), "feature string, n long, of array<long>").groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(F.get("of", F.lit(i))).alias(f"c{i}") for i in range(len(names)))).filter(F.col("n") >= LEAST_DOCUMENTS)
    features: dict[str, int] = {}
    seen = common.cut(seen)
    for i in range(len(names)):
        for f in seen.orderBy(F.desc(_odds(F.col("n"), F.col(f"c{i}"), counts["n"], counts[f"c{i}"] or 0)), "feature").limit(most).select("feature").collect():
            features.setdefault(f[0], len(features))
    got = rows.mapInArrow(_present(features), "doc_id long, labels array<int>, found array<int>").collect()  # at most about `sample` rows
    y = np.array([r["labels"] for r in got], np.float64).reshape(-1, len(names))
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in got], np.int64)
    at = np.repeat(np.arange(len(got)), [len(r["found"]) for r in got])
    columns = np.array([c for r in got for c in r["found"]], np.int64)
    before, models = np.zeros((len(got), 0)), []
    for i in range(len(names)):
        models.append(fit_linear(at, columns, y[:, i], len(features), before))
        unseen = np.zeros(len(got))
        for k in range(FOLDS if i + 1 < len(names) else 0):  # what later models are fitted with
            inside = fold != k
            place = np.cumsum(inside) - 1
            use = inside[at]
            model = fit_linear(place[at[use]], columns[use], y[inside, i], len(features), before[inside])
            unseen[~inside] = _sigmoid(model.scores(at, columns, len(got), before))[~inside]
        before = np.column_stack([before, unseen])
    return Chain(names, features, models)


def _odds(n: Column, c: Column, n_all: int, c_all: int) -> Column:
    """The size of the smoothed log odds ratio, less for rare features."""
    a, b = F.log((c + 0.5) / (c_all + 1)), F.log((n - c + 0.5) / (n_all - c_all + 1))
    return F.abs(a - b) * F.sqrt(F.least(n, F.lit(50)))


def _scored(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            p = chain.probabilities(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(p[:, i]) for i in range(p.shape[1]))], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    return run


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic: whether the last category's probability is above `threshold`."""
    common.small_batches(docs.sparkSession)
    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in chain.categories)])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(chain), schema)
    return out.withColumn("toxic", F.col(f"p_{chain.categories[-1]}") > threshold)


def _passed(chain: Chain, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            p = chain.probabilities(block.column("text").to_pylist())
            if (keep := p[:, -1] <= threshold).any():
                yield block.filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (with all columns) that aren't toxic."""
    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(_passed(chain, threshold), docs.schema)
