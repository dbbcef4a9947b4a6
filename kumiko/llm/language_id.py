"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of characters within words: a word is padded with spaces, and each character is predicted from the
ORDER - 1 before it. The highest order uses counts, lower orders the number of distinct characters seen to the left; each
order discounts by its own D = n1 / (n1 + 2 n2) and passes the rest on to the next lower order, down to a uniform one. All
orders lie in arrays sorted by the hash of an n-gram (a column for each language), searched by bisection.

A text's cross-entropy is summed over its words and divided by its characters; the lowest language wins. How sure that is, is
calibrated on documents that the counts haven't seen: a logistic curve of the margin to the second language. A text is
`rejected` where that probability is below REJECT or its cross-entropy above what the calibration texts of its language have
shown (their largest, and MARGIN more).

Models are fitted on at most about SAMPLE documents of each language, chosen by a hash of doc_id, and calibrated on others (of
few documents a part is held out, of a single one none). Every language that is given is learned, so the model grows with
their number. All documents are scored over their whole texts: each distinct word once while it stays in a worker's cache.

Defined results. Null texts and texts without a letter: `und`, score 0, rejected. Without any learned language: the same.
Rows stay one to one; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
SAMPLE = 800
CALIBRATION = 200
REJECT = 0.5
MARGIN = 0.5
UNKNOWN = "und"
CACHE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letters(chunk: str) -> str:
    return chunk if chunk.isalpha() else "".join(c for c in chunk if c.isalpha())


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each predicted character of all padded words: hashes of the n-grams that end there (n = 0 ... ORDER), and its word."""
    pad = " " * (ORDER - 1)
    text = "".join([pad + w + " " for w in words])
    codes = common.mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(lengths.sum()) + (ORDER - 1) * (word + 1)
    grams = [np.zeros(len(place), np.uint64)]
    factor = np.uint64(1)
    for n in range(ORDER):
        grams.append(grams[-1] + codes[place - n] * factor)
        factor = np.uint64(int(factor) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return grams, word


def _contexts(grams: list[np.ndarray], words: list[str]) -> list[np.ndarray]:
    """Hashes of the contexts of each order's n-grams: the n - 1 characters before the predicted one."""
    # an n-gram's hash is code + BASE * (hash of its context)
    last = grams[1]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return [(g - last) * inverse for g in grams[1:]]


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # for each order: sorted hashes
    gram_values: list[np.ndarray]  # and (count - D) / total, a column for each language
    contexts: list[np.ndarray]
    context_values: list[np.ndarray]  # what is passed on to the lower order (1 where the context is unseen)
    characters: int
    slope: float = 1.0
    shift: float = 0.0
    worst: np.ndarray | None = None
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of -log2 P of each word's characters, a column for each language."""
        grams, word = _grams(words)
        contexts = _contexts(grams, words)
        p = np.full((len(word), len(self.languages)), 1.0 / self.characters, np.float32)
        for n in range(ORDER):
            for keys, values, at, add in ((self.contexts[n], self.context_values[n], contexts[n], False), (self.grams[n], self.gram_values[n], grams[n + 1], True)):
                if not len(keys):
                    continue
                i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                hit = keys[i] == at
                if add:
                    p[hit] += values[i[hit]]
                else:
                    p[hit] *= values[i[hit]]
        out = np.zeros((len(words), len(self.languages)))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))[:-1]])
        out[:] = np.add.reduceat(-np.log2(np.maximum(p, 1e-9)), bounds, axis=0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by character (a column for each language) and characters of each text."""
        split = [t.lower().split() if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        if not self.cache:
            self.table, self.sizes = np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        cache = self.cache
        new = list({w for ws in split for w in ws if w not in cache})
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            letters = [_letters(w) for w in part]
            some = [w or "?" for w in letters]
            scores = self.word_scores(some).astype(np.float32)
            sizes = np.array([len(w) + 1 if w else 0 for w in letters], np.int64)
            scores[sizes == 0] = 0
            cache.update(zip(part, range(len(self.sizes), len(self.sizes) + len(part)), strict=True))
            self.table, self.sizes = np.concatenate([self.table, scores]), np.concatenate([self.sizes, sizes])
        total, length = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, ws in enumerate(split):
            if ws:
                at = np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))
                total[i], length[i] = self.table[at].sum(axis=0, dtype=np.float64), self.sizes[at].sum()
        return total / np.maximum(length, 1)[:, None], length

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, length = self.entropies(texts)
        best = np.argmin(h, axis=1)
        low = h[np.arange(len(h)), best]
        score = 1 / (1 + np.exp(-np.clip(self.slope * evidence(h, length) + self.shift, -40, 40)))
        worst = self.worst if self.worst is not None else np.full(len(self.languages), np.inf)
        empty = length == 0
        score[empty], low[empty] = 0, 0
        rejected = empty | (score < REJECT) | (low > worst[best] + MARGIN)
        return [UNKNOWN if e else self.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)], score, low, rejected


def evidence(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The margin of the best language to the second, in bits, growing with the root of the text's length."""
    if h.shape[1] < 2:
        return np.where(length > 0, 10.0, 0.0)
    two = np.partition(h, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(length)


def fit(counts: dict[str, Counter]) -> Model:
    """Models of the languages from the counts of their words."""
    languages = sorted(counts)
    alphabet = {c for words in counts.values() for w in words for c in w}
    found: list[list[tuple]] = []
    for language in languages:
        words = list(counts[language])
        weight = np.array([counts[language][w] for w in words], np.float64)
        grams, word = _grams(words)
        contexts = _contexts(grams, words)
        orders = []
        for n in range(ORDER, 0, -1):
            if n == ORDER:
                keys, first, where = np.unique(grams[n], return_index=True, return_inverse=True)
                c = np.bincount(where, weight[word])
            else:  # distinct n + 1-grams that end in the n-gram
                _, wider = np.unique(grams[n + 1], return_index=True)
                keys, place, where = np.unique(grams[n][wider], return_index=True, return_inverse=True)
                first = wider[place]
                c = np.bincount(where).astype(np.float64)
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and once + 2 * twice else 0.5
            ctx, where = np.unique(contexts[n - 1][first], return_inverse=True)
            total, distinct = np.bincount(where, c), np.bincount(where)
            orders.append((keys, np.maximum(c - d, 0) / total[where], ctx, d * distinct / total))
        found.append(orders[::-1])
    model = Model(languages, [], [], [], [], len(alphabet) + 2)
    for n in range(ORDER):
        for k, keys, values, none in ((0, model.grams, model.gram_values, 0.0), (2, model.contexts, model.context_values, 1.0)):
            whole = np.unique(np.concatenate([f[n][k] for f in found])) if found else np.zeros(0, np.uint64)
            table = np.full((len(whole), len(languages)), none, np.float32)
            for i, f in enumerate(found):
                table[np.searchsorted(whole, f[n][k]), i] = f[n][k + 1]
            keys.append(whole)
            values.append(table)
    return model


def calibrate(model: Model, texts: list[str], truth: list[str]) -> None:
    """Fits the curve that turns evidence into a probability of being right, and each language's largest cross-entropy."""
    if not texts or not model.languages:
        return
    h, length = model.entropies(texts)
    best = np.argmin(h, axis=1)
    right = np.array([model.languages[b] == t for b, t in zip(best.tolist(), truth, strict=True)], float)
    use = length > 0
    x, y = evidence(h, length)[use], right[use]
    # two imagined errors at no evidence and two hits far out keep the curve finite where all is right
    far = max(1.0, float(np.median(x))) if len(x) else 1.0
    x, y = np.concatenate([x, [0, 0, far, far]]), np.concatenate([y, [0, 0, 1, 1]])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = max(a, 1e-3), b
    low = h[np.arange(len(h)), best]
    model.worst = np.array([low[use & (best == i)].max() if (use & (best == i)).any() else np.inf for i in range(len(model.languages))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(filter(None, map(_letters, text.lower().split())))
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    for lo in range(0, len(rows), 10_000):
        lang, word, n = zip(*rows[lo : lo + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """Fits models on the rows of `docs` (doc_id, text, lang) that have a text and a language."""
    spark = docs.sparkSession
    common.small_batches(spark)
    given = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    found = given.groupBy("lang").agg(F.count("*").alias("count"), F.min(place).alias("least"), F.max(place).alias("most")).orderBy("lang").collect()  # a row for each language
    # a part of each language's picked documents calibrates and isn't counted; one at least is counted
    shares = []
    for r in found:
        test = min(1.0, (sample + calibration) / r["count"])
        fit_below = max(r["least"] + 1, min(r["most"], int((1 << 30) * test * sample / (sample + calibration))))
        shares.append((r["lang"], fit_below, max(fit_below, int((1 << 30) * test))))
    table = F.broadcast(spark.createDataFrame(shares, "of string, fit_below long, test_below long"))
    picked = common.stored(given.join(table, F.col("lang") == F.col("of")).withColumn("place", place).filter("place < test_below").select("doc_id", "text", "lang", (F.col("place") < F.col("fit_below")).alias("fit")), "languages")
    counts: dict[str, Counter] = {}
    rows = picked.filter("fit").select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for lang, word, n in rows.collect():  # the words of a bounded sample
        counts.setdefault(lang, Counter())[word] = n
    model = fit(counts)
    tests = picked.filter(~F.col("fit")).select("text", "lang").collect()  # bounded for each language
    calibrate(model, [r["text"] for r in tests], [r["lang"] for r in tests])
    model.cache, model.table, model.sizes = {}, None, None
    return model


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            lang, score, low, rejected = model.predict(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits_per_char and rejected of each row's text."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")
