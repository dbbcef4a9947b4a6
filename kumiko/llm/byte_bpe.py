"""Byte-level BPE encoding and decoding: ranked merges folded over the byte arrays of distinct words.

There are two forms with the same results. `ByteBPE` is made of Spark's higher-order functions alone. `encode_texts` folds in
Arrow batches, many words side by side: each distinct piece of text once while it stays in a worker's cache. The queries use the second, as the first
needs more than twice the CPU time that they may take (the README has figures).

In the form of higher-order functions:

A text is cut into words by the tokenizer's pattern. A word's bytes are folded: an `aggregate` merges, step by step, the
leftmost adjacent pair of least rank, looked up in a literal rank map, until no pair has a rank. Only distinct words are
folded: those that a sample of the corpus shows most often once for the whole job (they become a second literal map of
bounded size), the rest once in each text. Decoding looks up each id's piece in a literal array and concatenates.

Literal maps are arrays of small maps by the key's hash, as Spark searches a map from end to end.

Bytes are held as ISO-8859-1 strings. `\\s` means Unicode white space, as in the tokenizer's library.

Defined results. Null and empty texts: no ids. Rows stay one to one, extra columns are ignored. A word of n
bytes costs n log n steps in Arrow batches (n squared in the higher-order form). Characters that newer Unicode versions have added are classed as the running Java has them.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pfor_tokens

#: Words that are folded once for the whole job at most, and documents that show which those are.
FREQUENT_WORDS = 1 << 17
SAMPLE_DOCUMENTS = 1 << 14
#: The members of Unicode's White_Space.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NO_RANK = 2147483647


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S written out, as Java's know only ASCII."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
            i += 2
        elif two == r"\S":
            if inside:
                raise ValueError(r"\S within a class")
            out.append(f"[^{WHITE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.hash(key), F.lit(n)) + 1


class LiteralMap:
    """A map of strings as a literal in the plan, found by hash: an array of `n` small maps.

    The literal is large, so an expression holds it once: `bind` it to a variable and look keys up there.
    """

    def __init__(self, spark: SparkSession, entries: list[tuple[str, object]], kind: str):
        self.n = 1 << max(4, len(entries).bit_length())
        buckets: list[dict] = [{} for _ in range(self.n)]
        keys = spark.createDataFrame([(k,) for k, _ in entries], "k string").select(_bucket(F.col("k"), self.n)).collect() if entries else []
        for (k, v), (b,) in zip(entries, keys, strict=True):
            buckets[b - 1][k] = v
        self.literal = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")

    def get(self, table: Column, key: Column) -> Column:
        """The value of a key in `table`, which is this map's literal or a variable bound to it."""
        return F.try_element_at(F.get(table, _bucket(key, self.n) - 1), key)


def _bound(value: Column, body) -> Column:
    """body(value), where value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def latin(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def fold_word(word: Column, found) -> Column:
    """The pieces (ISO-8859-1 strings) that the ranked merges leave of an ISO-8859-1 word; found(piece): its rank or null."""
    rank = lambda key: F.coalesce(found(key), F.lit(NO_RANK))
    none = F.array().cast("array<int>")

    def merge(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(i: Column) -> Column:
            def joined(x: Column) -> Column:
                left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), x)))).otherwise(none)
                right = F.when(i < F.size(r), F.array(rank(F.concat(x, F.get(p, i + 1))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(x), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(p))).alias("r"),
                )

            return _bound(F.concat(F.get(p, i - 1), F.get(p, i)), joined)

        # array_min of an empty array is null: nothing is left to merge
        return F.when(F.coalesce(F.array_min(r), F.lit(NO_RANK)) == NO_RANK, state).otherwise(_bound(F.array_position(r, F.array_min(r)).cast("int"), at))

    def folded(p: Column) -> Column:
        n = F.size(p)
        r = F.when(n > 1, F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n), lambda a, b: rank(F.concat(a, b)))).otherwise(none)
        steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none)
        return F.aggregate(steps, F.struct(p.alias("p"), r.alias("r")), merge, lambda s: s["p"])

    chars = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    # a word that is a piece itself stays whole
    return F.when(found(word).isNotNull(), F.array(word)).otherwise(_bound(chars, folded))


def little_endian_hex(number: Column) -> Column:
    swapped = F.shiftleft(number.bitwiseAND(255).cast("long"), 24) + F.shiftleft(F.shiftright(number, 8).bitwiseAND(255).cast("long"), 16) + F.shiftleft(F.shiftright(number, 16).bitwiseAND(255).cast("long"), 8) + F.shiftright(number, 24).bitwiseAND(255).cast("long")
    return F.lpad(F.hex(swapped), 8, "0")


class ByteBPE:
    """Ranks, pieces and the pattern of one tokenizer, ready to be used in plans of one session."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        found = read_ranks(rank_file)
        self.pattern = F.lit(java_pattern(pattern))
        self.ranks = LiteralMap(spark, [(k.decode("latin-1"), v) for k, v in found.items()], "int")
        pieces = [""] * (max(found.values(), default=-1) + 1)
        for piece, rank in found.items():
            pieces[rank] = piece.hex().upper()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), self.pattern, F.lit(0))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))

    def _env(self, known: LiteralMap | None = None) -> Column:
        """All literals as one struct: ranks r, pieces p and folded words k."""
        return F.struct(self.ranks.literal.alias("r"), self.pieces.alias("p"), *([known.literal.alias("k")] if known else []))

    def encoded(self, word: Column, env: Column) -> Column:
        """struct(i, d) of a word: its ids as little-endian hex, and what these ids decode to, as hex."""

        def out(ids: Column) -> Column:
            return F.struct(
                F.array_join(F.transform(ids, little_endian_hex), "").alias("i"),
                F.array_join(F.transform(ids, lambda i: F.get(env["p"], i)), "").alias("d"),
            )

        rank = lambda piece: self.ranks.get(env["r"], piece)
        return _bound(F.transform(_bound(latin(word), lambda w: fold_word(w, rank)), rank), out)

    def frequent(self, docs: DataFrame, n_docs: int = SAMPLE_DOCUMENTS, n_words: int = FREQUENT_WORDS) -> LiteralMap:
        """The most frequent words of about `n_docs` documents, folded. It only saves time: other words are folded in place."""
        total = docs.count()
        share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n_docs / max(1, total)))
        words = docs.filter(share).select(F.explode(self.words(F.col("text"))).alias("w")).groupBy("w").count().filter("count > 1")
        top = words.orderBy(F.desc("count"), "w").limit(n_words)
        rows = top.select("w").repartition(docs.sparkSession.sparkContext.defaultParallelism).select("w", _bound(self._env(), lambda env: self.encoded(F.col("w"), env)).alias("e")).collect()
        return LiteralMap(docs.sparkSession, [(r["w"], {"i": r["e"]["i"], "d": r["e"]["d"]}) for r in rows], "struct<i:string,d:string>")

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id, ids (little-endian unsigned 32-bit integers as binary) and decoded (binary) of each row's text."""
        known = self.frequent(docs)

        def text(env: Column) -> Column:
            hits = F.transform(self.words(F.col("text")), lambda w: F.struct(w.alias("w"), known.get(env["k"], w).alias("e")))

            def folded(hits: Column) -> Column:
                rare = F.array_distinct(F.transform(F.filter(hits, lambda h: h["e"].isNull()), lambda h: h["w"]))
                table = _bound(rare, lambda rare: F.map_from_arrays(rare, F.transform(rare, lambda w: self.encoded(w, env))))
                return _bound(table, lambda t: F.transform(hits, lambda h: F.coalesce(h["e"], F.try_element_at(t, h["w"]))))

            return _bound(hits, folded)

        done = docs.select("doc_id", _bound(self._env(known), text).alias("e"))
        return done.select("doc_id", F.unhex(F.array_join(F.col("e.i"), "")).alias("ids"), F.unhex(F.array_join(F.col("e.d"), "")).alias("decoded"))


#: Pieces of text whose ids a worker remembers at most.
CACHE = 1 << 19
#: Bytes of a word up to which words are folded side by side in a matrix, and cells of one matrix.
WIDE, CELLS = 32, 1 << 20


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that ranked merges leave of a word: the leftmost pair of least rank is merged until none has a rank.

    Pairs wait in a heap by (rank, place), so a word of n bytes takes n log n steps. A pair that has changed since it was put
    there is told by its end.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the parts' neighbours by where they begin
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue
        gone[j] = 1
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (b := before[i]) >= 0 and (r := get(word[b:end])) is not None:
            heappush(heap, (r, b, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Folder:
    """Encodes texts by one tokenizer's ranks and decodes ids, with a cache of pieces that the pattern never joins."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        self.ranks = read_ranks(rank_file)
        pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.cumsum(self.size) - self.size
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        # the rank of each pair of pieces that are one piece together, by both ids
        joined = sorted((a << 32 | b, rank) for piece, rank in self.ranks.items() for i in range(1, len(piece)) if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None)
        self.pairs, self.pair_ranks = np.array([k for k, _ in joined], np.int64), np.array([r for _, r in joined], np.int32)
        self.of_byte = np.array([self.ranks.get(bytes((b,)), -1) for b in range(256)], np.int32)
        self.of_two = self._rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(a), NO_RANK, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NO_RANK).astype(np.int32)

    def _fold_matrix(self, words: list[bytes]) -> list[bytes]:
        """fold_bytes of words of two bytes or more, a row of a matrix each: every step merges one pair in each row."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        ids = self.of_byte[raw]
        pair = self.of_two[raw[:, :-1], raw[:, 1:]]
        pair[np.arange(width - 1) >= size[:, None] - 1] = NO_RANK
        done, total = np.zeros((len(words), width), "<u4"), size.copy()
        left, count = np.arange(len(words)), size
        while len(left):
            if not pair.shape[1]:
                done[left, : ids.shape[1]], total[left] = ids, count
                break
            place = pair.argmin(axis=1)
            least = pair[np.arange(len(left)), place]
            going = least < NO_RANK
            if not going.all():
                ended = left[~going]
                done[ended, : ids.shape[1]], total[ended] = ids[~going], count[~going]
                left, ids, pair, count, place, least = (x[going] for x in (left, ids, pair, count, place, least))
                if not len(left):
                    break
            rows, count = np.arange(len(left)), count - 1
            ids[rows, place] = least
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > place[:, None]), 1)
            columns = columns[:-1]
            pair = np.take_along_axis(pair, columns + (columns >= place[:, None]), 1)
            r = np.flatnonzero(place > 0)
            pair[r, place[r] - 1] = self._rank(ids[r, place[r] - 1], ids[r, place[r]])
            r = np.flatnonzero(place < count - 1)
            pair[r, place[r]] = self._rank(ids[r, place[r]], ids[r, place[r] + 1])
        flat = done[np.arange(width) < total[:, None]].tobytes()
        ends = (np.cumsum(total) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def fold(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, each a match of the pattern."""
        out, rest = {}, {}
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[word] = whole.to_bytes(4, "little")
            elif len(raw) > WIDE:
                out[word] = np.array(fold_bytes(raw, self.ranks), "<u4").tobytes()
            else:
                rest[word] = raw
        order = sorted(rest.items(), key=lambda x: len(x[1]))
        for lo in range(0, len(order), CELLS // WIDE):
            part = order[lo : lo + CELLS // WIDE]
            out.update(zip([w for w, _ in part], self._fold_matrix([raw for _, raw in part]), strict=True))
        return out

    def _learn(self, pieces: list[str]) -> None:
        split = {}
        for piece in pieces:
            word = piece.rstrip(".,")
            # letters, with a space before them, are a word, and so are the marks behind them
            if word.isalpha() or word[:1] == " " and word[1:].isalpha():
                split[piece] = (word,) if len(word) == len(piece) else (word, piece[len(word) :])
            else:
                split[piece] = self.find(piece)
        folded = self.fold(list(set(chain.from_iterable(split.values()))))
        for piece, words in split.items():
            self.cache[piece] = b"".join([folded[w] for w in words])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        regular, pieces, begins = pfor_tokens.split_texts(texts)
        # in other texts white space doesn't part pieces, so their words are found first
        whole = {i: self.find(t) for i in np.flatnonzero(~regular).tolist() if (t := texts[i].as_py())}
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, distinct = self.cache, pfor_tokens.strings(pieces.dictionary)
        self._learn(list(set(distinct).union(*whole.values()).difference(cache)))
        for i, words in whole.items():
            out[i] = b"".join(map(cache.__getitem__, words))
        flat, ends = pfor_tokens.gathered(list(map(cache.__getitem__, distinct)), 4, pieces.indices.to_numpy())
        bounds = ends[begins].tolist()
        for k, i in enumerate(np.flatnonzero(regular).tolist()):
            out[i] = flat[bounds[k] : bounds[k + 1]].tobytes()
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The pieces of each text's ids, concatenated."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        data, ends = pfor_tokens.taken(self.data, self.begin, self.size, flat)
        raw = data.tobytes()
        bounds = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])].tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_folders: dict[tuple[str, str], Folder] = {}


def _folded(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rank_file, pattern) not in _folders:
            _folders[rank_file, pattern] = Folder(rank_file, pattern)
        folder = _folders[rank_file, pattern]
        for block in common.blocks(batches):
            ids = folder.encode(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), common.binary_array(ids), common.binary_array(folder.decode(ids))], names=["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary) and decoded (binary) of each row's text."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_folded(rank_file, pattern), "doc_id long, ids binary, decoded binary")
