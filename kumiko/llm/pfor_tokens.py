"""Token ids in patched frame-of-reference blocks.

Documents are range partitioned by doc_id; each partition writes one file of the ids of its documents in ascending doc_id
order. A file is: a magic number, blocks, the index of block starts, the document table, a footer. A block holds up to
`BLOCK` ids: their minimum is subtracted, and the differences are packed at the width that PERCENTILE of them need; larger
ones go, whole, to the block's exception list. Any block can be read on its own by way of the index.

Texts are split for speed before single spaces and around line feeds: the byte-level pattern never joins what these part, so
ids of the pieces are those of the whole text. Each distinct piece goes through the tokenizer once while it stays in a worker's
cache. Texts in which this doesn't hold (other or repeated white space, characters above U+024F, a token that the tokenizer adds
to its model, such as an end mark) go through it whole.

Files are written under a name of their own for each attempt and moved to the final name, so a task may run again.

Defined results. Null and empty texts have no ids but the end id. Rows with equal doc_id stand in order of their text's length, then
of the text (a null one first); a null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 90
#: Blocks that are packed or unpacked in one step.
STEP = 2048
#: Pieces of text whose ids a worker remembers at most.
CACHE = 700_000
_HEAD = struct.Struct("<IHBBH")  # minimum, ids, width, spare, exceptions
_FOOT = struct.Struct("<QQQQ8s")  # place of the index, blocks, documents, ids


def _widths(deltas: np.ndarray) -> np.ndarray:
    """Bits that PERCENTILE of each row's values need."""
    at = deltas.shape[1] * PERCENTILE // 100
    top = np.partition(deltas, at, axis=1)[:, at] if deltas.shape[1] > 1 else deltas[:, 0]
    return np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a uint32 array; only the last may have fewer than BLOCK ids."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    for part, width_of_row in ((ids[:full].reshape(-1, BLOCK), BLOCK), (ids[full:].reshape(1, -1) if full < len(ids) else None, len(ids) - full)):
        if part is None or not part.size:
            continue
        least = part.min(axis=1)
        deltas = part - least[:, None]
        widths = _widths(deltas)
        packed: list[bytes | None] = [None] * len(part)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            if width:
                mask = np.uint32((1 << width) - 1)
                bits = (((deltas[rows] & mask)[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
                body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
                for i, r in enumerate(rows.tolist()):
                    packed[r] = body[i].tobytes()
            else:
                for r in rows.tolist():
                    packed[r] = b""
        over = (deltas.astype(np.uint64) >> widths[:, None].astype(np.uint64)) != 0
        where = np.argwhere(over)
        bounds = np.searchsorted(where[:, 0], np.arange(len(part) + 1))
        places, values = where[:, 1].astype(np.uint8), deltas[over]
        for r, (lo, w) in enumerate(zip(least.tolist(), widths.tolist(), strict=True)):
            a, b = bounds[r], bounds[r + 1]
            out.append(_HEAD.pack(lo, width_of_row, w, 0, b - a) + packed[r] + places[a:b].tobytes() + values[a:b].astype("<u4").tobytes())
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in `raw`."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts.tolist()]
    counts = np.array([h[1] for h in heads], np.int64)
    out = np.zeros(int(counts.sum()), np.uint32)
    at = np.concatenate([[0], np.cumsum(counts)])
    groups: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h[1], h[2]), []).append(i)
    data = np.frombuffer(raw, np.uint8)
    for (n, width), rows in groups.items():
        if width:
            size = (n * width + 7) // 8
            body = data[(starts[rows] + _HEAD.size)[:, None] + np.arange(size)]
            bits = np.unpackbits(body, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
            values = np.zeros((len(rows), n), np.uint32)
            for b in range(width):
                values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            out[at[rows][:, None] + np.arange(n)] = values
    for i, (low, n, width, _, extra) in enumerate(heads):
        a = at[i]
        if extra:
            p = int(starts[i]) + _HEAD.size + (n * width + 7) // 8
            out[a + np.frombuffer(raw, np.uint8, extra, p)] = np.frombuffer(raw, "<u4", extra, p + extra)
        out[a : a + n] += np.uint32(low)
    return out


class Writer:
    """Writes one file; `add` takes a document's ids."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        out.write(MAGIC)
        self.starts: list[int] = []
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= STEP * BLOCK:
            self._flush(self.n_pending // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for begin in range(0, n, STEP * BLOCK):
            for block in encode_blocks(ids[begin : min(n, begin + STEP * BLOCK)]):
                self.starts.append(self.at)
                self.at += len(block)
                self.out.write(block)
        self.pending, self.n_pending = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_pending)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        known = np.array([d is not None for d in self.docs], np.uint8)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(_FOOT.pack(self.at, len(self.starts), len(self.docs), self.n_ids, MAGIC))


class Reader:
    """Reads a file written by Writer, a step of blocks at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOT.size)
        self.index, n_blocks, n_docs, self.n_ids, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(self.index)
        self.starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)
        docs, known = np.frombuffer(source.read(8 * n_docs), "<i8"), np.frombuffer(source.read(n_docs), np.uint8)
        self.docs = [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)]
        self.counts = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first .. last - 1, by way of the index."""
        if first >= last:
            return np.zeros(0, np.uint32)
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.index
        self.source.seek(begin)
        return decode_blocks(self.source.read(end - begin), self.starts[first:last] - begin)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, the ids of the file's documents before it, and its ids."""
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        held, base, block = np.zeros(0, np.uint32), 0, 0
        for i, doc in enumerate(self.docs):
            a, b = int(ends[i]), int(ends[i + 1])
            while base + len(held) < b:
                more = self.blocks(block, min(block + STEP, len(self.starts)))
                block = min(block + STEP, len(self.starts))
                held, base = np.concatenate([held[a - base :], more]), a
            yield doc, a, held[a - base : b - base]


#: Texts with other characters go whole: white space other than space and line feed, controls, all above U+024F; and those in
#: which white space isn't single spaces and line feeds between other characters.
_IRREGULAR = r"^$|^[ \n]|[ \n]{2}|[ \n]$|[^\x20-\x7e\n\x{a1}-\x{24f}]"


def split_texts(texts: pa.Array, apart: list[str] | tuple = ()) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Pieces that byte-level patterns never join: which texts are regular, all pieces of those, and where each text's begin.

    A piece keeps the space before it, and a line feed is a piece. Null counts as irregular, and so does a text that has one of
    the strings in `apart`.
    """
    wide = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(wide, _IRREGULAR)
    for token in apart:
        odd = pc.or_(odd, pc.match_substring(wide, token))
    regular = np.asarray(pc.fill_null(pc.invert(odd), False).to_numpy(zero_copy_only=False), bool)
    some = pc.replace_substring(pc.replace_substring(wide.filter(pa.array(regular)), " ", "\0 "), "\n", "\0\n\0")
    lists = pc.split_pattern(some, "\0")
    return regular, lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def gathered(parts: list[bytes], width: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that `which` names, one after another (items of `width` bytes), and where each begins and the last one ends."""
    kind = np.dtype("<u4") if width == 4 else np.dtype(np.uint8)
    data = np.frombuffer(b"".join(parts), kind)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    return taken(data, np.cumsum(size) - size, size, which)


def taken(data: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[begin[i] : begin[i] + size[i]] for each i of `which`, one after another, and the bounds of these runs."""
    many = size[which]
    ends = np.concatenate([[0], np.cumsum(many)])
    return data[np.repeat(begin[which] - ends[:-1], many) + np.arange(ends[-1])], ends


def _byte_alphabet() -> dict[int, str]:
    """The printable characters that byte-level models spell bytes with; the line feed stays, to part words."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden) if b != 10}


class Tokens:
    """Ids of texts by the tokenizers library, through a cache of pieces that pre-tokenization never joins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # the same model without pre-tokenization, for words that are one pre-token and come in the model's own alphabet
        with open(path) as f:
            parts = json.load(f)
        added = parts.get("added_tokens") or []
        parts |= {"pre_tokenizer": None, "post_processor": None, "decoder": None, "normalizer": None, "added_tokens": []}
        vocabulary = parts["model"]["vocab"]
        self.added = [t["content"] for t in added]
        self.words = Tokenizer.from_str(json.dumps(parts))
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.alphabet = _byte_alphabet()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters (with a space before them): a list of pre-tokens, cut again by the bytes that the ids stand for."""
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            spelled = "\n".join(part).encode().decode("latin-1").translate(self.alphabet).split("\n")
            (found,) = self.words.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, spelled)))) + 1
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.cache[word] = raw[begin:end]
                begin = end

    def _learn_lines(self, pieces: list[str]) -> None:
        """Other pieces, as lines of one text; the line feed is a token of its own between them."""
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            (ids,) = self._encode(["\n".join(part)])
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            raw, begin = ids.tobytes(), 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.cache[piece] = raw[begin * 4 : end * 4]
                begin = end + 1

    def _learn(self, pieces: pa.Array) -> None:
        core = pc.utf8_rtrim(pieces, ".,")
        letters = pc.utf8_is_alpha(pc.replace_substring(core, " ", "", max_replacements=1))  # a space stands at the start only
        plain = pc.and_(letters, pc.equal(core, pieces))
        marked = pc.and_(letters, pc.invert(plain))  # marks after letters are a pre-token of their own
        cache = self.cache
        ending, heads = strings(pieces.filter(marked)), strings(core.filter(marked))
        tails = [piece[len(word) :] for piece, word in zip(ending, heads, strict=True)]
        self._learn_words(list({*strings(pieces.filter(plain)), *heads}.difference(cache)))
        self._learn_lines(list({*strings(pieces.filter(pc.invert(letters))), *tails}.difference(cache)))
        for piece, word, tail in zip(ending, heads, tails, strict=True):
            cache[piece] = cache[word] + cache[tail]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        regular, pieces, begins = split_texts(texts, self.added)
        whole = [i for i in np.flatnonzero(~regular).tolist() if texts[i].as_py()]
        for i, ids in zip(whole, self._encode([texts[i].as_py() for i in whole]), strict=True):
            out[i] = ids
        cache, distinct = self.cache, strings(pieces.dictionary)  # each is looked up once a block
        cache["\n"] = np.array([self.line], "<u4").tobytes()
        found = list(map(cache.get, distinct))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            if len(cache) > CACHE:  # the block's pieces stay
                cache.clear()
                cache.update((piece, x) for piece, x in zip(distinct, found, strict=True) if x is not None)
            self._learn(pieces.dictionary.take(pa.array(gaps)))
            for k in gaps:
                found[k] = cache[distinct[k]]
        flat, ends = gathered(found, 4, pieces.indices.to_numpy())
        bounds = ends[begins].tolist()
        for k, i in enumerate(np.flatnonzero(regular).tolist()):
            out[i] = flat[bounds[k] : bounds[k + 1]]
        return out


_tokens: dict[str, Tokens] = {}


def _tokens_of(path: str) -> Tokens:
    if path not in _tokens:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _write(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, where = fs.FileSystem.from_uri(folder)
        name, temporary = f"{where}/part-{part:06d}.pfor", f"{where}/.{part:06d}-{uuid.uuid4().hex}"
        tokens, end, writer, out = _tokens_of(tokenizer), np.array([end_id], "<u4"), None, None
        for block in common.blocks(batches):
            if writer is None:
                out = files.open_output_stream(temporary)
                writer = Writer(out)
            for doc, ids in zip(block.column("doc_id").to_pylist(), tokens.ids(block.column("text")), strict=True):
                writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            files.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/part-{part:06d}.pfor"]), pa.array([writer.n_ids])], names=["part", "path", "n_ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> list[tuple[str, int]]:
    """Writes the ids of all texts to files in `folder` (a URI that all executors reach).

    Returns each file's path and the ids before it, in ascending order of doc_id: one entry for each partition.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    common.small_batches(spark)
    files, where = fs.FileSystem.from_uri(folder)
    files.create_dir(where, recursive=True)
    order = ["doc_id", F.length("text")]  # ranges are cut by both, so rows sort by both
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(common.partitions(docs), *order).sortWithinPartitions(*order, "text")
    rows = ordered.mapInArrow(_write(tokenizer, folder, end_id), "part long, path string, n_ids long").collect()
    out, before = [], 0
    for _, path, n in sorted(map(tuple, rows)):
        out.append((path, before))
        before += n
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            files, where = fs.FileSystem.from_uri(path)
            rows: list[tuple] = []
            size = 0
            with files.open_input_file(where) as source:
                for doc, start, ids in Reader(source).documents():
                    rows.append((doc, before + start, ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > STEP * BLOCK:
                        yield _rows(rows)
                        rows, size = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def read_tokens(spark, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit integers) from the files."""
    table = spark.createDataFrame(files, "path string, before long").repartition(max(1, len(files)), "path")
    return table.mapInArrow(_read, "doc_id long, start long, ids binary")
