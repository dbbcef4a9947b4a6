import random
import struct
import time

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from kumiko.llm import byte_bpe


@pytest.fixture(scope="module")
def bpe(spark):
    return byte_bpe.ByteBPE(spark, path("byte_bpe_50k.tiktoken"), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(path("byte_bpe_50k.tiktoken")), special_tokens={})


def texts():
    r = random.Random(3)
    out = ["", None, " ", "a", "  two  spaces\n\n\nlines \t x", "it's we'll I'd 'tis", "<|endoftext|>", "é à ü ß ñ", "日本語のテキスト", "　wide space x", "😀😀 😀", "1234567 12 ½", "x" * 3000, "ab" * 400, "\x00\x01\x7f", "%%%&&&$$$ ..,,!!"]
    for _ in range(60):
        out.append("".join(r.choice(["the", "er", " ", "  ", "\n", "on", "é", "ß", "7", "!", "'s", "ö", "Z"]) for _ in range(r.randint(1, 60))))
    return out + out[-5:]


def test_equals_library(spark, bpe, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "no id", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, e string")
    got = {r["doc_id"]: r for r in bpe.encode(df).collect()}
    assert len(got) == len(rows)
    assert {r["doc_id"]: r for r in byte_bpe.encode_texts(df, path("byte_bpe_50k.tiktoken"), PATTERN).collect()} == got
    for i, t, *_ in rows:
        want = library.encode_ordinary(t or "")
        assert got[i]["ids"] == struct.pack(f"<{len(want)}I", *want), t
        assert got[i]["decoded"] == (t or "").encode()


def test_all_words_in_place(spark, bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe.ByteBPE, "frequent", lambda self, docs: byte_bpe.LiteralMap(docs.sparkSession, [], "struct<i:string,d:string>"))
    rows = [(i, t) for i, t in enumerate(texts()[16:40])]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = library.encode_ordinary(t)
        assert got[i] == struct.pack(f"<{len(want)}I", *want)


def test_matrix_equals_heap(library):
    folder = byte_bpe.Folder(path("byte_bpe_50k.tiktoken"), PATTERN)
    r = random.Random(4)
    words = list({"".join(r.choice(["the", "er", "on", "é", "ß", "Z", "ing", "x", "qu"]) for _ in range(r.randint(1, 12))) for _ in range(3000)})
    folded = folder.fold(words)
    for w in words:
        raw = w.encode()
        assert folded[w] == struct.pack(f"<{len(folded[w]) // 4}I", *byte_bpe.fold_bytes(raw, folder.ranks))
        assert folder.decode([folded[w]]) == [raw]
        if len(raw) <= byte_bpe.WIDE:
            assert byte_bpe.fold_bytes(raw, folder.ranks) == library.encode_ordinary(w)


def test_long_word(library):
    folder = byte_bpe.Folder(path("byte_bpe_50k.tiktoken"), PATTERN)
    r = random.Random(5)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(80_000))
    begun = time.perf_counter()
    got = byte_bpe.fold_bytes(word.encode(), folder.ranks)
    assert time.perf_counter() - begun < 3
    assert got[:2000] == library.encode_ordinary(word[:9000])[:2000]  # merges far behind don't reach back
    assert b"".join(folder.decode([struct.pack(f"<{len(got)}I", *got)])) == word.encode()


def test_decode(spark, bpe, library):
    ids = library.encode_ordinary("any text, été")
    assert spark.createDataFrame([(ids,), ([],)], "x array<int>").select(bpe.decode(F.col("x"))).collect()[0][0] == "any text, été".encode()


def test_empty(spark, bpe):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none).count() == 0
    assert byte_bpe.encode_texts(none, path("byte_bpe_50k.tiktoken"), PATTERN).count() == 0
