import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from kumiko.llm import pfor_tokens
from kumiko.llm.queries import packed_tokens


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 60, n).astype(np.uint32)
    ids[r.random(n) < 0.05] = 4_000_000_000
    blocks = pfor_tokens.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (pfor_tokens.decode_blocks(b"".join(blocks), np.array(starts, np.int64)) == ids).all()
    if n == 5000:
        assert len(b"".join(blocks)) < n * 2  # patched: outliers don't widen their block


def test_file(monkeypatch):
    monkeypatch.setattr(pfor_tokens, "STEP", 2)
    r = random.Random(1)
    docs = [(i if i != 3 else None, np.array([r.randrange(50257) for _ in range(r.randrange(900))], np.uint32)) for i in range(30)]
    out = io.BytesIO()
    w = pfor_tokens.Writer(out)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    reader = pfor_tokens.Reader(pa.BufferReader(out.getvalue()))
    before = 0
    for (d, ids), (got, start, back) in zip(docs, reader.documents(), strict=True):
        assert d == got and start == before and (ids == back).all()
        before += len(ids)


def test_query(spark):
    r = random.Random(2)
    texts = ["", None, " lead", "trail ", "a  b", "a \n b", "\n\nx\n", "nul\0 byte x", "日本 語 x", "it's don't ' s", "x" * 500, "ok words here.\nNext line", "<|endoftext|> x", "a.b,c 3.5 x._y !. .a ,b don't.\nNo, yes.", "Foo. Bar, baz.\nQux", "a\n\nb", "\n", ".", "a\n", "it's, ok.", "Straße,. über.. naïve éa,b.c ok., x", "ªº ǅ ʰ, aͅ", "a , b . c", ". , .", "²x. x²., ½"]
    texts += ["".join(r.choice(["the", "er", " ", " ", "\n", "é", "7", "!", "'s", "Ö"]) for _ in range(80)) for _ in range(60)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, texts[i], 1, "x") for i in ids] + [(None, "none", 1, "x"), (5, texts[5], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, path string")
    got = sorted(map(tuple, packed_tokens(df, path("byte_bpe_50k.json")).collect()), key=lambda x: x[1])
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    before = 0
    want = []
    for i, text, *_ in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        e = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, before, len(e), zlib.crc32(e.tobytes())))
        before += len(e)
    assert got == want


def test_many_rows_of_one_id(spark):
    r = random.Random(6)
    rows = [(7, "w" * r.randint(0, 40) + r.choice("xyz")) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, x in sorted(rows, key=lambda x: (len(x[1]), x[1]))]
    assert [x["ids_crc32"] for x in sorted(packed_tokens(df, path("byte_bpe_50k.json")).collect(), key=lambda x: x["start"])] == want


def test_added_tokens_are_the_tokenizers_own():
    tokens = pfor_tokens.Tokens(path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext| > c", "plain words"]
    assert [x.tolist() for x in tokens.ids(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_empty(spark):
    assert packed_tokens(spark.createDataFrame([], "doc_id long, text string"), path("byte_bpe_50k.json")).count() == 0
