import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from kumiko.llm import tiff


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order,kind,planar", [("<", np.uint8, False), (">", np.uint16, True)])
def test_round_trip(compression, tile, predictor, order, kind, planar):
    r = np.random.default_rng(1)
    images = [r.integers(0, 7, (37, 50, 3)).astype(kind), np.zeros((5, 300, 1), kind), r.integers(0, 255, (64, 64, 1)).astype(kind)]
    data = tiff.encode(images, compression, predictor, rows=10, tile=tile, order=order, planar=planar)
    pages = list(tiff.pages_of(data))
    assert [p.page for p in pages] == [0, 1, 2]
    for image, p in zip(images, pages, strict=True):
        assert p.error is None and (p.height, p.width, p.samples) == image.shape and p.pixels == image.tobytes()


def test_lzw_table_overflow():
    data = bytes(random.Random(2).randrange(256) for _ in range(20000)) + b"ab" * 9000
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_pack_bits_known():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    whole = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(packed, len(whole)) == whole


def test_damaged():
    good = tiff.encode([np.ones((64, 64, 1), np.uint8)])
    assert [p.error for p in tiff.pages_of(b"no image")] == ["not a TIFF file"]
    assert list(tiff.pages_of(b""))[0].error
    assert any(p.error for p in tiff.pages_of(good[: len(good) // 2]))
    loop = bytearray(good)
    first = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, len(loop) - 4, first)
    assert len(list(tiff.pages_of(bytes(loop)))) == 1
    for i in range(0, len(good), 3):  # any damaged byte: no exception
        bad = bytearray(good)
        bad[i] ^= 0xFF
        list(tiff.pages_of(bytes(bad)))


def test_texts(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "y" * 65, "long " * 5000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "z", 1)], "doc_id long, text string, content int")
    got = {r["doc_id"]: r for r in tiff.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert "errors=0" in r["feature"]
    assert got[2][2:] == got[7][2:] and None in got


def test_long_text_has_pages(monkeypatch):
    monkeypatch.setattr(tiff, "TEXT_BYTES", 640)
    monkeypatch.setattr(tiff, "PAGE_BYTES", 5000)
    for n in (0, 1, 640, 641, 5000):
        for extra in range(6):  # other forms
            text = "ab" * n + "c" * extra
            pages = list(tiff.pages_of(tiff.text_file(text)))
            assert all(p.error is None for p in pages) and len(pages) == max(1, -(-(2 * n + extra) // 640))
            assert b"".join(p.pixels for p in pages).rstrip(b"\0") == text.encode()
    assert len({zlib.crc32(b"x" * n) % len(tiff.FORMS) for n in range(60)}) == len(tiff.FORMS)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_few_bits(bits):
    r = np.random.default_rng(bits)
    image = r.integers(0, 1 << bits, (5, 13, 3)).astype(np.uint8)
    spread = ((image.reshape(5, -1)[:, :, None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8).reshape(5, -1)
    raw = np.packbits(spread, axis=1)
    got = tiff._samples(raw, 13, 3, bits, np.dtype(np.uint8), 1)
    assert (got == image).all()


def test_floating_point_predictor():
    values = np.random.default_rng(1).normal(size=(4, 9, 2)).astype(np.float32)
    planes = values.astype(">f4").view(np.uint8).reshape(4, 18, 4).transpose(0, 2, 1).reshape(4, -1, 2)
    stored = np.diff(planes, axis=1, prepend=np.zeros((4, 1, 2), np.uint8)).reshape(4, -1)
    got = tiff._samples(stored, 9, 2, 32, np.dtype("<u4"), 3)
    assert (got.view(np.float32) == values).all()


def test_pages(spark):
    two = tiff.encode([np.ones((3, 4, 1), np.uint8), np.full((2, 2, 3), 9, np.uint8)], tiff.LZW)
    df = spark.createDataFrame([(1, bytearray(two), 0), (2, None, 0), (3, bytearray(b"junk"), 0), (None, bytearray(two), 0)], "doc_id long, content binary, page int")
    rows = tiff.read_pages(df).collect()
    assert sorted((r["doc_id"] or 0, r["page"], r["width"], r["error"]) for r in rows) == [(0, 0, 4, None), (0, 1, 2, None), (1, 0, 4, None), (1, 1, 2, None), (3, 0, 0, "not a TIFF file")]
    assert tiff.read_pages(df.limit(0)).count() == 0
