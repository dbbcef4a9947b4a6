"""TIFF images: one row for each page (image directory).

`pages_of` walks the chain of image directories of a file, reads strips or tiles, undoes PackBits, LZW or deflate and the
predictors (horizontal differences, and those of floating point), and gives each page's samples. `encode` writes such files.
Samples have 1, 2, 4, 8, 16 or 32 bits, chunky or in separate planes; those of less than 8 bits come out as a byte each.

Damaged files don't stop a job: a page that can't be read gives a row with `error`, and a chain that loops or leaves the file
ends. Null content gives no page. A page needs memory in proportion to its decoded size; PAGE_BYTES bounds it, and a larger
page is an error row. Texts are stored as pages of TEXT_BYTES at most, so any length can be read back. Their coding is told by
their bytes: PackBits, LZW or deflate, in strips or tiles. Equal texts make equal files; a null text is stored as an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: tags, compressions and the bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PAGE_BYTES = 1 << 28
TEXT_BYTES = 1 << 24


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    parts: int
    pixels: bytes | None
    error: str | None = None


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all between them as they are, in parts of 128 at most."""
    raw = np.frombuffer(data, np.uint8)
    begins = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]])) if len(raw) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(raw)))
    out, at = bytearray(), 0

    def plain(upto: int) -> None:
        for lo in range(at, upto, 128):
            part = data[lo : min(lo + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for begin, n in zip(begins[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        plain(begin)
        at = begin + n
        while n > 1:
            out += bytes((257 - min(n, 128), data[begin]))
            n -= min(n, 128)
        at -= n  # one byte that is left of a long run goes on as it is
    plain(len(data))
    return bytes(out)


def _lzw_width(entries: int) -> int:
    """Bits of a code once the table has so many entries; the format widens one code early."""
    return 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12


def unlzw(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, held, bits, at, last = [], 0, 0, 0, b""
    got, width = 0, 9
    while got < size:
        while bits < width and at < len(data):
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            if code == 256:
                continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        got += len(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = _lzw_width(len(table))
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    codes, last = [256], -1
    table: dict[int, int] = {}  # code and next byte to code
    entries, widths = 258, [9]
    for c in data:
        if last < 0:
            last = c
            continue
        key = last << 8 | c
        if (found := table.get(key)) is not None:
            last = found
            continue
        codes.append(last)
        # the reader's table is one entry behind
        widths.append(_lzw_width(entries - 1))
        table[key] = entries
        entries += 1
        if entries == 4094:
            codes.append(256)
            widths.append(_lzw_width(entries - 1))
            table, entries = {}, 258
        last = c
    if last >= 0:
        codes.append(last)
        widths.append(_lzw_width(entries - 1))
        entries += 1
    codes.append(257)
    widths.append(_lzw_width(entries - 1))
    width = np.array(widths)
    bits = (np.array(codes)[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(11, -1, -1) < width[:, None]].astype(np.uint8)).tobytes()


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression}")


def _packed(data: bytes, compression: int, level: int) -> bytes:
    return {RAW: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: lzw(data), DEFLATE: lambda: zlib.compress(data, level)}[compression]()


class _File:
    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        self.order = order
        self.first = struct.unpack_from(order + "I", data, 4)[0]

    def directory(self, at: int) -> tuple[dict[int, list[int]], int]:
        """Integer tags of the directory at `at`, and where the next one is (0: none)."""
        n = struct.unpack_from(self.order + "H", self.data, at)[0]
        tags: dict[int, list[int]] = {}
        for i in range(n):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, place)
            size = TYPE_BYTES.get(kind, 0) * count
            if kind not in (1, 3, 4) or size > len(self.data):
                continue
            where = place + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.data, place + 8)[0]
            tags[tag] = list(struct.unpack_from(self.order + f"{count}{'BxHI'[kind - 1]}", self.data, where)) if count else []
        return tags, struct.unpack_from(self.order + "I", self.data, at + 2 + 12 * n)[0]


def _samples(raw: np.ndarray, across: int, deep: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The samples (rows, across, deep) of rows of bytes, without the predictor."""
    own = kind.newbyteorder("=")
    if bits < 8:
        each = np.unpackbits(raw, axis=1).reshape(len(raw), -1, bits)
        return (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : across * deep].reshape(len(raw), across, deep)
    if predictor == 3:  # differences between bytes, then planes of bytes from the most significant on
        whole = np.cumsum(raw.reshape(len(raw), -1, deep), axis=1, dtype=np.uint8).reshape(len(raw), bits // 8, -1)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(np.dtype(f">u{bits // 8}")).astype(own).reshape(len(raw), across, deep)
    out = np.ascontiguousarray(raw).view(kind).astype(own).reshape(len(raw), across, deep)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def _page(file: _File, tags: dict[int, list[int]], number: int) -> Page:
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    page = Page(number, width, height, samples, bits, compression, predictor, 0, None)
    try:
        if bits not in (1, 2, 4, 8, 16, 32) or any(b != bits for b in tags.get(BITS, [])):
            raise ValueError(f"{bits} bits a sample")
        if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits < 16:
            raise ValueError(f"predictor {predictor} of {bits} bits")
        if not width or not height or width * height * samples * max(8, bits) // 8 > PAGE_BYTES:
            raise ValueError("size out of range")
        planes = samples if one(PLANAR, 1) == 2 else 1
        deep = samples // planes
        kind = np.dtype(np.uint8 if bits <= 8 else file.order + f"u{bits // 8}")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        if not across or not down or across * down * deep * max(8, bits) // 8 > PAGE_BYTES:
            raise ValueError("tile size out of range")
        offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
        columns, rows = -(-width // across), -(-height // down)
        page.parts = planes * columns * rows
        if len(offsets) < page.parts or len(sizes) < page.parts:
            raise ValueError("parts are missing")
        whole = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k in range(page.parts):
            plane, place = divmod(k, columns * rows)
            r, c = divmod(place, columns)
            high = down if tiled else min(down, height - r * down)
            line = -(-across * deep * bits // 8)  # a row begins with a byte of its own
            size = line * high
            raw = _unpacked(file.data[offsets[k] : offsets[k] + sizes[k]], compression, size)
            if len(raw) < size:
                raise ValueError("a part is too short")
            part = _samples(np.frombuffer(raw, np.uint8, size).reshape(high, line), across, deep, bits, kind, predictor)
            y, x = r * down, c * across
            part = part[: height - y, : width - x]
            whole[y : y + part.shape[0], x : x + part.shape[1], plane * deep : plane * deep + deep] = part
        page.pixels = whole.tobytes()
    except (ValueError, struct.error, zlib.error, IndexError) as e:
        page.error = str(e)
    return page


def pages_of(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its chain of directories."""
    try:
        file = _File(data)
    except (ValueError, struct.error) as e:
        yield Page(0, 0, 0, 0, 0, 0, 0, 0, None, str(e))
        return
    at, seen, number = file.first, set(), 0
    while at and at not in seen:
        seen.add(at)
        try:
            tags, following = file.directory(at)
        except struct.error:
            yield Page(number, 0, 0, 0, 0, 0, 0, 0, None, "a directory leaves the file")
            return
        yield _page(file, tags, number)
        at, number = following, number + 1


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: int = 0, order: str = "<", planar: bool = False, level: int = 1) -> bytes:
    """A file of one page for each image (height, width, samples) of uint8 or uint16; tile: side of tiles, 0 for strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        planes = [image[:, :, i : i + 1] for i in range(samples)] if planar else [image]
        offsets, sizes = [], []
        for plane in planes:
            for y in range(0, height, tile or rows):
                for x in range(0, width, tile or width):
                    part = plane[y : y + (tile or rows), x : x + (tile or width)]
                    if tile:
                        part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)), mode="edge")
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                    raw = _packed(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression, level)
                    offsets.append(len(out))
                    sizes.append(len(raw))
                    out += raw + b"\0" * (len(raw) % 2)
        bits = image.dtype.itemsize * 8
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            packed = struct.pack(order + f"{len(values)}{'xxHI'[kind - 1]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed
                packed = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries) // 12) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


_PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, parts int, pixels binary, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PAGES.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 8, pa.binary(), pa.string()]
    for block in common.blocks(batches, "content"):
        rows = [(doc, p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.parts, p.pixels, p.error) for doc, content in zip(block.column("doc_id").to_pylist(), block.column("content").to_pylist(), strict=True) if content is not None for p in pages_of(content)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_pages(files: DataFrame) -> DataFrame:
    """One row for each page of the files (doc_id, content): its place, shape, coding, samples (row by row) and error."""
    common.small_batches(files.sparkSession)
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(_read, _PAGES)


SIDE = 64


#: How a text may be stored: compression and side of tiles (0: strips).
FORMS = [(c, tile) for tile in (0, SIDE) for c in (DEFLATE, LZW, PACKBITS)]


def text_images(text: str | None) -> list[np.ndarray]:
    """A text's bytes, padded with 0 to a positive multiple of SIDE, as pages of rows of SIDE samples."""
    raw = (text or "").encode()
    size = max(SIDE, -(-len(raw) // SIDE) * SIDE)
    rows = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, SIDE, 1)
    high = max(1, TEXT_BYTES // SIDE)
    return [rows[y : y + high] for y in range(0, len(rows), high)]


def text_file(text: str | None) -> bytes:
    compression, tile = FORMS[zlib.crc32((text or "").encode()) % len(FORMS)]
    # differences make no runs for PackBits to pack
    return encode(text_images(text), compression, 1 if compression == PACKBITS else 2, tile=tile)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        texts = block.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(map(text_file, texts), pa.binary())], names=["doc_id", "n_bytes", "content"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and content: each text as a file of one page or more, in the form that its bytes choose."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, content binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each stored file's pages and takes their features."""
    for block in common.blocks(batches, "content"):
        rows = []
        for content in block.column("content").to_pylist():
            pages = list(pages_of(content))
            pixels = b"".join(p.pixels or b"" for p in pages)
            first = pages[0]
            values = np.frombuffer(pixels, np.uint8)
            feature = f"pages={len(pages)};width={first.width};height={first.height};parts={first.parts};compression={first.compression};predictor={first.predictor};sum={int(values.sum(dtype=np.int64))};max={int(values.max(initial=0))};errors={sum(p.error is not None for p in pages)}"
            rows.append((len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]), len(content), hashlib.sha256(content).hexdigest(), feature))
        cols = zip(*rows, strict=True)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each text as TIFF, reads the stored bytes back and takes their features; one row for each row."""
    return store_texts(docs).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
