"""TIFF media columns: write grey 8-bit pages, and read pages back from any strip or tile layout.

The reader walks the chain of image directories of little- or big-endian files, decodes PackBits, LZW and deflate
strips or tiles, undoes the horizontal predictor and yields one row per page. The writer stores a payload as pages
of fixed width, in strips or tiles of either byte order.

Defined results: a null medium gives no pages; damaged media (zero sizes, missing, short or surplus strips or tiles,
unknown compression, separate planes, broken directories) give one row with page -1 and the error after the pages that
could be read, never an exception and never made-up pixels; repeated media repeat their rows; a directory chain that
loops ends at the first repeat. Columns that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8

NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG = 256, 257, 258, 259, 262
STRIPS_TAG, SAMPLES_TAG, ROWS_TAG, STRIP_BYTES_TAG, PLANES_TAG, PREDICTOR_TAG = 273, 277, 278, 279, 284, 317
TILE_WIDTH_TAG, TILE_HEIGHT_TAG, TILES_TAG, TILE_BYTES_TAG = 322, 323, 324, 325
#: Letters and bytes of the directory's field types: byte, ascii, short, long, and their signed forms.
KINDS = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples, uint8


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more as (257 - n, byte), other bytes in literal stretches of up to 128."""
    out, at = bytearray(), 0

    def literal(upto: int):
        for k in range(at, upto, 128):
            part = data[k : min(upto, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        at = run.end()
        out += bytes((257 - at + run.start(), data[at - 1]))
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one entry early, 256 clears, 257 ends."""
    codes, widths = [256], [9]  # widths: from each place in codes on
    places = [0]
    table: dict[int, int] = {}  # (code of a string, next byte) to the code of both
    free, wide, seen = 258, 9, -1

    def widen(bits: int):
        widths.append(bits)
        places.append(len(codes))

    for byte in data:
        if seen < 0:
            seen = byte
            continue
        more = seen << 8 | byte
        if more in table:
            seen = table[more]
            continue
        codes.append(seen)
        table[more] = free
        free += 1
        if free == 4094:
            codes.append(256)
            table, free, wide = {}, 258, 9
            widen(9)
        elif free >= 1 << wide and wide < 12:
            wide += 1
            widen(wide)
        seen = byte
    if seen >= 0:
        codes.append(seen)
        free += 1
        if free >= 1 << wide and wide < 12:
            widen(wide + 1)
    codes.append(257)
    size = np.repeat(widths, np.diff([*places, len(codes)]))
    shift = size[:, None] - 1 - np.arange(12)
    bits = np.array(codes)[:, None] >> np.maximum(shift, 0) & 1
    return np.packbits(bits[shift >= 0].astype(np.uint8)).tobytes()


def unpack_lzw(data: bytes) -> bytes:
    out: list[bytes] = []
    table: list[bytes] = []
    bits = held = 0
    width, last = 9, b""
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}
UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, DEFLATE_OLD: zlib.decompress, PACKBITS: unpack_bits}


def encode(
    payload: bytes,
    width: int = 576,
    page_rows: int = 4096,
    strip_rows: int = 128,
    compression: int = DEFLATE,
    predictor: int = 2,
    order: str = "<",
    tile: int | None = None,
) -> bytes:
    """TIFF of as many pages as the payload needs; its length is a multiple of ``width``.

    order: "<" little-endian, ">" big-endian. tile: width of tiles (``strip_rows`` high) instead of strips.
    """
    if not payload or len(payload) % width:
        raise ValueError("a payload is a positive multiple of the width")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    wide = tile or width
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        offsets, sizes = [], []
        for row in range(0, len(page), strip_rows):
            for left in range(0, width, wide):
                block = page[row : row + strip_rows, left : left + wide]
                if tile:  # tiles are whole, their rest is empty
                    block = np.pad(block, ((0, strip_rows - block.shape[0]), (0, wide - block.shape[1])))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                made = PACK[compression](block.tobytes())
                offsets.append(len(out))
                sizes.append(len(made))
                out += made + b"\0" * (len(made) & 1)
        entries = [(WIDTH_TAG, 4, [width]), (HEIGHT_TAG, 4, [len(page)]), (BITS_TAG, 3, [8]), (COMPRESSION_TAG, 3, [compression]), (PHOTOMETRIC_TAG, 3, [1])]
        if not tile:
            entries.append((STRIPS_TAG, 4, offsets))
        entries.append((SAMPLES_TAG, 3, [1]))
        if not tile:
            entries += [(ROWS_TAG, 4, [strip_rows]), (STRIP_BYTES_TAG, 4, sizes)]
        entries.append((PREDICTOR_TAG, 3, [predictor]))
        if tile:
            entries += [(TILE_WIDTH_TAG, 4, [wide]), (TILE_HEIGHT_TAG, 4, [strip_rows]), (TILES_TAG, 4, offsets), (TILE_BYTES_TAG, 4, sizes)]
        body = b""
        for tag, kind, values in entries:
            raw = struct.pack(f"{order}{len(values)}{KINDS[kind][0]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", at)
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + body
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in KINDS:
            letter, step = KINDS[kind]
            where = at + 10 + 12 * k
            if n * step > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(f"{order}{n}{letter}", data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = tags[WIDTH_TAG][0], tags[HEIGHT_TAG][0], one(SAMPLES_TAG, 1)
    compression, predictor = one(COMPRESSION_TAG, NONE), one(PREDICTOR_TAG, 1)
    if any(b != 8 for b in tags.get(BITS_TAG, (8,))) or compression not in UNPACK or predictor not in (1, 2):
        raise ValueError("only 8-bit pages in a known compression are read")
    if one(PLANES_TAG, 1) != 1:
        raise ValueError("separate planes are not read")
    tiled = TILES_TAG in tags
    wide = tags[TILE_WIDTH_TAG][0] if tiled else width
    high = tags[TILE_HEIGHT_TAG][0] if tiled else min(one(ROWS_TAG, height), height)
    if min(width, height, samples, wide, high) < 1:
        raise ValueError("a size is zero")
    places, sizes = (tags[TILES_TAG], tags[TILE_BYTES_TAG]) if tiled else (tags[STRIPS_TAG], tags[STRIP_BYTES_TAG])
    across, down = -(-width // wide), -(-height // high)
    if not len(places) == len(sizes) == across * down:
        raise ValueError(f"{len(places)} strips or tiles of {across * down}")
    if any(at + size > len(data) for at, size in zip(places, sizes)):
        raise ValueError("a strip or tile lies outside the file")
    blocks = []
    for k, (at, size) in enumerate(zip(places, sizes)):
        rows = high if tiled else min(high, height - k * high)
        raw = UNPACK[compression](data[at : at + size])
        if len(raw) < rows * wide * samples:
            raise ValueError(f"strip or tile {k} is short")
        blocks.append(np.frombuffer(raw, np.uint8, rows * wide * samples).reshape(rows, wide, samples))
    pixels = np.empty((height, width, samples), np.uint8)  # only now: its size is what the blocks hold
    for k, block in enumerate(blocks):
        top, left = k // across * high, k % across * wide
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        pixels[top : top + block.shape[0], left : left + wide] = block[: height - top, : width - left]
    return Page(width, height, samples, compression, predictor, pixels)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directory chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags)


PAGE_FIELDS = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def decode_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each medium; the medium's other columns repeat, pages of one medium stay together."""
    made = T._parse_datatype_string(PAGE_FIELDS)
    new = {f.name.lower() for f in made.fields}
    kept = [f for f in media.schema.fields if f.name != column and f.name.lower() not in new]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            rows, cols = [], [[] for _ in made.fields]
            size = 0

            def out():
                index = pa.array(rows, pa.int64())
                held = [batch.column(batch.schema.get_field_index(n)).take(index) for n in names]
                kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
                return pa.RecordBatch.from_arrays([*held, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*names, *(f.name for f in made.fields)])

            for i, data in enumerate(utf8(batch, column)):
                if data is None:
                    continue
                k = -1
                try:
                    for k, p in enumerate(pages(data)):
                        raw = p.pixels.tobytes()
                        size += len(raw)
                        for col, v in zip(cols, (k, p.width, p.height, p.samples, p.compression, p.predictor, raw, None)):
                            col.append(v)
                        rows.append(i)
                except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
                    for col, v in zip(cols, (-1, None, None, None, None, None, None, f"{type(e).__name__}: {e}")):
                        col.append(v)
                    rows.append(i)
                if size > 16_000_000:
                    yield out()
                    rows, cols, size = [], [[] for _ in made.fields], 0
            if rows:
                yield out()

    return media.mapInArrow(run, T.StructType([*kept, *made.fields]))
