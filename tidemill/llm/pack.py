"""Packing along a space-filling curve: neighbouring documents share sequences, with next to no padding.

Every text is encoded, its ids are hashed and projected to three dimensions, and the Hilbert key of that point (with
a hash of the id in its low bits, so that copies spread) orders the corpus. The order is cut at quantiles of the key
into parts; one token count a part gives every document its place in the whole stream, which is cut every
``length`` ids. What is left at the end goes to sequences of falling powers of two, so nothing is padded.

Defined results: null and empty texts have the end id alone; equal rows are interchangeable and each is packed; an
empty table gives no pieces. A document may be cut anywhere and runs through as many sequences as it needs.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, stored
from .tokens import encoder, ids_crc32

DIMS, BITS, TIE_BITS = 3, 10, 22


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of ``points`` (unsigned coordinates of ``bits`` bits).

    The coordinates are turned level by level from the top bit down: where a coordinate's bit is set the lower bits
    of the first are mirrored, else they are exchanged with it; Gray decoding then gives the index, most significant
    level first.
    """
    x = [np.array(points[:, d], np.int64) for d in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(n):
            up = (x[d] >> level & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x = [c ^ flip for c in x]
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c >> level & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray, end_id: int, seed: int = 11) -> np.ndarray:
    """Hilbert keys of documents: mean of a fixed random projection of their hashed ids, squashed to the grid.

    bounds: where each document's ids begin, and the end of the last; each has the end id besides.
    """
    table = np.rint(np.random.default_rng(seed).standard_normal((8192, DIMS)) * (1 << 20)).astype(np.int64)
    cell = lambda x: (x * 2654435761 >> 7) & 8191
    hashed = cell(np.arange(1 << 16))[ids] if ids.itemsize == 2 else cell(ids.astype(np.int64))
    n = np.diff(bounds) + 1
    grid = np.empty((len(n), DIMS), np.int64)
    for d in range(DIMS):
        upto = np.concatenate(([0], np.cumsum(table[:, d][hashed])))
        mean = (upto[bounds[1:]] - upto[bounds[:-1]] + table[cell(end_id), d]) / n / (1 << 20)
        grid[:, d] = (np.tanh(2 * mean) + 1) / 2 * ((1 << BITS) - 1)
    return hilbert_keys(grid)


def tail_cuts(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one: falling powers of two."""
    at, cuts = total // length * length, []
    while at < total:
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return cuts


def _place(bounds: list[int], key: str):
    """Number of ``bounds`` (sorted) below ``key``: a binary search, one step for each halving."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if not steps:
        return F.lit(0)
    padded = bounds + [(1 << 63) - 1] * (2 * steps[0] - len(bounds))
    held = F.from_json(F.lit(json.dumps(padded)), "array<bigint>")
    walk = F.from_json(F.lit(json.dumps(steps)), "array<int>")
    return F.aggregate(walk, F.lit(0), lambda p, step: F.when(F.element_at(held, p + step) < F.col(key), p + step).otherwise(p))


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    length: int = 4096,
    leading_space: bool = False,
    parts: int | None = None,
    part_ids: int = 4 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, width, doc_tokens, sequence_id, offset.

    parts: pieces of the curve that tasks order, by default one for each ``part_ids`` ids; only their token counts and
    key bounds reach the driver.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("curve", T.LongType())]

    def encode(batch):
        code = encoder(tokenizer, leading_space)
        end = end_id.to_bytes(code.width, "little")
        ids, bounds = code.encode(batch.column(batch.schema.get_field_index("text")))
        made = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        n = np.diff(bounds) + 1
        return [pa.array(made, pa.binary()), pa.array(np.full(len(n), code.width, np.int32)), pa.array(n), pa.array(curve_keys(ids, bounds, end_id))]

    # A row's place in its task sets copies apart even where ids are null or repeat.
    tie = F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(1 << TIE_BITS))
    coded = add_columns(rows, fields, encode, keep=["doc_id"], by="text")
    tokens = stored(coded.withColumn("key", F.shiftleft("curve", TIE_BITS) + tie).drop("curve"), "pack-tokens")
    if parts is None:
        parts = -(-(tokens.agg(F.sum("n").alias("n")).first()["n"] or 0) // part_ids)
    light = tokens.select(F.col("key").cast("double").alias("key"), "n")
    found = light.approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in found})
    tokens = tokens.withColumn("part", _place(bounds, "key"))
    sizes = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for p in range(len(bounds) + 1):
        before[p] = at
        at += sizes.get(p, 0)
    total = at
    tail = tail_cuts(total, length)
    full = total // length

    def cut(batches):
        part, at = None, 0
        starts = np.array([*tail, total])
        for batch in batches:
            out = [[] for _ in range(8)]
            for d, ids, width, n, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "ids", "width", "n", "part"))):
                if p != part:
                    part, at = p, before[p]
                done = 0
                while done < n:
                    if at < full * length:
                        number, first, room = at // length, at // length * length, length
                    else:
                        k = int(np.searchsorted(starts, at, side="right")) - 1
                        number, first, room = full + k, int(starts[k]), int(starts[k + 1] - starts[k])
                    take = min(n - done, first + room - at)
                    for col, v in zip(out, (d, done, take, ids[done * width : (done + take) * width], width, n, number, at - first)):
                        col.append(v)
                    done, at = done + take, at + take
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids", "width", "doc_tokens", "sequence_id", "offset"])

    ordered = tokens.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "doc_id", "n", "ids")
    return ordered.mapInArrow(cut, "doc_id long, start long, length long, ids binary, width int, doc_tokens long, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``, of a row's ids as little-endian unsigned 32-bit integers, and drops ids and width."""
    crc = [T.StructField("ids_crc32", T.LongType())]

    def run(batch):
        ids, width = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "width"))
        return [[ids_crc32(x, w) for x, w in zip(ids, width)]]

    return add_columns(pieces, crc, run, keep=[c for c in pieces.columns if c not in ("ids", "width")])
