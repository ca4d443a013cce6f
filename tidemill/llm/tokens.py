"""Token ids of whole texts, and token files with Elias-Fano document boundaries.

``Encoder`` runs a public tokenizer of the tokenizers library. Both supported kinds split at spaces before they
merge, so texts are cut there; Arrow finds the distinct chunks of a slice of texts and each is encoded once, parts of
them once a worker while they are remembered. Texts where a cut could change the result (white space beside a space,
for byte-level vocabularies) are encoded whole.

A token file holds the concatenated ids of many documents in 2 or 4 bytes each, and the documents' ends as an
Elias-Fano sequence: low bits packed, high bits in a bitmap with sampled ranks, so ``select`` finds any boundary
without a table of 64-bit offsets. Readers get every range of ids by ``select``. Files are rows of a table in the
shared folder: Spark's commit protocol covers lost executors, and no executor needs a mount of its own.

Defined results: null and empty texts have the end id alone; control strings of the tokenizer inside texts become
their ids, as the library does by default; rows with equal ids stand in hash order of their text; a null id comes
first; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, shared_dir, slices

MAGIC = b"TIDETOK1"
HEADER = struct.Struct("<8sBBHQQ")
RANK_BYTES = 64

#: Texts with such white space are not cut for byte-level vocabularies: runs of it, or kinds other than space and line end.
_ODD = "[\t\v\f\r\x00\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\n\n| \n|\n "
#: A plain word with a point behind it. Lower-casing or composing these letters never leaves a mark before the point.
_POINTED = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]$"
_PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one past 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """Ids of whole texts in 2 or 4 bytes each.

    leading_space: chunks carry the space before them (byte-level vocabularies); otherwise white space and case are
    dropped by the tokenizer. A point behind a plain letter is always a token of its own, so "word." is put together
    from "word" and ".". memo: parts that are remembered (about 200 bytes each, none over 48 characters); all are
    forgotten when it is full.
    """

    def __init__(self, path: str, leading_space: bool, memo: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars = self.tokenizer.model, _byte_chars()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.letter, self.kind = ("H", "<u2") if self.width == 2 else ("I", "<u4")
        self.leading_space, self.room, self.memo = leading_space, memo, {}

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts in order, and for each text the number of chunks before its end."""
        if self.leading_space:
            odd = pc.match_substring_regex(texts, _ODD)
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
            if pc.any(odd).as_py():
                lists = pc.split_pattern(pc.if_else(odd, "", marked), "\0").to_pylist()
                for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                    lists[i] = [texts[i].as_py()]
                lists = pa.array(lists, pa.list_(pa.string()))
            else:
                lists = pc.split_pattern(marked, "\0")
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))

    def _told(self, part: str) -> list[int]:
        """Ids of a plain word: to the tokenizer a run of letters is one word, so its model merges it as it is."""
        if not self.leading_space:
            part = part.lower()
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.chars)
        elif part[0] == " ":
            part = self.chars[0x20] + part[1:]
        return [t.id for t in self.model.tokenize(part)]

    def _parts(self, parts: pa.Array) -> list[bytes]:
        """Ids of distinct parts."""
        memo = self.memo
        plain = pc.match_substring_regex(parts, _PLAIN).to_numpy(zero_copy_only=False)
        names = parts.to_numpy(zero_copy_only=False).tolist()
        out = [memo.get(p) for p in names]
        rest = []
        for i, made in enumerate(out):
            if made is None:
                if plain[i]:
                    out[i] = array(self.letter, self._told(names[i])).tobytes()
                else:
                    rest.append(i)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, made in zip(some, self.tokenizer.encode_batch_fast([names[i] for i in some], add_special_tokens=False)):
                out[i] = array(self.letter, made.ids).tobytes()
        if len(memo) + len(names) > self.room:
            memo.clear()
        memo.update((p, x) for p, x in zip(names, out) if len(p) <= 48)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, with the end of the last)."""
        chunks, upto = self._cut(pc.fill_null(texts, "").cast(pa.string()))
        coded = chunks.dictionary_encode()
        kinds = coded.dictionary
        pointed = pc.match_substring_regex(kinds, _POINTED)
        stems = pc.if_else(pointed, pc.utf8_slice_codeunits(kinds, 0, -1), kinds)
        ends = pc.if_else(pointed, pc.utf8_slice_codeunits(kinds, -1, None), "")
        if not self.leading_space:  # the tokenizer lowers letters itself; here it makes fewer parts
            stems = pc.if_else(pc.match_substring_regex(stems, "^[A-Za-z]+$"), pc.ascii_lower(stems), stems)
        both = pa.concat_arrays([stems, ends]).dictionary_encode()
        made = self._parts(both.dictionary)
        raw = np.frombuffer(b"".join(made), self.kind)
        size = np.fromiter(map(len, made), np.int64, len(made)) // self.width
        start = np.cumsum(size) - size
        place = both.indices.to_numpy().reshape(2, -1)  # of each kind of chunk: its stem, its point
        which = place[:, coded.indices.to_numpy()].T.ravel()
        n = size[which]
        past = np.cumsum(n)
        ids = raw[np.repeat(start[which] - past + n, n) + np.arange(past[-1] if len(past) else 0)]
        return ids, np.concatenate(([0], np.concatenate(([0], past))[2 * upto])).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, bounds = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encoder(path: str, leading_space: bool) -> Encoder:
    """The worker's encoder."""
    return held(("encoder", path, leading_space), lambda: Encoder(path, leading_space))


def ids_crc32(ids: bytes, width: int) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence in about 2 + log2(top / n) bits a value."""

    n: int
    low_bits: int
    lows: bytes
    highs: bytes
    ranks: bytes  # ones before each run of RANK_BYTES bitmap bytes, 4 bytes a run

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << low_bits) - 1)
        bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        where = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(where[-1]) + 1 if n else 0, np.uint8)
        bitmap[where] = 1
        highs = np.packbits(bitmap, bitorder="little")
        ones = np.bitwise_count(highs).astype(np.int64)
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), RANK_BYTES)))[:-1])) if len(ones) else np.zeros(0)
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), highs.tobytes(), ranks.astype("<u4").tobytes())

    def select(self, places) -> np.ndarray:
        """Values number ``places``: a search of the sampled ranks, then of one run of the bitmap for each."""
        i = np.asarray(places, np.int64)
        if i.size and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(places)
        run = np.searchsorted(np.frombuffer(self.ranks, "<u4"), i, side="right") - 1
        runs, which = np.unique(run, return_inverse=True)
        padded = np.frombuffer(self.highs + bytes(-len(self.highs) % RANK_BYTES), np.uint8).reshape(-1, RANK_BYTES)
        ones = np.flatnonzero(np.unpackbits(padded[runs], axis=1, bitorder="little"))
        first = np.searchsorted(ones, np.arange(len(runs)) * RANK_BYTES * 8)
        at = ones[first[which] + i - np.frombuffer(self.ranks, "<u4")[run]] - which * RANK_BYTES * 8 + run * RANK_BYTES * 8
        return (at - i) << self.low_bits | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        raw = np.frombuffer(self.lows + bytes(9), np.uint8)
        word = sum(raw[at // 8 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8)) if i.size else np.zeros(0, np.uint64)
        return (word >> (at % 8).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def write_file(texts: list[bytes], width: int) -> bytes:
    """A token file of the documents' id bytes."""
    ends = np.cumsum([len(t) // width for t in texts])
    index = EliasFano.of(ends)
    ids = b"".join(texts)
    head = HEADER.pack(MAGIC, width, index.low_bits, 0, len(texts), len(ids) // width)
    parts = (index.lows, index.highs, index.ranks)
    return head + struct.pack("<3Q", *map(len, parts)) + b"".join(parts) + ids


class TokenFile:
    """Reads a token file: ``bounds(i)`` by select, ``ids(i)`` as little-endian bytes."""

    def __init__(self, data: bytes):
        magic, self.width, low_bits, _, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = struct.unpack_from("<3Q", data, HEADER.size)
        parts, at = [], HEADER.size + 24
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        self.index, self.data, self.at = EliasFano(self.n_docs, low_bits, *parts), data, at

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where the ids of documents ``first`` to ``last - 1`` begin, and the end of the last, by select."""
        ends = self.index.select(np.arange(max(0, first - 1), last))
        return ends if first else np.concatenate(([0], ends))

    def ids(self, first: int, last: int) -> bytes:
        return self.data[self.at + first * self.width : self.at + last * self.width]


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    leading_space: bool = True,
    file_ids: int = 1 << 16,
) -> str:
    """Encode every text and write token files in ascending id order; returns the folder.

    file_ids: ids after which a file ends; a file is a row, and readers hold a batch of rows.
    Texts are range-partitioned by id (and by a hash of the text, so that one repeated id doesn't fill a task) and
    sorted in their partitions. Columns of the table: part, seq (a file's place), base (ids of the part before the
    file), n_ids, docs (ids of its documents), file.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "tokens")
    tie = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"), tie.alias("h"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "d", "h").sortWithinPartitions("d", "h", "t")

    def run(batches):
        code = encoder(tokenizer, leading_space)
        end = end_id.to_bytes(code.width, "little")
        part, seq, base, n, texts, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def out():
            row = (part, seq, base, n, ids, write_file(texts, code.width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "seq", "base", "n_ids", "docs", "file"])

        for whole in batches:
            for batch in slices(whole, "t", 3 << 20):
                made, bounds = code.encode(batch.column(1))
                for d, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    texts.append(made[a:b].tobytes() + end)
                    ids.append(d)
                    n += b - a + 1
                    if n >= file_ids:
                        yield out()
                        seq, base, n, texts, ids = seq + 1, base + n, 0, [], []
        if texts:
            yield out()

    rows.mapInArrow(run, "part int, seq int, base long, n_ids long, docs array<bigint>, file binary").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(where)
    return where


def read_tokens(spark, where: str) -> DataFrame:
    """One row per document from the token files: doc_id, start (ids of all documents before it), n_tokens, ids.

    Only one count a partition of the writer reaches the driver.
    """
    files = spark.read.parquet(where)
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(part, 0)
    base = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("part") + 1)

    def run(batches):
        for batch in batches:
            for first, docs, data in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(data)
                for k in range(0, file.n_docs, 256):
                    here = docs[k : k + 256]
                    bounds = file.bounds(k, k + len(here)).tolist()
                    s, e = bounds[:-1], bounds[1:]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(here, pa.int64()),
                            pa.array([first + x for x in s], pa.int64()),
                            pa.array([b - a for a, b in zip(s, e)], pa.int64()),
                            pa.array([file.ids(a, b) for a, b in zip(s, e)], pa.binary()),
                            pa.array([file.width] * len(s), pa.int32()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids", "width"],
                    )

    rows = files.select((base + F.col("base")).alias("first"), "docs", "file")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, width int")
