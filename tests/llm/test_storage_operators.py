import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import tiff
from tidemill.llm.pack import hilbert_keys, pack, tail_cuts
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.shard import communication_matrix, hypergeometric, shard
from tidemill.llm.tokens import EliasFano, Encoder, TokenFile, read_tokens, write_file, write_tokens


def plain_ids(name, texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path(name))
    return [made.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_encoding_equals_the_untouched_library(rows, name, leading):
    rng = random.Random(3)
    odd = ["a", "B", "é", "İ", "ß", "Ⅷ", "'s", "'S", "12", " ", " ", " ", "\n", "\t", ".", ",", "!", "?", "\u0301", "\u0307", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "中", "\u3000", "\u00a0", "\x1c", "\0", "ſ", "ñ", "ª", "Σ", "ς", "😀", "-"]
    texts = [r[1] or "" for r in rows]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += [" ".join(f"word{rng.randrange(5000)}, Thing{rng.randrange(90)}." for _ in range(60_000))]
    assert len(texts[-1]) > 1_000_000
    code = Encoder(tokenizer_path(name), leading, memo=2000)
    got = [np.frombuffer(x, "<u2").tolist() for at in range(0, len(texts), 100) for x in code(texts[at : at + 100])]
    assert got == plain_ids(name, texts)
    assert code([]) == [] and code([None, ""]) == [b"", b""]


def test_elias_fano_and_token_file():
    rng = random.Random(1)
    for n in (0, 1, 2, 500, 3000):
        values, at = [], 0
        for _ in range(n):
            at += rng.choice((0, 0, 1, 7, 500, 9000))
            values.append(at)
        made = EliasFano.of(np.array(values, np.int64))
        assert made.select(np.arange(n)).tolist() == values
        some = [i for i in range(n) if rng.random() < 0.1][::-1]
        assert made.select(some).tolist() == [values[i] for i in some]
        if n >= 500:
            assert len(made.lows) + len(made.highs) + len(made.ranks) < n * (3 + np.log2(max(values) / n)) / 8 + 100
    texts = [struct.pack(f"<{k}H", *range(k)) for k in (0, 3, 0, 9)]
    file = TokenFile(write_file(texts, 2))
    bounds = file.bounds(0, 4)
    assert [file.ids(a, b) for a, b in zip(bounds[:-1], bounds[1:])] == texts
    assert file.bounds(1, 3).tolist() == bounds[1:4].tolist()
    with pytest.raises(IndexError):
        file.index.select([4])


def test_index_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 2000, 60_000))
    made = EliasFano.of(ends)
    size = len(made.lows) + len(made.highs) + len(made.ranks)
    assert size < len(ends) * (2.3 + np.log2(ends[-1] / len(ends))) / 8 < len(ends) * 8 / 4  # a fourth of a 64-bit table


def test_token_files_hold_all_documents(spark, docs, rows, no_docs):
    where = write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), file_ids=300)
    got = read_tokens(spark, where).orderBy("start").collect()
    ids = dict(zip([r[1] for r in rows], plain_ids("byte_bpe_50k.json", [r[1] for r in rows])))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u2"))) for r in got) == Counter((r[0], (*ids[r[1]], 2)) for r in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert read_tokens(spark, write_tokens(no_docs, tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_packing_cuts_every_id_once(docs, rows, no_docs):
    length = 64
    got = pack(docs, tokenizer_path("word_bpe_49k.json"), length=length, parts=5).collect()
    expect = Counter((r[0], (*i, 2)) for r, i in zip(rows, plain_ids("word_bpe_49k.json", [r[1] for r in rows])))
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in expect.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        whole[(r.doc_id, r.doc_tokens, r.start == 0)].append(r)
    single = [(d, (*i, 2)) for d, i in zip([r[0] for r in rows], plain_ids("word_bpe_49k.json", [r[1] for r in rows])) if [x[0] for x in rows].count(d) == 1]
    for d, ids in single:
        pieces = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u2").tobytes()
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
    assert pack(no_docs, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits = 3
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_tail_cuts():
    assert tail_cuts(4096 * 2 + 11, 4096) == [8192, 8200, 8202]
    assert tail_cuts(8192, 4096) == []


def test_sharding_is_exact_and_gapless(docs, rows, no_docs):
    df = docs.select("doc_id", "text", "n_words", F.lit("x").alias("slot"))
    got = shard(df, ["doc_id", "text"], shards=7, partitions=5, buckets=3)
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert shard(no_docs, ["doc_id"], shards=3).count() == 0
    assert {(r.doc_id, r.shard, r.slot) for r in shard(df, ["doc_id", "text"], 7, partitions=5, buckets=3).collect()} == {(r.doc_id, r.shard, r.slot) for r in out}


def test_dealing_repeated_in_plain_python(spark, rows):
    """Shards and slots worked out again from the rows' hashes: matrix, local order, cuts, order in the shard."""
    shards, partitions, buckets, seed = 5, 4, 3, 17
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(1, "hot")] * 60, "doc_id long, text string").coalesce(1)
    hashed = docs.withColumn("n", F.monotonically_increasing_id())
    seeded = [F.xxhash64(F.lit(seed * 1000 + k), "doc_id", "text", "n").alias(f"h{k}") for k in (1, 2, 3)]
    told = [r.asDict() for r in hashed.select("*", *seeded).collect()]
    groups = [sorted((r for r in told if r["h1"] % partitions == p), key=lambda r: (r["h2"], r["n"])) for p in range(partitions)]
    for group, sends in zip(groups, communication_matrix([len(g) for g in groups], shards, seed)):
        for s, n in enumerate(sends):
            for r in group[:n]:
                r["shard"] = s
            group = group[n:]
    expect = Counter()
    for s in range(shards):
        mine = sorted((r for r in told if r["shard"] == s), key=lambda r: ((r["h3"] % 2**64 >> 33) % buckets, r["h3"], r["n"]))
        expect.update((r["doc_id"], r["text"], s, slot) for slot, r in enumerate(mine))
    got = shard(docs, ["doc_id", "text"], shards, seed, partitions, buckets)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got.collect()) == expect


def test_packed_neighbours_are_alike(spark):
    """Documents of one topic share sequences far more often than chance has it."""
    rng = random.Random(8)
    topics = [[f"{a}{b}" for a in rng.sample("bcdfghklmnprstvw", 6) for b in rng.sample(["ana", "eko", "ilu", "omi", "ury", "asta"], 4)] for _ in range(6)]
    made = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(60))) for i in range(600)]
    got = pack(spark.createDataFrame(made, "doc_id long, text string").repartition(4), tokenizer_path("word_bpe_49k.json"), length=1024).collect()
    sequences = defaultdict(set)
    for r in got:
        sequences[r.sequence_id].add(r.doc_id)
    pairs = [(a % 6 == b % 6) for docs in sequences.values() for a in docs for b in docs if a < b]
    assert np.mean(pairs) > 2.5 / 6  # a sixth by chance


def test_communication_matrix_sums_and_law():
    counts = [0, 5, 1000, 3, 77]
    made = communication_matrix(counts, 4, 1)
    assert [sum(r) for r in made] == counts
    columns = [sum(c) for c in zip(*made)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(counts)
    rng = np.random.default_rng(0)
    draws = [hypergeometric(30, 70, 20, u) for u in rng.random(20000)]
    expect = rng.hypergeometric(30, 70, 20, 200000)
    assert abs(np.mean(draws) - 6) < 0.06 and abs(np.var(draws) - expect.var()) < 0.2
    assert hypergeometric(10**10, 10**10, 10**9, 0.5) == pytest.approx(5 * 10**8, abs=2000)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = np.random.default_rng(4)
    for n in (576, 576 * 9):
        for data in (rng.integers(0, 256, n, np.uint8).tobytes(), (b"abcab" * n)[:n], bytes(n), rng.integers(97, 101, n, np.uint8).tobytes()):
            file = tiff.encode(data, page_rows=4, strip_rows=3, compression=compression, predictor=predictor)
            found = list(tiff.pages(file))
            assert b"".join(p.pixels.tobytes() for p in found) == data
            assert len(found) == -(-n // 576 // 4)


def test_lzw_is_standard():
    # The TIFF 6 specification's worked example: 7 7 7 8 8 7 7 6 6 gives codes 256 7 258 8 8 258 6 6 257.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw
    assert tiff.unpack_lzw(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # Codes widen after entry 511 is added by the writer, one entry later than by the reader.
    data = np.random.default_rng(0).integers(0, 256, 9000, np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def tiled(order, pixels, wide, high, predictor):
    """A hand-made tiled file of one page, deflate."""
    height, width, samples = pixels.shape
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    offsets, sizes = [], []
    for top in range(0, height, high):
        for left in range(0, width, wide):
            tile = np.zeros((high, wide, samples), np.uint8)
            piece = pixels[top : top + high, left : left + wide]
            tile[: piece.shape[0], : piece.shape[1]] = piece
            if predictor == 2:
                tile = np.concatenate((tile[:, :1], np.diff(tile, axis=1)), axis=1)
            raw = zlib.compress(tile.tobytes())
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
    at = []
    for values in (offsets, sizes):
        at.append(len(out))
        out += struct.pack(f"{order}{len(values)}I", *values)
    where = len(out)
    entries = [(256, 4, 1, width), (257, 4, 1, height), (259, 3, 1, 8), (277, 3, 1, samples), (317, 3, 1, predictor), (322, 3, 1, wide), (323, 3, 1, high), (324, 4, len(offsets), at[0]), (325, 4, len(sizes), at[1])]
    out += struct.pack(order + "H", len(entries))
    for tag, kind, n, value in entries:
        out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    out += struct.pack(order + "I", where)  # a loop: the chain points at itself
    struct.pack_into(order + "I", out, 4, where)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_byte_orders_and_loops(order):
    pixels = np.random.default_rng(2).integers(0, 256, (37, 50, 3), np.uint8)
    found = list(tiff.pages(tiled(order, pixels, 16, 16, 2)))
    assert len(found) == 1 and (found[0].pixels == pixels).all()


def test_damaged_pages_are_errors():
    good = bytearray(tiff.encode(bytes(range(64)) * 36, page_rows=8))

    def broken(tag, value):
        made = bytearray(good)
        (at,) = struct.unpack_from("<I", made, 4)
        for k in range(struct.unpack_from("<H", made, at)[0]):
            if struct.unpack_from("<H", made, at + 2 + 12 * k)[0] == tag:
                struct.pack_into("<I", made, at + 10 + 12 * k, value)
        return bytes(made)

    assert len(list(tiff.pages(bytes(good)))) == 1
    for tag, value in ((256, 0), (257, 0), (257, 99), (277, 0), (278, 0), (278, 1), (279, 3), (273, 10**6), (259, 77)):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            list(tiff.pages(broken(tag, value)))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiled_round_trip(order, compression):
    data = np.random.default_rng(4).integers(90, 99, 576 * 70, np.uint8).tobytes()
    file = tiff.encode(data, page_rows=33, strip_rows=16, compression=compression, order=order, tile=160)
    assert b"".join(p.pixels.tobytes() for p in tiff.pages(file)) == data


def test_decode_pages_rows(spark):
    good = tiff.encode(bytes(576 * 5), page_rows=2)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"junk", "x"), (5, good[:40], "x"), (1, good, "x")]
    got = tiff.decode_pages(spark.createDataFrame(rows, "doc_id long, media binary, page string")).collect()
    assert Counter((r.doc_id, r.page) for r in got if r.error is None) == Counter({(1, 0): 2, (1, 1): 2, (1, 2): 2})
    assert {r.doc_id for r in got if r.error} == {3, 4, 5}
    assert tiff.decode_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
