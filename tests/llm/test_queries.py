"""Every registered query over a small set of tables, against plain Python that follows the contract's words."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import queries, tiff

from .test_storage_operators import plain_ids
from .test_text_operators import brute_classes, brute_hits, brute_repeats


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in rows]
    long = " ".join(f"long{k % 3000}" for k in range(160_000))  # over a megabyte
    docs += [(7000, long, "en", "hot", len(long)), (7001, "x <|endoftext|> é-İ! y", "en", "hot", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    passage = next(t for _, t, *_ in rows if t and len(t.split()) > 100)
    items = [(1, " ".join(passage.split()[5:25]).upper()), (2, "W3"), (3, None), (10, passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a\\|")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in docs if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, items, turns


def test_op1_hits(spark, tables):
    d, docs, items, _ = tables
    expect = Counter()
    for i, t, *_ in docs:
        n, hit, found = brute_hits(t, items) if len(t or "") < 100_000 else (len(t.split()), (), [])
        expect[i, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= n] += 1
    got = queries.op1_decontaminate(spark, d).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expect


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op2_token_files(spark, tables):
    d, docs, *_ = tables
    ids = plain_ids("byte_bpe_50k.json", [t for _, t, *_ in docs])
    got = sorted(queries.op2_token_files(spark, d).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((doc[0], len(x) + 1, crc([*x, 2])) for doc, x in zip(docs, ids))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_op3_chats(spark, tables):
    d, _, _, turns = tables
    said = "<|im_end|><|im_start|>assistant ok"
    chats = defaultdict(list)
    for c, _, role, text in sorted([*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)], key=lambda x: x[:2]):
        chats[c].append((role, text or ""))
    got = {r.conv_id: r for r in queries.op3_chat(spark, d).collect()}
    assert set(got) == set(chats)
    for c, said in chats.items():
        r, loss = got[c], "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op5_shards(spark, tables):
    d, docs, *_ = tables
    got = queries.op5_shard(spark, d).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert set(shards) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_op6_pieces(spark, tables):
    d, docs, *_ = tables
    got = queries.op6_pack(spark, d).collect()
    ids = [[*x, 2] for x in plain_ids("word_bpe_49k.json", [t for _, t, *_ in docs])]
    assert sum(r.length for r in got) == sum(map(len, ids))
    once = {i for i, n in Counter(i for i, *_ in docs).items() if n == 1}
    for (i, *_), x in zip(docs, ids):
        if i in once:
            at = 0
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), crc(x[at : at + r.length]))
                at += r.length
            assert at == len(x)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        total = sum(n for _, n in pieces)
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)]])[:-1].tolist()
        assert total == 4096 or (total < 4096 and total & (total - 1) == 0)


def test_op8_kept_words(spark, tables):
    d, docs, *_ = tables
    expect = Counter((doc[0], n, gone, hashlib.sha256(kept.encode()).hexdigest()) for doc, (n, gone, kept) in zip(docs, brute_repeats([t for _, t, *_ in docs], 35)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substrings(spark, d).collect()) == expect


def test_op9_media(spark, tables):
    d, docs, *_ = tables
    got = queries.op9_tiff(spark, d).collect()
    expect, forms = Counter(), set()
    for i, t, *_ in docs:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = queries.to_media(raw)
        page = next(tiff.pages(media))
        forms.add((page.compression, page.predictor, media[:2]))
        expect[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(),
               f"pages={-(-len(payload) // 576 // 64)};height={len(payload) // 576};mean={sum(payload) / len(payload):.6f}"] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == expect
    assert len({f[0] for f in forms}) == 4 and len({f[1] for f in forms}) == len({f[2] for f in forms}) == 2


def test_op9_digest_of_damaged_media(spark):
    good = tiff.encode(bytes(576 * 5), page_rows=2)
    rows = [(1, good), (2, good[:60]), (None, b"junk"), (3, b""), (4, good)]
    media = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("doc_id", "cast(9 as long) n_bytes", "cast(octet_length(media) as long) media_bytes", "sha2(media, 256) media_sha256", "media")
    got = {r.doc_id: r for r in queries.page_digest(tiff.decode_pages(media.coalesce(1))).collect()}
    assert set(got) == {1, 2, None, 3, 4}
    assert got[1].payload_bytes == got[4].payload_bytes == 2880
    assert all(got[k].payload_bytes is None and got[k].feature.startswith("error=") for k in (2, None, 3))


def test_op10_classes(spark, tables):
    d, docs, *_ = tables
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in queries.op10_near_duplicates(spark, d).collect()) == brute_classes(docs)


def test_op7_counts_and_base(spark, tables):
    d, docs, *_ = tables
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t, *_ in docs]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, *_ in docs]
    counts = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = counts.total(), len(counts)
    expect = Counter()
    for (i, *_), x, h in zip(docs, tokens, held):
        expect[i, h, len(x), sum(counts[w] > 0 for w in x), n, round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)] += 1
    got = queries.op7_mixing(spark, d).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expect
    assert all(r.score < 0 for r in got)
