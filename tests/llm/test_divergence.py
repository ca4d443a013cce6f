import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemill.llm import divergence, queries
from tidemill.llm.divergence import count_batch, divergences, merge_counts, partial_counts, shard_divergences, share

from .test_text_operators import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergences(docs, least_docs=10, top=10):
    """All rows (lang, source, part, item, value, rank) with Python's integers."""
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holders[lang].update(set(terms))
    kept = {lang: sorted((t for t, n in h.items() if n >= least_docs), key=str.encode) for lang, h in holders.items()}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    shares, out = {}, []
    for lang in {g[0] for g in groups}:
        members = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in members), Counter())
        for key, c in [((lang, s), counts[lang, s]) for s in members] + [(lang, whole)]:
            n = sum(c[t] for t in kept.get(lang, ()))
            shares[key] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept[lang])) for t in kept.get(lang, ())}
    for lang, source in groups:
        mine, whole = shares[lang, source], shares[lang]
        pairs = [(sum(f(mine[t], shares[lang, other][t]) for t in mine), other) for x, other in groups if x == lang and other != source]
        terms = [(f(p, whole[t]), t) for t, p in mine.items() if counts[lang, source][t] and p > whole[t]]
        for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return Counter(out)


def group_rows():
    rng = random.Random(4)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["Ünï", "ünï", "中文", "ﬀ", "Zz"]
    docs = []
    for k in range(220):
        source = f"s{rng.randrange(5)}"
        docs.append((" ".join(rng.choice(words[: rng.randrange(3, 31)]) for _ in range(rng.randrange(40))), rng.choice(["en", "de"]), "hot" if k % 3 == 0 else source))
    docs += [("rare words only", "fr", "a"), ("other ones", "fr", "b"), (None, "fr", "c"), ("alone", "it", "x"), (None, None, None), ("", "", "y"), ("of a null lang", None, "y")]
    return docs + [("equal texts, equal values " * 5, "en", s) for s in ("t1", "t2") for _ in range(12)] + [(None, "en", "silent"), ("1 2 3 --", "de", "silent")]


def test_op12_against_brute_force(spark, tmp_path):
    docs = group_rows()
    spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_source_divergence(spark, str(tmp_path))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    expect = brute_divergences(docs)
    assert Counter(map(tuple, got.collect())) == expect
    assert {k[:2] for k in expect} >= {("fr", "c"), ("en", "silent"), ("", "y")} and any(k[4] == 0 for k in expect)


def test_many_shards_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
    docs = group_rows()
    made = spark.createDataFrame([(*d, "x", 1) for d in docs], "body string, tongue string, origin string, term string, n long")
    assert Counter(map(tuple, divergences(made, "tongue", "origin", "body", least_docs=3, top=4).collect())) == brute_divergences(docs, 3, 4)
    assert divergences(made.limit(0), "tongue", "origin", "body").count() == 0


def test_shares_are_exact_and_blocks_add_up(monkeypatch):
    rng = random.Random(9)
    for _ in range(2000):
        total = rng.randrange(1, 1 << rng.randrange(1, 52))
        count, kept = rng.randrange(total + 1), rng.randrange(1, 1 << 20)
        assert share(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)
    counts = pa.table({"lang": ["x"] * 600, "source": [f"s{k % 4}" for k in range(600)], "term": [f"t{k // 4}" for k in range(600)], "n": [rng.randrange(9) for _ in range(600)]})
    groups = pa.table({"lang": ["x"] * 4, "source": ["s2", "s0", "s1", "s3"], "total": [600] * 4, "kept": [150] * 4, "lang_total": [2400] * 4})
    whole = shard_divergences(counts, groups, 10)
    monkeypatch.setattr(divergence, "CELLS", 9)
    assert shard_divergences(counts, groups, 10) == whole


def test_partial_counts_merge(monkeypatch):
    docs = group_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([d[k] or "" for d in docs]) for k in range(3)], names=["text", "lang", "source"])
    expect = sorted(map(tuple, (r.values() for r in count_batch(batch).to_pylist())))
    halves = merge_counts([count_batch(batch.slice(0, 100)), count_batch(batch.slice(100))])
    assert sorted(map(tuple, (r.values() for r in halves.to_pylist()))) == expect
    monkeypatch.setattr(divergence, "MERGE_ROWS", 5)
    parts = [pa.Table.from_batches([b]) for b in partial_counts(iter([batch.slice(k, 9) for k in range(0, len(docs), 9)]))]
    assert len(parts) > 5 and sorted(map(tuple, (r.values() for r in merge_counts(parts).to_pylist()))) == expect
    assert list(partial_counts(iter([batch.slice(0, 0)]))) == []
