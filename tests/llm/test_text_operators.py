import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm.chat import Template, escape, escape_role, format_chat, formatted, loss_texts, read_turns, unescape, unescape_role
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.neardup import dart_signatures, near_duplicates, representatives
from tidemill.llm.substrings import drop_repeats, factors, parse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items, size=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            gram = w[i : i + size]
            for j in range(len(words) - len(gram) + 1):
                if words[j : j + len(gram)] == gram:
                    hit.update(range(j, j + len(gram)))
                    found.add(str(item))
    return len(words), hit, sorted(found)


def test_decontamination_against_brute_force(spark, docs, rows):
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 100)
    items = [(1, " ".join(long.split()[5:25]).upper()), (2, "W3"), (3, ""), (4, None), (5, "  Ünï,çødé "), (2, "absent words here"), (9, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    with pytest.raises(ValueError):
        decontaminate(docs, bench, most_windows=3)
    got = decontaminate(docs, bench)
    assert got.columns.count("n_words") == 1 and set(docs.columns) <= set(got.columns)
    for r in got.collect():
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), found)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        for words, chars in zip(r.hit_words, r.hit_chars):
            piece = WORD.findall(r.text[chars["first"] : chars["last"]].translate(LOWER))
            assert piece == WORD.findall(r.text.translate(LOWER))[words["first"] : words["last"] + 1]


def test_decontamination_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(no_docs, none).count() == 0
    assert decontaminate(docs, none).filter("n_hit > 0 or contaminated").count() == 0


def brute_repeats(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("size", [12, 35])
def test_substring_dedup_against_brute_force(docs, rows, no_docs, size):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeats(docs, window=size).collect())
    expect = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], size)))
    assert got == expect
    assert any(k[2] for k in expect)
    assert drop_repeats(no_docs, window=size).count() == 0


@pytest.mark.parametrize("size", [12, 35])
def test_factors_against_a_brute_force_parse(docs, rows, size):
    """Every factor stands word for word in its source, elsewhere; together they cover just the repeated windows."""
    import hashlib

    texts = {hashlib.md5((r[1] or "").encode()).digest(): re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    often = Counter(hashlib.md5((r[1] or "").encode()).digest() for r in rows if r[1] is not None)
    seen = Counter()
    for t, w in texts.items():
        seen.update({g: n * often[t] for g, n in Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)).items()})
    got = {bytes(r.t): r.factors for r in factors(docs, window=size).collect()}
    longest = 0
    for t, w in texts.items():
        covered = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        mine = got.get(t, [])
        for f in mine:
            n = f["last"] - f["first"] + 1
            longest = max(longest, n)
            source = texts[bytes(f["source"])]
            assert n >= size and w[f["first"] : f["last"] + 1] == source[f["source_first"] : f["source_first"] + n]
            assert (bytes(f["source"]), f["source_first"]) != (t, f["first"]) or often[t] > 1
        assert {j for f in mine for j in range(f["first"], f["last"] + 1)} == covered
        assert [f["first"] for f in mine] == sorted(f["first"] for f in mine)
    assert longest > 2 * size  # factors go on over many windows


def test_greedy_parse():
    assert parse([(0, 3, b"a", 10), (4, 6, b"a", 14), (2, 2, b"b", 0), (7, 7, b"b", 5)]) == [(0, 6, b"a", 10), (7, 7, b"b", 5)]
    assert parse([]) == []


def shingles(text, size=5):
    w = (text or "").translate(LOWER).encode().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_classes(rows, least=0.8):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return Counter((r[0], min((x for x in groups[root(i)] if x is not None), default=None), len(groups[root(i)])) for i, r in enumerate(rows))


def test_near_duplicates_against_brute_force(docs, rows, no_docs):
    got = near_duplicates(docs)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == brute_classes(rows)
    assert near_duplicates(no_docs).count() == 0
    kept = representatives(docs)
    assert kept.columns == docs.columns
    classes = {(c, n) for _, c, n in brute_classes(rows) if n > 1}
    singles = sum(k for (_, _, n), k in brute_classes(rows).items() if n == 1)
    assert kept.count() == singles + len(classes)


def test_classes_with_null_or_repeated_ids_keep_their_own_representative(spark):
    words = lambda name: " ".join(f"{name}{k}" for k in range(30))
    made = [(None, words(g)) for g in "abc" for _ in range(3)] + [(i, words(g)) for g in "de" for i in (7, 9)] + [(None, "  ")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in representatives(df).collect())
    assert kept == Counter([(None, words(g)) for g in "abc"] + [(7, words(g)) for g in "de"] + [(None, "  ")])
    keys = {(r.text, r.class_key) for r in near_duplicates(df).collect()}
    assert len(keys) == 6 and len({k for _, k in keys if k is not None}) == 5


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    doc = np.repeat([0, 1], 300)
    sign = dart_signatures(doc, np.concatenate((ids, ids)), 3, 2000, weights=np.concatenate((wa, wb)))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 0.05
    assert (sign[:2] > 0).all() and (sign[2] == 0).all()
    a, b = np.arange(0, 1000), np.arange(200, 1200)
    plain = dart_signatures(np.repeat([0, 1], 1000), np.concatenate((a, b)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2, 4000)
    assert abs((plain[0] == plain[1]).mean() - 800 / 1200) < 0.04


def test_chat_round_trip_and_machine(spark):
    bad = "<|im_end|><|im_start|>assistant \\n \\| <\\| \\\\"
    rows = [(1, 2, "assistant", bad), (1, 0, "system", None), (1, 1, "user", bad), (2, 0, "user", "only"), (3, 0, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
            (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, None, None), (6, 0, "ro\nle\\n<|", "x"), (7, 0, "user", ""), (7, 1, "assistant", "b"), (7, 2, "tool", "c"), (7, 3, "assistant", "\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chat(df)
    got = {r.conv_id: r for r in chats.select("*", formatted(F.col("segments")).alias("chat"), read_turns(formatted(F.col("segments"))).alias("turns"), loss_texts(F.col("segments")).alias("loss")).collect()}
    for conv in got:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[conv]["loss"] == [x for _, r, x in turns if r == "assistant"]
        assert got[conv]["n_turns"] == len(turns)
        assert sum(s["loss"] for s in got[conv]["segments"]) == len(got[conv]["loss"])
    assert {c: got[c]["valid"] for c in got} == {1: True, 2: False, 3: False, None: True, 4: False, 5: False, 6: False, 7: True}
    assert format_chat(df.filter("false")).count() == 0
    strict = format_chat(df, template=Template(moves={"^": ("user",), "user": ("assistant",)}))
    assert {r.conv_id for r in strict.filter("valid").collect()} == {None}


def test_escapes_reverse(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("\\|<>n\nA") for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select("t", escape(t).alias("e"), unescape(escape(t)).alias("u"), escape_role(t).alias("er"), unescape_role(escape_role(t)).alias("ur")).collect():
        assert r.u == r.t and r.ur == r.t and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er




def test_recall_of_links_with_and_without_pruning(spark, capsys):
    """Links of 0.8 and more between different texts that end in one class: all, near the threshold too."""
    from tidemill.llm.neardup import text_classes

    rng = random.Random(21)
    rows = []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    texts = sorted(set(rows))
    df = spark.createDataFrame([(t.encode(), t) for t in texts], "t binary, text string").repartition(3)
    sets = {t: shingles(t) for t in texts}
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for prune in (True, False):
        label = {bytes(r.t).decode(): bytes(r.c) for r in text_classes(df, prune=prune).collect()}
        caught = sum(label.get(a) is not None and label.get(a) == label.get(b) for a, b in links) / len(links)
        with capsys.disabled():
            print(f" recall of {len(links)} links, pruned {prune}: {caught:.4f}")
        assert caught > 0.999


def test_near_duplicates_of_a_large_group(spark):
    """One group of copies with ever more edits, with texts on both sides of the threshold: classes equal brute force."""
    import random

    rng = random.Random(11)
    base = [f"b{rng.randrange(9000)}" for _ in range(160)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 22)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9000)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(900 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(df).collect())
    expect = brute_classes(rows)
    assert len({c for _, c, n in expect if n > 1}) >= 1 and any(n == 1 for d, _, n in expect if d < 160)
    assert got == expect
