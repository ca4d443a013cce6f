import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tidemill.llm import queries
from tidemill.llm.audit import audit, text_counts
from tidemill.llm.transducer import SpanTable, profile


def plain_counts(raw):
    s = (raw or b"").decode()
    words = re.findall(r"[^\x20\x09-\x0D]+", s)
    return len(words), len(set(words)), len(re.findall("[A-Z]", s)), len(s), len(re.findall(r"[#$%&*|]", s))


def odd_texts(rng):
    letters = ["a", "B", "é", "中", "😀", " ", "\n", "\t", "\x0b", "\x1c", "#", "|", "z", " ", "0", " "]
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))).encode() for _ in range(rng.randrange(1, 25))]
    long = [b"x" * 300, b"x" * 300 + b"y", b"y" * 8, b"y" * 9, b"y" * 17, b"w" * 256, b"w" * 257, b"a\0", b"a"]
    return [*texts, b" ".join(rng.choice(long) for _ in range(40)), b""]


@pytest.mark.parametrize("block", [1 << 20, 64, 7, 1])
def test_transducer_against_patterns(block):
    rng = random.Random(block)
    for _ in range(30):
        texts = odd_texts(rng)
        assert list(zip(*[a.tolist() for a in profile(texts, block)])) == [plain_counts(t) for t in texts]
    assert [a.tolist() for a in profile([])] == [[]] * 5


def test_transducer_of_a_very_long_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(90_000)}" for _ in range(400_000)).encode() + b" " + b"long" * 500_000
    assert [a.tolist()[0] for a in profile([text])] == list(plain_counts(text))


def test_spans_with_equal_hashes_are_told_apart():
    import numpy as np

    words = [b"one", b"two", b"one", b"three", b"two", b"a word of more than eight bytes", b"a word of more than eight bytez", b"one"]
    data = b" ".join(words) + b" " * 8
    size = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    table = SpanTable(data)
    group = np.array([0, 0, 0, 0, 0, 0, 0, 1])
    table.add(group[:3], start[:3], size[:3], np.zeros(3, np.uint64))
    table.add(group[3:], start[3:], size[3:], np.zeros(5, np.uint64))
    assert table.distinct(2).tolist() == [5, 1]


def brute_audit(docs, labels):
    """(part, order, step) to the seven counts, from the contract's words."""
    good, toxic = ({i for i, *says in labels if says[k] == 1 and i is not None} for k in (0, 1))
    fails = defaultdict(list)
    for i, t, lang in docs:
        words, distinct, capitals, points, symbols = plain_counts(t.encode() if t else b"")
        copy = any((x or "") == (t or "") and j is not None and i is not None and j < i for j, x, _ in docs)
        rules = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points, "D": symbols > 0, "E": copy}
        fails[lang or ""].append(({f for f, r in rules.items() if r}, i in good, i in toxic))
    out = {}
    for part, found in fails.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for f, _, _ in found:
                shapley[next((x for x in order if x in f), None)] += 1
        for order in permutations("ABCDE"):
            for k, mine in enumerate(order):
                gone = [(f, g, t) for f, g, t in found if mine in f and not f & set(order[:k])]
                out[part, "".join(order), k + 1] = (
                    sum(not f & set(order[: k + 1]) for f, *_ in found),
                    len(gone),
                    sum(mine in f and bool(f & set(order[:k])) for f, *_ in found),
                    sum(f == {mine} for f, *_ in found),
                    sum(g for _, g, _ in gone),
                    sum(t for *_, t in gone),
                    shapley[mine],
                )
    return out


def audit_rows():
    rng = random.Random(8)
    clean = [" ".join(f"w{k}x{j}" for j in range(110)) for k in range(6)]
    texts = [None, "", " ", "A", "Short $ text", " ".join(["again"] * 120), " ".join(["CAPS", "And", "more"] * 50), *clean, *clean[:3], clean[0], clean[0], " ".join(f"W{j} %" for j in range(120))]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(None, clean[0], "en"), (None, clean[5], "fr"), (None, clean[5], "fr"), (3, clean[4], "en"), (3, clean[4], "en"), (40, clean[4], "de"), (40, clean[4], "de"), (0, clean[1], "de")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(15)] + [(1, 0, 1), (2, 1, None), (None, 1, 1), (999, 1, 1), (40, None, 1)]
    return docs, labels


def test_op11_against_brute_force(spark, tmp_path):
    docs, labels = audit_rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in queries.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert got == brute_audit(docs, labels)


def test_audit_of_clashing_columns_and_empty_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(no_docs, labels).count() == 0
    got = text_counts(docs)
    assert got.columns.count("n_words") == 1 and {"score", "lang"} <= set(got.columns)
    for r in got.collect():
        assert (r.n_words, r.n_distinct, r.n_capitals, r.n_points, r.n_symbols) == plain_counts(r.text.encode() if r.text else b"")
    clashing = docs.withColumnsRenamed({"score": "digest", "source": "failed"}).withColumn("id", docs.doc_id)
    total = audit(clashing, labels).filter("step = 5 and filter_order = 'ABCDE'").selectExpr("sum(kept) as k", "sum(removed) as r").first()
    assert total.k + total.r <= docs.count()
    with pytest.raises(ValueError):
        audit(docs, labels, conditions={c: "n_words < 1" for c in "ABCDFGH"})
