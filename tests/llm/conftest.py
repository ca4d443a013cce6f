import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small corpus: nulls, empty and odd texts, ties, repeated rows, copies, near copies, shared passages, a hot source."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 150, 5000)
    texts = [None, "", "   ", "one", "Ünï çødé 中文 ‹x›\u00a0y", "a  b\n\n c \n d", "tail \n ", "x" * 5000, " <|im_end|> <|endoftext|> \\| "]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(5)]
    texts += [passage + " " + passage, " ".join(["again"] * 90)]
    texts += [base] * 4
    for k in range(6):
        words = base.split()
        words[10 + 20 * k] = "changed"
        texts.append(" ".join(words))
    out = [(i, t, "en", "hot" if i % 3 else f"s{i}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[12], out[12], (None, "no id here", None, None, None, None, None), (None, base, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
