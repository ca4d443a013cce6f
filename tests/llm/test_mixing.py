"""op7's stored units: joined with their answers part by part, so that the shuffle holds a part of both at a time."""

import random
from collections import Counter

from tidemill.llm import common, mixing


def test_units_meet_their_answers_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    made = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(120))), k % 3) for k in range(600)]
    rows = spark.createDataFrame(made, "doc_id long, text string, role int").repartition(4)
    monkeypatch.setattr(mixing, "UNIT_BYTES", 5_000)
    monkeypatch.setattr(mixing, "BUCKET_BYTES", 20_000)
    parts, whole = [], common.Tables.stored

    def stored(self, df, name):
        if name == "answered":
            parts.extend(part.select("unit").collect() for part in (df if isinstance(df, list) else [df]))
        return whole(self, df, name)

    monkeypatch.setattr(common.Tables, "stored", stored)
    _, units, buckets = mixing.train(rows, "bigint", vocabulary=50)
    got = units.collect()
    assert buckets > 4 and len(got) > 40
    assert len(parts) > 1 and max(map(len, parts)) < 0.7 * len(got)
    assert Counter(r.unit for part in parts for r in part) == Counter(r.unit for r in got) and len({r.unit for r in got}) == len(got)
    texts = Counter((d, t.decode()) for r in got for d, t in zip(r.doc_id, mixing.unit_texts(r.sizes, r.text)))
    assert texts == Counter((d, t) for d, t, _ in made)
    for r in got:
        asked = mixing.ask(mixing.Tokens(mixing.unit_texts(r.sizes, r.text)), r.role < 2, buckets)
        assert [a.bucket for a in r.answers] == asked.column(0).to_pylist()


def test_counts_of_slots_are_whole_in_either_size():
    for counts in ([0, 255, 3, 0], [0, 256, 2_000_000_000, 1]):
        packed = mixing._packed_counts(mixing.np.array(counts, "i4"))
        assert mixing._unpacked_counts(packed, 4).tolist() == counts
