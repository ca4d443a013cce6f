from collections import defaultdict

import corpus_pipeline
from tidemill.llm.decontaminate import words_of

from .test_text_operators import brute_classes, brute_hits, brute_repeats


def test_stages_against_brute_force(spark, rows, tmp_path):
    import __spark_entry__

    d = str(tmp_path)
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 100)
    docs = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in rows]
    docs += [(1000 + k, f"a grobnik word {k} grobnik", "en", "s", 20) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    item = " ".join(rows[15][1].split()[:14])
    spark.createDataFrame([(1, item), (2, long[:40])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(r[0], 0, 0) for r in rows if r[0] is not None] + [(1000 + k, 0, 1) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    at = spark.read.parquet(f"{d}/documents.parquet")
    columns, got = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, d)
        out.write.parquet(f"{d}/{name}")
        at = spark.read.parquet(f"{d}/{name}")
        got[name] = at
        assert name == "packing" or at.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]

    rows_of = lambda name: [tuple(r) for r in got[name].collect()]
    assert sorted(map(str, rows_of("toxicity"))) == sorted(str(r) for r in docs if "grobnik" not in (r[1] or ""))
    before = rows_of("toxicity")
    groups = defaultdict(list)
    for (doc, cls, n), k in brute_classes(before).items():
        groups[(cls if n > 1 else doc, n)] += [doc] * k
    assert len(rows_of("near_duplicates")) == sum(len(v) if n == 1 else 1 for (_, n), v in groups.items())
    before = rows_of("near_duplicates")
    cut = brute_repeats([r[1] for r in before], 35)
    expect = sorted(str((r[0], kept if gone else r[1])) for r, (n, gone, kept) in zip(before, cut) if not gone or gone < n)
    assert sorted(str((r[0], r[1])) for r in rows_of("substring_dedup")) == expect
    before = rows_of("substring_dedup")
    items = [(1, item), (2, long[:40])]
    clean = []
    for r in before:
        n, hit, _ = brute_hits(r[1], items)
        if not (hit and 20 * len(hit) >= n):
            clean.append(str(r))
    assert sorted(map(str, rows_of("decontamination"))) == sorted(clean) and len(clean) < len(before)
    tokens = got["packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in tokens} == {r[0] for r in rows_of("decontamination")}
    assert "pipeline" in __spark_entry__.queries()
    assert words_of(None) == []


def test_run_over_small_and_empty_tables(spark, rows, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    made = {"documents": [(i, t, a, s, n) for i, t, a, s, n, *_ in rows], "labels": [(i, 1, int(i % 6 == 0)) for i in range(30)], "benchmark": [(1, "a b c")]}
    for name, some in (("full", made), ("empty", {k: [] for k in kinds}), ("unlabelled", made | {"labels": [], "benchmark": []})):
        for table, kind in kinds.items():
            spark.createDataFrame(some[table], kind).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(out) > 20) == (name != "empty")
        if name == "unlabelled":  # nothing toxic or contaminated: every text but copies and repeats is packed
            assert {r.doc_id for r in out} >= {i for i, t, *_ in rows if t and i is not None and i < 9}
