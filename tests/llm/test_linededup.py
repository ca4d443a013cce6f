import re
from collections import Counter, defaultdict

from tidemill.llm.linededup import drop_repeated_lines

from .test_text_operators import LOWER


def brute_lines(rows, least_chars=20, least_docs=3):
    """(id, lines, dropped, kept) a row, by the rule's words."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(set)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= least_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, lines in split:
        gone = [len(h := holders.get(key(x), ())) >= least_docs and max(h) != (-1 if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def line_rows():
    often, other = "This line stands in many documents", "another line, long enough to count ÜÄ"
    rows = [(i, f"own text of document {i} here\n \t{often.upper() if i % 2 else often}\r\nshort\n{'short' * (i % 3)}") for i in range(40)]
    rows += [(50 + i, f"{other}\n\n{other}\n tail {i}\n") for i in range(3)]
    rows += [(60, "only in two documents, so kept"), (61, "only in two documents, so kept"), (70, None), (71, ""), (72, "\n"), (73, "\n\n\n"), (74, often)]
    rows += [(80, "repeated row, the same id each time")] * 3 + [(81, "repeated row, the same id each time"), (None, often), (None, "null ids are one document, before others"), (None, "null ids are one document, before others")]
    rows += [(82, "null ids are one document, before others"), (83, "null ids are one document, before others"), (90, " exactly twenty chars"), (91, " exactly twenty chars"), (92, " EXACTLY TWENTY CHARS "), (93, "İ" * 20), (94, "İ" * 20), (95, "i̇" * 20)]
    rows += [(96, "\n".join(f"line number {k % 700} of a very long text" for k in range(20_000))), (97, "\n".join(f"LINE number {k} of a very long text" for k in range(0, 700, 2))), (98, "line number 8 of a very long text\x0b")]
    return rows


def test_line_dedup_against_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], "doc_id long, text string, kept string, key string, n long").repartition(5)
    got = drop_repeated_lines(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(brute_lines(rows))
    assert {r.key for r in got} == {"clash"}
    assert sum(r.n_dropped > 0 for r in got) > 40
    got = drop_repeated_lines(docs, least_chars=5, least_docs=2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(brute_lines(rows, 5, 2))


def test_line_dedup_with_few_broadcast_keys(spark, monkeypatch):
    monkeypatch.setattr("tidemill.llm.linededup.HOT", 1)
    rows = line_rows()
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(brute_lines(rows))


def test_line_dedup_of_an_empty_table_stays_in_the_jvm(spark, no_docs, docs):
    assert drop_repeated_lines(no_docs).count() == 0
    plan = drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op13_query(spark, tmp_path):
    import hashlib

    from tidemill.llm import queries

    rows = line_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expect = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_lines(rows))
    assert Counter(map(tuple, queries.op13_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == expect
