"""Source divergence audit: how the words of each (lang, source) group differ from other sources and from its lang.

Counting is an Arrow compute pipeline inside ``mapInArrow``: texts are lowered, split by pattern, dictionary-encoded and
counted by hash group-by, batch by batch, and a task's partial counts are merged before they are shuffled. Spark adds the
partials up; terms that stand in enough documents of their lang are stored with the groups' totals. Terms are dealt to
shards by hash; a shard is a small columnar table of one lang, from which exact integer divergences are computed.
Shards add up to pairs, and each gives at most ``top`` candidates a group for its terms.

Nothing is broadcast or gathered on the driver but one row count. A shard holds about ``SHARD_ROWS`` counts, whatever the
corpus is, and one row a source of its lang. Values are exact: 64-bit integers, division in three steps of a thousand.

Defined results: null text, lang and source are ''. Each row is a document, whatever its id; repeated rows count each.
A lang without kept terms gives pairs of value 0 and no terms; a group alone in its lang gives no pairs. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables, slices

#: What stands between terms, once A-Z are lowered: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Partial counts that a task merges before it lets them go, counts a shard, and cells of a shard taken up at once.
MERGE_ROWS, SHARD_ROWS, CELLS = 400_000, 50_000, 1 << 21

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a batch; each group has a row without a term, too."""
    table = pa.table({c: batch.column(batch.schema.get_field_index(c)).cast(pa.string()) for c in ("lang", "source", "text")})
    row = pa.array(np.arange(len(table)), pa.int64())
    split = pc.split_pattern_regex(pc.ascii_lower(table["text"]), pattern=BETWEEN).combine_chunks()
    words = pa.table({"row": row.take(pc.list_parent_indices(split)), "term": pc.list_flatten(split)})
    words = words.filter(pc.not_equal(words["term"], ""))
    terms = words["term"].combine_chunks().dictionary_encode()
    each = pa.table({"row": words["row"], "code": terms.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    groups = table.select(["lang", "source"]).append_column("row", row)
    lang, source = (groups[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    told = pa.table({"lang": lang.indices.take(each["row"]), "source": source.indices.take(each["row"]), "code": each["code"], "n": each["count_all"]})
    told = told.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    made = [lang.dictionary.take(told["lang"]), source.dictionary.take(told["source"]), terms.dictionary.take(told["code"]), told["n_sum"], told["count_all"]]
    bare = groups.group_by(["lang", "source"]).aggregate([([], "count_all")])
    empty = [bare["lang"], bare["source"], pa.array([""] * len(bare)), pa.array(np.zeros(len(bare), np.int64)), bare["count_all"]]
    return pa.concat_tables([pa.table(columns, names=_COUNTS.names).cast(_COUNTS) for columns in (made, empty)])


def merge_counts(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return added.rename_columns(["lang", "source", "term", "n", "docs"] if added.column_names[0] == "lang" else ["n", "docs", "lang", "source", "term"]).select(_COUNTS.names)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in (b for whole in batches for b in slices(whole, "text")):
        held.append(count_batch(batch))
        rows += len(held[-1])
        if rows > MERGE_ROWS:
            held = [merge_counts(held)]
            rows = len(held[0])
            if rows > MERGE_ROWS // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, rows = [], 0
    if held:
        yield from merge_counts(held).to_batches(max_chunksize=50_000)


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for counts below 2^53: a long division by thousands."""
    below, out, left = total + 2 * kept, np.int64(0), count + 2
    for _ in range(3):
        whole, left = np.divmod(left * 1000, below)
        out = out * 1000 + whole
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shard_divergences(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A shard's part of each pair of sources (once a pair), and the best terms of each source among its own."""
    groups = groups.sort_by("source")
    sources, total = groups["source"].combine_chunks(), groups["total"].to_numpy()
    lang, kept, lang_total = (groups[c][0].as_py() for c in ("lang", "kept", "lang_total"))
    terms = counts["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, column, n = rank[terms.indices.to_numpy()], pc.index_in(counts["source"].combine_chunks(), sources).to_numpy(), counts["n"].to_numpy()
    by_term = np.argsort(at, kind="stable")
    at, column, n = at[by_term], column[by_term], n[by_term]
    pairs = np.zeros((len(sources), len(sources)), np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(sources))]
    step = max(1, CELLS // len(sources))
    for first in range(0, len(order), step):
        lo, hi = np.searchsorted(at, [first, first + step])
        cells = np.zeros((min(step, len(order) - first), len(sources)), np.int64)
        cells[at[lo:hi] - first, column[lo:hi]] = n[lo:hi]
        p, q = share(cells, total, kept), share(cells.sum(axis=1), np.int64(lang_total), kept)
        for g in range(len(sources) - 1):
            pairs[g, g + 1 :] += distance(p[:, g : g + 1], p[:, g + 1 :]).sum(axis=0)
        for g in range(len(sources)):
            rows = np.flatnonzero((cells[:, g] > 0) & (p[:, g] > q))
            value = np.concatenate((best[g][0], distance(p[rows, g], q[rows])))
            place = np.concatenate((best[g][1], rows + first))
            first_ones = np.lexsort((place, -value))[:top]
            best[g] = value[first_ones], place[first_ones]
    a, b = np.triu_indices(len(sources), 1)
    mine = np.repeat(np.arange(len(sources)), [len(v) for v, _ in best])
    names = terms.dictionary.take(pa.array(order)).take(pa.array(np.concatenate([r for _, r in best]), pa.int64()))
    source = pa.concat_arrays([sources.take(pa.array(a)), sources.take(pa.array(mine))])
    item = pa.concat_arrays([sources.take(pa.array(b)), names])
    value = np.concatenate((pairs[a, b], *[v for v, _ in best]))
    part = np.concatenate((np.full(len(a), "pair"), np.full(len(mine), "term")))
    return pa.table([pa.array([lang] * len(part)), source, pa.array(part.tolist(), pa.string()), item, pa.array(value)], names=_PARTS.names).cast(_PARTS)


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other of its lang (``pair``), and the terms that
    it has more of than its lang (``term``, the first ``top``). Terms stand in ``least_docs`` documents of the lang."""
    tables = Tables(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    counts = texts.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    known = counts.withColumn("all_docs", F.sum("docs").over(term)).withColumn("once", (F.min("source").over(term) == F.col("source")) & (F.col("term") != ""))
    known = tables.stored(known.filter((F.col("term") == "") | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "n", "once"), "kept-terms")
    shards = max(1, -(-known.count() // SHARD_ROWS))
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("once").cast("long")).alias("once"))
    whole = W.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("once").over(whole).alias("kept"), F.sum("total").over(whole).alias("lang_total"))
    groups = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = known.filter("term != ''").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    parts = dealt.groupBy("lang", "shard").cogroup(groups.groupBy("lang", "shard")).applyInArrow(lambda counts, groups: shard_divergences(counts, groups, top), "lang string, source string, part string, item string, value long")
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    there, back = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = parts.withColumn("way", F.explode(F.when(F.col("part") == "pair", F.array(there, back)).otherwise(F.array(there))))
    ranked = both.select("lang", "way.source", "part", "way.item", "value").withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
