"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

Every window of ``window`` words has an anchor: the smallest hash among its 8-word runs. Equal windows have equal
anchors, so the reference block of an anchor, the runs of windows that share it (units), holds all that a window with
this anchor can match. The index keeps each unit once, with how often it occurs and where first and last.

Parsing: a unit that stands in the index more than once matches its source whole. Units that match only in part are
the factors' boundaries: they, and one occurrence of each unit of the block, are compared window by window. The matches
of a document, each with its source, are then joined greedily: a factor goes on as long as its source does. All factors
are at least ``window`` words long and become duplicate spans, so a word goes if and only if a window that covers it
starts anywhere else too. Units and windows are compared by 64-bit hashes within one anchor's block, anchors by
theirs; a false match would need both to be equal.

Equal texts have equal verdicts, so verdicts are kept by the text's digest, not by row. Hot passages, sources or
copies are counted with partial aggregation and joined on one row a key.

Defined results: null and wordless texts have no words; a text shorter than the window keeps all words; repeated
rows count as occurrences; an empty table gives an empty result. Kept words are joined by one space. Columns that the
operator adds replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, add_columns, slices, stored, utf8, without
from .words import Words, mix, runs

GRAM = 8


def text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def _units(words: Words, window: int):
    """Per unit: (document in the batch, first window in the document, windows, anchor hash, content hash).

    Also the hash of each window and the starts of the documents' words.
    """
    n = len(words.hashes) - window + 1
    if n <= 0:
        return None
    reach = window - GRAM + 1
    grams = runs(words.hashes, GRAM)
    best, span = np.arange(len(grams)), 1
    while span * 2 <= reach:
        a, b = best[:-span], best[span:]
        best = np.where(grams[a] <= grams[b], a, b)
        span *= 2
    a, b = best[:n], best[reach - span : reach - span + n]
    anchor = np.where(grams[a] <= grams[b], a, b)
    doc = words.doc_of()
    valid = doc[:n] == doc[window - 1 :]
    content = runs(words.hashes, window)
    starts = np.flatnonzero(valid)
    if not len(starts):
        return None
    fresh = np.concatenate(([True], (anchor[starts[1:]] != anchor[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])))
    first = np.flatnonzero(fresh)
    counts = np.diff(np.concatenate((first, [len(starts)])))
    order = (np.arange(len(starts)) - np.repeat(first, counts)).astype(np.uint64)
    whole = np.add.reduceat(mix(content[starts] + order * np.uint64(0xD1B54A32D192ED03)), first) + counts.astype(np.uint64)
    lo = starts[first]
    return doc[lo], lo - words.bounds[doc[lo]], counts, grams[anchor[lo]], mix(whole), content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(texts: DataFrame, window: int, whole: bool) -> DataFrame:
    """Rows of units: anchor alone, or with the text's key, place and content."""

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, "text")):
            found = _units(Words(utf8(batch, "text")), window)
            if found is None:
                continue
            doc, lo, n, anchor, unit, _ = found
            if whole:
                keys = batch.column(batch.schema.get_field_index("t")).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(unit), keys.cast(pa.binary()), pa.array(lo, pa.int32()), pa.array(n, pa.int32())], names=["g", "u", "t", "lo", "n"])
            else:
                yield pa.RecordBatch.from_arrays([_signed(anchor)], names=["g"])

    return texts.mapInArrow(run, "g long, u long, t binary, lo int, n int" if whole else "g long")


#: A reference block may have many units; joins on its anchor are dealt over so many tasks.
SALTS = 8


def parse(matches: list[tuple]) -> list[tuple]:
    """Factors (first window, last window, source text, first window there) from a document's matches (the same columns).

    From left to right the factor that reaches furthest is taken, and goes on while the next window's source is the
    next window of its source; a match that lies within it adds nothing.
    """
    out: list[tuple] = []
    for lo, hi, source, at in sorted(matches, key=lambda m: (m[0], -m[1])):
        if out:
            first, last, same, there = out[-1]
            if source == same and at - lo == there - first and lo <= last + 1:
                out[-1] = (first, max(last, hi), same, there)
                continue
            if hi <= last:
                continue
        out.append((lo, hi, source, at))
    return out


def factors(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """Rows (t, factors): for each text digest its factors (first and last word, source text's digest, first word there)."""
    made = Tables(docs.sparkSession)
    texts = docs.select(text_key(text).alias("t"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    # Stored keys, not bare aggregates, are what units join: only then can skewed anchors be split.
    shared = made.stored(_anchors(texts.select("text"), window, False).groupBy("g").count().filter("count > 1").select("g"), "anchors")
    units = made.stored(_anchors(texts, window, True).join(shared, "g"), "units")
    made.drop(shared)
    place = F.struct("t", "lo", "n")
    blocks = made.stored(units.groupBy("g", "u").agg(F.count("*").alias("c"), F.min(place).alias("at"), F.max(place).alias("last")), "blocks")
    source = F.when((F.col("at.t") == F.col("t")) & (F.col("at.lo") == F.col("lo")), F.col("last")).otherwise(F.col("at"))
    whole = units.join(blocks.filter("c > 1").select("g", "u", "at", "last"), ["g", "u"]).select("t", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"), source.alias("s"))
    whole = whole.select("t", "lo", "hi", F.col("s.t").alias("st"), F.col("s.lo").alias("sl"))
    # Boundaries: units found once, in blocks that hold other units; with one occurrence of each unit of the block.
    salt = F.pmod(F.col("u"), F.lit(SALTS)).cast("int").alias("salt")
    open_blocks = blocks.groupBy("g").agg(F.min("c").alias("least"), F.count("*").alias("k")).filter("least = 1 and k > 1").select("g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = blocks.select("*", salt).join(open_blocks, ["g", "salt"]).select("g", "c", F.col("at.t").alias("t"), F.col("at.lo").alias("lo"), F.col("at.n").alias("n"))
    per_text = asked.groupBy("t").agg(F.collect_list(F.struct("g", "lo", "n", "c")).alias("asked"))
    near = texts.join(per_text, "t")

    def windows(batches):
        for batch in (b for many in batches for b in slices(many, "text")):
            words = Words(utf8(batch, "text"))
            content = runs(words.hashes, window)
            lists = batch.column(batch.schema.get_field_index("asked"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            g, lo, n, c = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            unit = np.repeat(np.arange(len(g)), n)
            at = lo[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
            keys = batch.column(batch.schema.get_field_index("t")).take(pa.array(row[unit])).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(g[unit]), pa.array(content[words.bounds[row[unit]] + at].view(np.int64)), keys, pa.array(at.astype(np.int32)), pa.array(c[unit] > 1)], names=["g", "w", "t", "at", "many"])

    found = made.stored(near.mapInArrow(windows, "g long, w long, t binary, at int, many boolean"), "boundaries")
    spot = F.struct("t", "at")
    again = made.stored(found.groupBy("g", "w").agg(F.max("many").alias("m"), F.min(spot).alias("a"), F.max(spot).alias("b")).filter("m or a < b"), "again")
    there = F.when((F.col("a.t") == F.col("t")) & (F.col("a.at") == F.col("at")), F.col("b")).otherwise(F.col("a"))
    edges = found.filter("not many").join(again, ["g", "w"]).select("t", F.col("at").alias("lo"), F.col("at").alias("hi"), there.alias("s"))
    edges = edges.select("t", "lo", "hi", F.col("s.t").alias("st"), F.col("s.at").alias("sl"))
    matches = whole.unionByName(edges).groupBy("t").agg(F.collect_set(F.struct("lo", "hi", "st", "sl")).alias("matches"))

    def parsed(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sources = flat.field(2).cast(pa.binary()).dictionary_encode()  # numbers compare faster than digests
            columns = [flat.field(0).to_numpy(), flat.field(1).to_numpy(), sources.indices.to_numpy(), flat.field(3).to_numpy()]
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
            rows = list(zip(*(c.tolist() for c in columns)))
            made = [parse(rows[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            found = np.array([f for m in made for f in m], np.int64).reshape(-1, 4)
            parts = [pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1] + window - 1, pa.int32()), sources.dictionary.take(pa.array(found[:, 2])), pa.array(found[:, 3], pa.int32())]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in made]))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(FACTORS)))], names=["t", "factors"])

    out = stored(matches.mapInArrow(parsed, "t binary, factors array<struct<first: int, last: int, source: binary, source_first: int>>"), "factors")
    made.drop()
    return out


FACTORS = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("source", pa.binary()), ("source_first", pa.int32())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]


def drop_repeats(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the text without words of repeated windows)."""
    spans = factors(docs, text, window).select("t", F.transform("factors", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("spans"))
    df = without(docs, ["_t", "_spans"])
    joined = df.withColumn("_t", text_key(text)).join(spans.select(F.col("t").alias("_t"), F.col("spans").alias("_spans")), "_t", "left")

    def cut(batch):
        cols = [[], [], []]
        for raw, spans in zip(utf8(batch, text), batch.column(batch.schema.get_field_index("_spans")).to_pylist()):
            words = raw.split() if raw else []
            kept, at = [], 0
            for s in spans or ():
                kept += words[at : s["first"]]
                at = max(at, s["last"] + 1)
            kept = (kept + words[at:]) if spans else words
            for col, v in zip(cols, (len(words), len(words) - len(kept), b" ".join(kept).decode())):
                col.append(v)
        return cols

    return add_columns(joined, FIELDS, cut, keep=df.columns, by=text)
