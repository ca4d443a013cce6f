"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

Signatures: every shingle throws darts at a plane of weight and rank, as many in each dyadic region as a Poisson law
says, all taken from hashes of the shingle and the region. Darts under the shingle's weight count; each has a rank
and a coordinate, and the earliest dart of a coordinate is its value. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity, at a cost of about K ln K darts a document.

Links: texts that share a band are candidates. Classes grow in rounds of checked pairs, exact Jaccard similarity on
shingle sets: each text with the leaders of its buckets, their most central texts (those in the fullest buckets); then,
in buckets that still hold several classes, each text with one text of another class, drawn by hash. What is left are
pairs of texts of different classes that share a bucket, and of those only the ones that can be links are taken: with
D(x) the shingles that stand in x or in the bucket's leader but not in both, x and y differ in D(x) xor D(y), so a
link in which neither text is linked to the leader through its class shares at least so many shingles of D(x) and D(y)
that one stands among the rarest few of both. Only texts that share one of those are compared, however large the group.
Pairs inside a class need no check, so groups of copies cost a few pairs a text.
Before sets are fetched, a pair's signatures must agree in so many coordinates that a link would fall short of it once
in 300,000 times. Equal texts meet in one node first.

Defined results: null and wordless texts are classes of their own, as are all rows without a partner; a text of
fewer words than a shingle is one shingle; repeated rows share a class; class ids are the least doc id of the class
(null if all are null), so they may repeat where ids do; class keys do not. Columns that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, slices, stored, utf8, without
from .substrings import text_key
from .words import Words, mix, runs

#: Rank regions: [0, UNIT), then doubling. UNIT is small enough that the longest texts fill few of them.
UNIT = 2.0**-14
REGIONS = 48


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a region of this area."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    k = np.arange(top)
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))))


def dart_signatures(doc: np.ndarray, items: np.ndarray, docs: int, coordinates: int, seed: int = 3, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (docs x coordinates, 0 for documents without items) of the item sets ``doc, items``.

    weights: of the items, 1 each by default; the weight axis has the dyadic strips (0, 1], (1, 2], (2, 4] and so on,
    and strips under 1 are reached by rejecting darts above the weight.
    """
    weights = np.ones(len(items)) if weights is None else weights
    total = np.bincount(doc, weights, docs)
    size = np.maximum(total, 1e-300)
    reach = np.where(total > 0, (coordinates * math.log(coordinates) + 2 * coordinates) / size, 0.0)
    sign = np.zeros((docs, coordinates), np.uint64)
    rank = np.full((docs, coordinates), np.inf)
    open_docs = total > 0
    strips = 1 + (max(0, math.ceil(math.log2(weights.max()))) if len(weights) else 0)
    salt = mix(np.array([seed], np.uint64))[0]
    for region in range(REGIONS):
        low, high = (0.0 if region == 0 else UNIT * 2.0 ** (region - 1)), UNIT * 2.0**region
        active = open_docs & ((reach > low) | (rank.max(axis=1) > low))
        if not active.any():
            break
        chosen = np.flatnonzero(active[doc])
        for strip in range(strips):
            foot, head = (0.0 if strip == 0 else 2.0 ** (strip - 1)), 2.0**strip
            pick = chosen if strip == 0 else chosen[weights[chosen] > foot]
            if not len(pick):
                continue
            base = mix(items[pick] ^ mix(salt + np.full(1, region * 64 + strip + 1, np.uint64)))
            table = _poisson_table((high - low) * (head - foot))
            darts = np.searchsorted(table, _uniform(base), side="right")
            at = np.repeat(np.arange(len(pick)), darts)
            if not len(at):
                continue
            number = (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
            one = mix(base[at] + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            height = foot + (head - foot) * _uniform(mix(one ^ np.uint64(0xA5A5A5A5)))
            kept = height <= weights[pick[at]]
            one, at = one[kept], at[kept]
            if not len(at):
                continue
            r = low + (high - low) * _uniform(mix(one ^ np.uint64(0x5A5A5A5A)))
            cell = doc[pick[at]] * coordinates + (mix(one ^ np.uint64(0x33CC33CC)) % np.uint64(coordinates)).astype(np.int64)
            order = np.lexsort((r, cell))
            first = order[np.concatenate(([True], cell[order[1:]] != cell[order[:-1]]))]
            better = r[first] < rank.ravel()[cell[first]]
            first = first[better]
            rank.ravel()[cell[first]] = r[first]
            sign.ravel()[cell[first]] = one[first] | np.uint64(1)
    return sign


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs of a batch, sorted."""
    grams = runs(words.hashes, size)
    doc = words.doc_of()
    n = len(grams)
    inside = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
    owner, value = doc[:n][inside], grams[inside]
    counts = np.diff(words.bounds)
    for d in np.flatnonzero((counts > 0) & (counts < size)):  # short texts: all words are one shingle
        whole = runs(words.hashes[words.bounds[d] : words.bounds[d + 1]], int(counts[d]))
        owner, value = np.append(owner, d), np.append(value, whole)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))) if len(owner) else np.zeros(0, bool)
    return owner[fresh], value[fresh]


def lowered(texts: list[bytes | None]) -> list[bytes | None]:
    return [t.lower() if t else t for t in texts]  # bytes: A-Z only


def least_matches(least: float, coordinates: int) -> int:
    """Coordinates in which the signatures of a link agree, but for 4.5 standard deviations."""
    return math.floor(coordinates * least - 4.5 * math.sqrt(coordinates * least * (1 - least)))


def _agree(x: Column, y: Column) -> Column:
    """Coordinates in which two signatures agree."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, e: n + e)


def _signed_texts(texts: DataFrame, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(t, bands, sig) of texts with words; sig holds two bytes a coordinate."""

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, "text")):
            raws = lowered(utf8(batch, "text"))
            doc, value = shingle_sets(Words(raws), size)
            sign = dart_signatures(doc, value, len(raws), bands * rows, seed)
            short = (mix(sign) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            sign = sign.reshape(len(raws), bands, rows)
            key = np.zeros((len(raws), bands), np.uint64)
            for r in range(rows):
                key = mix(key * np.uint64(31) + sign[:, :, r])
            key = mix(key + np.arange(bands, dtype=np.uint64))
            some = np.flatnonzero(np.bincount(doc, minlength=len(raws)) > 0)
            if len(some):
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * x.shape[1], pa.int32()), pa.array(x[some].ravel())) for x in (key.view(np.int64), short)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("t")).take(pa.array(some)).cast(pa.binary()), *lists], names=["t", "bands", "sig"])

    return texts.mapInArrow(run, "t binary, bands array<bigint>, sig array<smallint>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(t, set) with the shingle set as sorted 8-byte hashes."""

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, "text")):
            raws = lowered(utf8(batch, "text"))
            doc, value = shingle_sets(Words(raws), size)
            cuts = np.searchsorted(doc, np.arange(len(raws) + 1))
            sets = [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("t")).cast(pa.binary()), pa.array(sets, pa.binary())], names=["t", "set"])

    return texts.mapInArrow(run, "t binary, set binary")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``least``."""
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("set").alias("x")), "a")
    fits = F.least(F.length("x"), F.length("y")) >= least * F.greatest(F.length("x"), F.length("y")) - 1e-6
    both = both.join(sets.select(F.col("t").alias("b"), F.col("set").alias("y")), "b").filter(fits).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                joint = len(np.intersect1d(p, q, assume_unique=True))
                if joint >= least * (len(p) + len(q) - joint) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _merge(labels: DataFrame, links: DataFrame, made: Tables) -> DataFrame:
    """Labels (t, c) after joining the classes that ``links`` (a, b) connect: hooking to the least neighbour, then
    pointer jumping, until no link crosses classes."""
    mine = Tables(labels.sparkSession)
    of = lambda name: labels.select(F.col("t").alias(name), F.col("c").alias("c" + name))
    edges = mine.stored(links.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")).distinct(), "edges")
    mapped = None
    while not edges.isEmpty():
        parent = edges.groupBy("q").agg(F.min("p").alias("p"))  # each class hooks to its least neighbour: a forest
        while True:
            up = parent.select(F.col("q").alias("p"), F.col("p").alias("pp"))
            jumped = mine.stored(parent.join(up, "p", "left").select("q", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parents")
            parent = jumped.select("q", "p")
            if jumped.filter("moved").isEmpty():
                break
        move = parent.select(F.col("q").alias("c"), F.col("p").alias("to"))
        mapped = move if mapped is None else mine.stored(
            mapped.select("c", F.col("to").alias("m")).join(move.select(F.col("c").alias("m"), F.col("to").alias("n")), "m", "left").select("c", F.coalesce("n", "m").alias("to")).unionByName(move), "moves"
        )
        p, q = move.select(F.col("c").alias("p"), F.col("to").alias("np")), move.select(F.col("c").alias("q"), F.col("to").alias("nq"))
        moved = edges.join(p, "p", "left").join(q, "q", "left").select(F.coalesce("np", "p").alias("p"), F.coalesce("nq", "q").alias("q"))
        edges = mine.stored(moved.filter("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "edges")
    if mapped is None:
        out = labels
    else:
        out = made.stored(labels.join(mapped, "c", "left").select("t", F.coalesce("to", "c").alias("c")), "labels")
        made.drop(labels)
    mine.drop()
    return out


def _apart(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, t, c, n, d): size of the set of t, and the shingles in which it and the leader's set differ."""
    both = near.join(sets.select("t", F.col("set").alias("x")), "t")
    both = both.join(sets.select(F.col("t").alias("leader"), F.col("set").alias("y")), "leader").select("leader", "t", "c", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (3, 4))
            for k in range(0, len(x), 500):
                pairs = [(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) for p, q in zip(x[k : k + 500], y[k : k + 500])]
                d = [np.setxor1d(p, q, assume_unique=True).view(np.int64) for p, q in pairs]
                held = batch.slice(k, len(d))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(z) for z in d]))), pa.int32()), pa.array(np.concatenate(d)))
                yield pa.RecordBatch.from_arrays([*(c.cast(pa.binary()) for c in held.columns[:3]), pa.array([len(p) for p, _ in pairs], pa.int32()), lists], names=["leader", "t", "c", "n", "d"])

    return both.mapInArrow(run, "leader binary, t binary, c binary, n int, d array<bigint>")


def _possible(near: DataFrame, sets: DataFrame, least: float, made: Tables) -> DataFrame:
    """Pairs (a, b) of texts of different classes under one leader that can be links.

    x and y are linked if and only if |D(x) xor D(y)| <= k (|x| + |y|), k = (1 - least) / (1 + least). With the slack
    k |x| - |D(x)|, the leader's is the greatest, and two slacks that add up to no less than 0 belong to texts that are
    both linked to the leader; so texts of different classes share m shingles of D at least, minus half their slacks'
    sum. In a common order, the first they share then stands before the last m - 1 of both.
    """
    k = (1 - least) / (1 + least)
    apart = made.stored(_apart(near, sets), "apart")
    rows = apart.select("leader", "t", F.explode("d").alias("h"))
    often = made.stored(rows.groupBy("leader", "h").count().filter("count > 1"), "shared-shingles")
    shared = rows.join(often, ["leader", "h"]).groupBy("leader", "t").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("shared"))
    sized = apart.select("leader", "t", "c", F.size("d").alias("nd"), (k * F.col("n") - F.size("d")).alias("slack"))
    best = apart.groupBy("leader").agg(F.max(k * F.col("n") - F.size("d")).alias("best"))
    placed = shared.join(sized, ["leader", "t"]).join(best, "leader").select("leader", "t", "c", "nd", "slack", "best", F.size("shared").alias("ns"), F.posexplode("shared").alias("i", "e"))
    need = lambda total: F.greatest(F.lit(1), F.ceil(-total / 2 - 1e-6))
    at = (F.col("nd") - F.col("ns") + F.col("i")).alias("at")
    first = made.stored(placed.select("leader", "t", "c", "nd", "slack", "best", at, F.col("e.h").alias("h")).filter(F.col("at") <= F.col("nd") - need(F.col("slack") + F.col("best"))), "rare-shingles")
    x, y = first.alias("x"), first.alias("y")
    m = need(F.col("x.slack") + F.col("y.slack"))
    fits = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.t") < F.col("y.t")) & (F.col("x.c") != F.col("y.c"))
    fits &= (F.col("x.at") <= F.col("x.nd") - m) & (F.col("y.at") <= F.col("y.nd") - m)
    return x.join(y, fits).select(F.col("x.t").alias("a"), F.col("y.t").alias("b")).distinct()


def text_classes(texts: DataFrame, least: float = 0.8, size: int = 5, bands: int = 24, rows: int = 5, seed: int = 3, prune: bool = True) -> DataFrame:
    """Labels (t, c) of the texts (t, text) that share a band with another; c is the least key of the class.

    prune: whether a pair's signatures must agree to some extent before its sets are compared.
    """
    made = Tables(texts.sparkSession)
    signed = made.stored(_signed_texts(texts, size, bands, rows, seed).groupBy("t").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), "signatures")
    in_band = signed.select("t", F.explode("bands").alias("b"))
    crowded = made.stored(in_band.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    members = made.stored(in_band.join(crowded, "b"), "buckets")
    weight = members.groupBy("t").agg(F.sum("n").alias("w"))
    leaders = made.stored(members.select("t", "b").join(weight, "t").groupBy("b").agg(F.max_by("t", F.struct("w", "t")).alias("leader")), "leaders")
    led = members.select("t", "b").join(leaders, "b").filter("t <> leader")
    led = made.stored(led.select(F.least("t", "leader").alias("a"), F.greatest("t", "leader").alias("b")).distinct(), "led")
    labels = made.stored(members.select("t", F.col("t").alias("c")).distinct(), "labels")
    few = made.stored(signed.select("t", "sig").join(labels.select("t"), "t", "left_semi"), "signatures")
    made.drop(signed, crowded)
    # A merge join at every size: it copes with hot copies, and the plan does not change as labels outgrow a broadcast.
    sets = made.stored(_sets(texts.join(labels.select("t").hint("merge"), "t", "left_semi"), size).dropDuplicates(["t"]), "sets")
    enough = least_matches(least, bands * rows)

    def linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after these pairs are checked."""
        if prune:
            side = lambda name: few.select(F.col("t").alias(name), F.col("sig").alias("s" + name))
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(_agree(F.col("sa"), F.col("sb")) >= enough).select("a", "b")
        links = made.stored(_checked(pairs, sets, least), "links")
        labels = _merge(labels, links, made)
        made.drop(links)
        return labels

    def conflicts(labels: DataFrame) -> DataFrame:
        """Members (t, b, c) of buckets that hold several classes, with the least and the greatest of them."""
        here = members.select("t", "b").join(labels, "t")
        ends = made.stored(here.groupBy("b").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1"), "ends")
        return made.stored(here.join(ends, "b"), "conflicts")

    labels = linked(labels, led)
    made.drop(led)
    here = conflicts(labels)
    pick = made.stored(here.groupBy("b", "c").agg(F.min_by("t", F.xxhash64("t", "b")).alias("a")).withColumnRenamed("c", "o"), "picks")
    drawn = here.withColumn("o", F.when(F.col("c") == F.col("c0"), F.col("c1")).otherwise(F.col("c0"))).join(pick, ["b", "o"])
    labels = linked(labels, drawn.select(F.least("a", "t").alias("a"), F.greatest("a", "t").alias("b")).distinct())
    near = made.stored(conflicts(labels).join(leaders, "b").select("leader", "t", "c").distinct(), "near")
    labels = linked(labels, _possible(near, sets, least, made))
    made.drop(*(t for t, _ in list(made.paths.values()) if t is not labels))
    return labels


def _classed(docs: DataFrame, doc_id: str, text: str, least: float, size: int) -> DataFrame:
    """``docs`` with class_id, class_size, class_key and _first: whether a row has the class's least id and, of that, the
    least text digest (ids that are null come last)."""
    df = without(docs, ["_t", "_c", "_first", "class_id", "class_size", "class_key"])
    texts = df.select(text_key(text).alias("t"), F.col(f"`{text}`").alias("text"))
    labels = text_classes(texts, least, size).select(F.col("t").alias("_t"), F.col("c").alias("_c"))
    worded = F.coalesce(F.regexp_like(F.col(f"`{text}`"), F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(False))
    keyed = df.withColumn("_t", F.when(worded, text_key(text)))
    light = stored(keyed.select(F.col(f"`{doc_id}`").alias("d"), "_t").filter("_t is not null").join(labels, "_t", "left").select("d", "_t", F.coalesce("_c", "_t").alias("_c")), "members")
    lead = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "_t")).alias("lead")
    classes = light.groupBy("_c").agg(lead, F.count("*").alias("class_size"))
    named = light.groupBy("_t").agg(F.first("_c").alias("_c")).join(classes, "_c").select("_t", F.col("_c").alias("class_key"), "lead", "class_size")
    out = keyed.join(named, "_t", "left")
    return out.select(
        *[f"`{c}`" for c in df.columns],
        F.coalesce("lead.d", F.col(f"`{doc_id}`")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "class_key",
        (F.col(f"`{doc_id}`").eqNullSafe(F.col("lead.d")) & (F.col("_t") == F.col("lead._t"))).alias("_first"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with class_id (least doc id of the class), class_size and class_key.

    class_key: the least text digest of the class, null for wordless texts. It tells classes apart, which class_id does
    not where ids are null or repeated.
    """
    return _classed(docs, doc_id, text, least, size).drop("_first")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """One row of each class: the least doc id's, of those the least text digest's; all wordless rows stay."""
    out = _classed(docs, doc_id, text, least, size)
    alone = out.filter("class_size = 1")
    first = out.filter("class_size > 1 and _first").dropDuplicates(["class_key"])
    return alone.unionByName(first).drop("class_id", "class_size", "class_key", "_first")
