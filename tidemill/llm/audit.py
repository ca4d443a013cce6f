"""Filter interaction audit: what a chain of quality filters removes in every order, part by part.

One pass of a byte transducer (``transducer.py``) gives each whole text its counts; column conditions on them tell which
filters a document fails, and copies are told by the digest of the text. Documents are then counted by part and set of
failed filters. All orders of the filters are read off these counts, so their number never meets a document.

Shuffles carry an id, a digest and a few small values a document, never a text. Equal texts are counted together before
they meet, so a hot text is a few rows; rows without an id join no label and are dealt by their digest.

Defined results: a null text is empty, a null part is ''. A document fails the copy filter if an equal text has a smaller
id; a row without an id never does, nor makes others fail, and rows that repeat the smallest id are all firsts. A document
is good (toxic) if any label row of its id says so. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import add_columns, utf8
from .transducer import profile

COUNTS = [T.StructField(n, T.LongType()) for n in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")]

#: Failure conditions over the counts of a text; copies are the filter after these.
CONDITIONS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
}
COPIES = "E"


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with words, different words, capitals (A-Z), code points and symbols (``#$%&*|``) of each whole text."""
    return add_columns(docs, COUNTS, lambda batch: profile(utf8(batch, text)), keep=keep, by=text)


def failed_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], id_col: str, text: str, part: str) -> DataFrame:
    """(part, failed, n, good, toxic): documents by the bits of the filters that they fail; copies are the last bit."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), whole.alias("text"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    bits = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0)
    rows = text_counts(rows, keep=["id", "part", "digest"]).select("id", salt.alias("salt"), "part", "digest", bits.alias("failed"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    told = labels.select(F.col("doc_id").alias("id"), "quality", "toxic", F.lit(0).cast("long").alias("salt")).filter("id is not null").groupBy("id", "salt").agg(says("quality"), says("toxic"))
    rows = rows.join(told, ["id", "salt"], "left").na.fill(0, ["quality", "toxic"])
    about = ["digest", "part", "failed", "quality", "toxic"]
    # Rows of one id first, then of one text: the smallest id comes with its number of rows.
    ids = rows.groupBy("id", "salt", *about).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    texts = ids.groupBy(*about).agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(W.partitionBy("digest"))
    firsts = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("copies", F.col("known") - firsts)
    copy = 1 << len(conditions)
    each = F.explode(F.array(F.struct(F.col("failed"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("failed") + copy).alias("failed"), F.col("copies").alias("n"))))
    out = split.select("part", "quality", "toxic", each.alias("s")).select("part", F.col("s.failed").alias("failed"), F.col("s.n").alias("n"), "quality", "toxic").filter("n > 0")
    return out.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from documents counted by part and failed filters.

    kept, removed: documents after the step and those it takes. redundant: they fail its filter, an earlier one took
    them. unique_fails: they fail its filter alone. shapley: the filter's removals summed over all orders.
    """
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = [["".join(order), k + 1, bit[f], sum(bit[x] for x in order[:k])] for order in permutations(names) for k, f in enumerate(order)]
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "mine", "before"), s)) for s in steps])), "array<struct<filter_order:string,step:int,mine:int,before:int>>")
    rows = counted.select("*", F.explode(table).alias("o")).select("part", "failed", "n", "good", "toxic", "o.*")
    fails = F.col("failed").bitwiseAND(F.col("mine")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda rule, value="n": F.sum(F.when(rule, F.col(value)).otherwise(0)).cast("long")
    # A filter is the first of k failed ones in one of k orders.
    share = F.lit(factorial(len(names))) / F.greatest(F.bit_count("failed"), F.lit(1))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("mine")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, str] = CONDITIONS,
    copies: str = COPIES,
    id_col: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """The interactions of filters over whole ``docs``: those of ``conditions``, and ``copies`` for repeated texts.

    conditions: up to six one-letter names with SQL over the columns of ``text_counts`` (720 orders and their steps).
    labels: doc_id, quality, toxic.
    """
    if len(conditions) > 6:
        raise ValueError("more than seven filters have too many orders")
    return interactions(failed_filters(docs, labels, conditions, id_col, text, part), [*conditions, copies])
