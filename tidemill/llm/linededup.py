"""Line dedup in DataFrame functions alone: normalised lines are exploded and hashed, documents are counted for each
hash, lines over the threshold are dropped, and texts are put together again by position.

Lines leave their texts as 128-bit hashes with a position, so no text is shuffled but the once that a document meets the
positions it loses. Keys with most rows (``HOT`` at most, so their table can be broadcast) are answered where the lines
lie; any other key holds less than one in ``HOT`` of all rows and goes through a shuffled join.

Defined results: a null or empty text is one empty line. Documents are told apart by id: rows that repeat an id count
once, rows without an id count as one document that lies before all others. Where the largest id holds a key in several
lines or rows, all of these stay. Rows with equal id and text have equal results. A document that loses all lines has an
empty text. An empty table gives an empty result. Columns that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, without

#: Keys that are answered by broadcast: those with most rows.
HOT = 1000

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without space at its ends and with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _hashes(value: Column) -> list[Column]:
    """Two 64-bit hashes of a value, seeded apart."""
    return [F.xxhash64(value), F.xxhash64(F.lit(61), value)]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str, text: str, least_chars: int, least_docs: int, tables: Tables) -> DataFrame:
    """(id, t1, t2, gone): for each document that loses lines, told by its id and text hash, their sorted positions."""
    t1, t2 = _hashes(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(_lines(F.col(f"`{text}`"))).alias("pos", "line"))
    rows = rows.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    h1, h2 = _hashes(F.col("key"))
    lines = tables.stored(rows.select("id", "t1", "t2", h1.alias("h1"), h2.alias("h2"), "pos"), "lines")
    ids = F.count_distinct("id") + F.max(F.col("id").isNull().cast("long"))
    keys = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), ids.alias("ids"), F.max("id").alias("last")).filter(F.col("ids") >= least_docs)
    keys = tables.stored(keys, "line-keys")
    hot = F.broadcast(keys.orderBy(F.desc("n"), "h1", "h2").limit(HOT))
    told = lines.join(hot, ["h1", "h2"], "left")
    near = told.filter(F.col("n").isNotNull()).select("id", "t1", "t2", "pos", "last")
    far = told.filter(F.col("n").isNull()).select("id", "t1", "t2", "pos", "h1", "h2").join(keys, ["h1", "h2"]).select("id", "t1", "t2", "pos", "last")
    gone = near.unionByName(far).filter(F.col("id").isNull() | (F.col("id") < F.col("last")))
    return gone.groupBy("id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without the lines it loses.

    A line goes where its key has ``least_chars`` code points and stands in ``least_docs`` documents, unless the document
    is the one with the largest id that holds the key.
    """
    docs = without(docs, ["n_lines", "n_dropped", "kept"])
    tables = Tables(docs.sparkSession)
    made = repeated_lines(docs, id_col, text, least_chars, least_docs, tables)
    inner = list(tables.paths.values())
    gone = tables.stored(made, "lost-lines")
    tables.drop(*[t for t, _ in inner])
    t1, t2 = _hashes(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    mine = docs.withColumn("_t1", t1).withColumn("_t2", t2)
    on = mine[f"`{id_col}`"].eqNullSafe(gone["id"]) & (mine["_t1"] == gone["t1"]) & (mine["_t2"] == gone["t2"])
    joined = mine.join(gone.select("id", "t1", "t2", F.col("gone").alias("_gone")), on, "left")
    lines = _lines(F.col(f"`{text}`"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # What lies between two lost lines is one slice, so the work is linear in the lines.
    edges = F.zip_with(F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size("_lines"))), lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    out = joined.withColumn("_lines", lines)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(
        *names,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(F.flatten(edges), "\n")).alias("kept"),
    )
