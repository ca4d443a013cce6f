"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Texts are folded on their UTF-8 bytes (A-Z lowered, every ASCII byte that is no letter or digit made a
separator) and cut into words. The items' windows are made and freed of repeats by Spark; the automaton's symbols are
words, numbered over the benchmark alone, so it reads each text once, a step a word. Matches come as word ranges and
are mapped to code-point offsets of the original text.

Memory: about 170 bytes a word of a distinct window (2.2 kB a window of 13 words) in each worker, whatever the size of
the documents. A benchmark of more than ``most_windows`` windows is refused before anything is gathered.

Defined results: a null or wordless text has no words, no hits and is clean. An item without words matches
nothing. Items with the same id count once, whatever their number of texts. Repeated documents are judged row by
row. Columns that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, held, slices, utf8

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
FOLD = bytes(c if c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))

RANGE = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", RANGE),
    T.StructField("hit_chars", RANGE),
    T.StructField("contaminated", T.BooleanType()),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` words; a shorter item is one window."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" ".join(words[i : i + size])


def window_table(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(window, items): distinct windows as words joined by one space, with the sorted ids of their items."""
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, "t")):
            ids, made = [], []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch, "t")):
                mine = set(windows(words_of(raw), size))
                ids += [item] * len(mine)
                made += mine
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(ids, pa.string())], names=["window", "item"])

    return rows.mapInArrow(run, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Machine:
    """The automaton over the benchmark's words. A word is three letters, of which only the first can begin a match, so
    that no state has many ways out; words that the benchmark lacks are three letters that no pattern has."""

    def __init__(self, found: list[tuple[bytes, tuple[str, ...]]]):
        words = sorted({w for window, _ in found for w in window.split(b" ")})
        base = 1
        while base**3 < len(words):
            base += 1
        self.codes = {w: chr(0x4000 + i // base**2) + chr(0x100 + i // base % base) + chr(0x100 + i % base) for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for window, ids in found:
            key = window.split(b" ")
            self.automaton.add_word("".join(map(self.codes.__getitem__, key)), (len(key), ids))
        if found:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, last word, items) of each occurrence of a window."""
        if self.codes:
            told, other = self.codes.get, "   "
            for end, (n, ids) in self.automaton.iter("".join([told(w, other) for w in words])):
                yield end // 3 - n + 1, end // 3, ids


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _char_ranges(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [first, last) code-point offsets of the original text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in ranges]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share: float = 0.05,
    most_windows: int = 250_000,
) -> DataFrame:
    """``docs`` with its hits: words, hit words, items found, hit ranges in words and characters, verdict.

    A document is contaminated if it has a hit and at least ``share`` of its words are hit.
    """
    least = round(1 / share)
    table = window_table(items, item_id, item_text, window)
    rows = table.limit(most_windows + 1).collect()
    if len(rows) > most_windows:
        raise ValueError(f"the benchmark has more than {most_windows} distinct windows: one automaton would not fit")
    shared, key = docs.sparkSession.sparkContext.broadcast([(bytes(r["window"]), tuple(r["items"])) for r in rows]), uuid.uuid4().hex

    def run(batch):
        machine = held(("decontaminate", key), lambda: Machine(shared.value))
        cols: list[list] = [[] for _ in FIELDS]
        for raw in utf8(batch, text):
            words = words_of(raw)
            found: set[str] = set()
            ranges: list[tuple[int, int]] = []
            for first, last, ids in machine.matches(words) if words else ():
                ranges.append((first, last))
                found.update(ids)
            ranges = _merged(ranges)
            hit = sum(b - a + 1 for a, b in ranges)
            pair = lambda rs: [{"first": a, "last": b} for a, b in rs]
            row = (len(words), hit, sorted(found), pair(ranges), pair(_char_ranges(raw, ranges)) if ranges else [], hit > 0 and least * hit >= len(words))
            for col, value in zip(cols, row):
                col.append(value)
        return cols

    return add_columns(docs, FIELDS, run, by=text)
