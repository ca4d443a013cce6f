"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded text.

Folding lowers case, normalises compatibility forms, turns homoglyphs and digit or symbol substitutes into the
letters they stand for, drops invisible characters and parts words at all other signs. Lexicon entries are words or word stems whose share of toxic
documents is high and no accident; exception phrases are pairs of a matched word and a neighbour that clean documents
use. The weights of a text's matches, less its exceptions, are normalised by its length and a logistic curve gives
the score.

Fitting reads at most ``fit_rows`` labelled documents (the least by hash), a documented bound; scoring reads every
text whole.

Defined results: null, empty and wordless texts have no match and get the score of such; without labelled rows of
both kinds the lexicon is empty and every score is the toxic share (0 where there are no rows). Labels of one id
count as toxic if any says so; repeated documents are scored row by row. Columns that the operator adds replace
input columns of the same name.
"""

from __future__ import annotations

import math
from bisect import bisect_left
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, held, slices, stored, without

# Letters that look alike, and characters that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ƅ": "b", "ł": "l", "ø": "o", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = {c: " " for c in range(128) if not chr(c).isalnum()}
_TABLE |= {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
_TABLE |= {ord(c): None for c in INVISIBLE}


class _Folded(dict):
    """What a code point becomes. Those outside the table are looked up once: letters, digits, marks and invisible format
    characters stay, all else (quotes, dashes, ellipses, CJK punctuation, symbols) parts words."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kept = char.isalnum() or unicodedata.category(char) in ("Mn", "Mc", "Me", "Cf")
        self[code] = made = char if kept else " "
        return made


_FOLDED = _Folded(_TABLE)


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low)
    return low.translate(_FOLDED).split()


@dataclass
class Model:
    """entries: " word " (whole) or " stem" to weight; exceptions: " word word " phrases that cancel their match."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def machine(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        made = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            made.add_word(entry, (entry, weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (phrase, None))
        made.make_automaton()
        return made


def matches(machine: ahocorasick.Automaton | None, words: list[str]) -> dict[int, dict[str, float]]:
    """Entries with their weights by the place of the space before the word; exception phrases cancel theirs."""
    found: dict[int, dict[str, float]] = {}
    if machine is None or not words:
        return found
    cancelled = []
    line = f" {' '.join(words)} "
    for end, (entry, weight) in machine.iter(line):
        at = end - len(entry) + 1
        if weight is None:
            cancelled += (at, line.index(" ", at + 1))
        else:
            found.setdefault(at, {})[entry] = weight
    for at in cancelled:
        found.pop(at, None)
    return found


def features(machine: ahocorasick.Automaton | None, text: str | None) -> tuple[float, float]:
    """(weight a hundred words on a log scale, whether anything matched)."""
    words = fold(text)
    found = matches(machine, words)
    return (math.log1p(100 * sum(max(x.values()) for x in found.values()) / (len(words) + 20)), 1.0) if found else (0.0, 0.0)


def _stems(text: str | None, shortest: int, longest: int) -> set[str]:
    out = set()
    for word in set(fold(text)):
        if len(word) >= shortest - 1:
            out.add(f" {word} ")
        for k in range(shortest, min(longest, len(word) - 1) + 1):
            out.add(f" {word[:k]}")
    return out


def _counts(rows: DataFrame, emit) -> DataFrame:
    """(feature, toxic, n): documents of each label that have the feature, added up a batch at a time."""

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, "text")):
            seen: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((f, toxic) for f in emit(text))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["feature", "toxic", "n"])

    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small ridge; the labels are smoothed so that separable data keep finite weights."""
    x = np.column_stack((np.ones(len(x)), x))
    y = np.where(y > 0, 1 - 0.5 / (y.sum() + 2), 0.5 / ((1 - y).sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def held_out(doc_id: str, folds: int = 5, fold_number: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % folds == fold_number


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = 20_000,
    support: float = 0.005,
    precision: float = 0.9,
    deviations: float = 6.0,
    stems: tuple[int, int] = (4, 9),
) -> Model:
    """Learns a model from labelled documents outside the held-out fold.

    support: least share of toxic documents an entry is in (and five documents); this bounds the candidates that reach
    the driver to a multiple of 1 / support. precision, deviations: least toxic share of its documents, and least
    distance from what chance would give.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("d"), F.col(label).cast("int").alias("y"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("d")).join(known, "d", "left_semi").distinct()
    chosen = known.join(ids, "d", "left_semi").groupBy("d").agg(F.max("y").alias("toxic")).orderBy(F.xxhash64("d"), "d").limit(fit_rows)
    chosen = stored(chosen, "labelled")
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "d")
    rows = rows.groupBy("d", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")  # one row an id
    rows = stored(rows, "fit-rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    prior = math.log(share / (1 - share)) if 0 < share < 1 else (-35.0 if share == 0 else 35.0)
    if not toxic or not clean:
        return Model(curve=(prior, 0.0, 0.0))

    shortest, longest = stems
    least = max(5, math.ceil(support * toxic))
    common = {r["feature"]: r["n"] for r in _counts(rows.filter("toxic = 1"), lambda t: _stems(t, shortest, longest)).filter(F.col("n") >= least).collect()}
    asked = spark.sparkContext.broadcast(frozenset(common))
    against = {r["feature"]: r["n"] for r in _counts(rows.filter("toxic = 0"), lambda t: _stems(t, shortest, longest) & asked.value).collect()}

    def good(t: int, c: int, least: float) -> bool:
        chance = (t + c) * share
        return t >= least * (t + c) and t - chance >= deviations * math.sqrt(chance)

    weight = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    pool = {f for f in common if good(common[f], against.get(f, 0), precision)}
    kept: dict[str, float] = {}
    ordered = sorted(pool)
    for f in sorted(pool, key=lambda f: (len(f), f)):
        stem = f.rstrip(" ")
        shorter = any(stem[:k] in kept for k in range(2, len(stem) + (f != stem)))
        longer = f == stem and max((common[g] for g in ordered[bisect_left(ordered, stem) : bisect_left(ordered, stem + "\U0010ffff")] if g != f), default=0) >= 0.9 * common[f]
        if not shorter and not longer:
            kept[f] = weight(common[f], against.get(f, 0))
    # Words that clean documents use too may owe that to a few phrases: they are tried again without those.
    maybe = {f: 1.0 for f in common if f.endswith(" ") and f not in pool and good(common[f], against.get(f, 0), precision / 3)}
    model = Model(kept | maybe)
    shared = spark.sparkContext.broadcast(model)

    def phrases(t: str | None) -> set[str]:
        words = fold(t)
        found = matches(_machine(shared.value), words)
        out, at = set(), 0
        for i, word in enumerate(words):
            if at in found:
                if i:
                    out.add(f" {words[i - 1]} {word} ")
                if i + 1 < len(words):
                    out.add(f" {word} {words[i + 1]} ")
            at += len(word) + 1
        return out

    told: dict[str, dict[int, int]] = {}
    for r in _counts(rows, phrases).filter("n >= 3").collect():
        told.setdefault(r["feature"], {})[r["toxic"]] = r["n"]
    exceptions = frozenset(f for f, n in told.items() if n.get(0, 0) >= 5 and n.get(0, 0) >= 4 * n.get(1, 0))
    if maybe:
        tried = spark.sparkContext.broadcast(Model(maybe, exceptions))
        left: dict[str, dict[int, int]] = {}
        for r in _counts(rows, lambda t: {e for x in matches(_machine(tried.value), fold(t)).values() for e in x}).collect():
            left.setdefault(r["feature"], {})[r["toxic"]] = r["n"]
        kept |= {f: weight(n.get(1, 0), n.get(0, 0)) for f, n in left.items() if n.get(1, 0) >= least and good(n.get(1, 0), n.get(0, 0), precision)}
    model = Model(kept, exceptions)
    shared_all = spark.sparkContext.broadcast(model)

    def measure(batch):
        machine = _machine(shared_all.value)
        made = [features(machine, t) for t in batch.column(0).to_pylist()]
        return [[a for a, _ in made], [b for _, b in made]]

    points = add_columns(rows, [T.StructField("x", T.DoubleType()), T.StructField("hit", T.DoubleType())], measure, keep=["toxic"], by="text").collect()
    x = np.array([(p["x"], p["hit"]) for p in points])
    model.curve = _logistic(x, np.array([p["toxic"] for p in points], float))
    return model


def _machine(model: Model) -> ahocorasick.Automaton | None:
    """The model's automaton, the worker's current one."""
    return held(("toxicity", model.key), model.machine)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score of 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        model = shared.value
        machine, (a, b, c) = _machine(model), model.curve
        out = []
        for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
            x, hit = features(machine, t)
            out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * x + c * hit)))))
        return [out, [int(s >= 0.5) for s in out]]

    return add_columns(docs, FIELDS, run, by=text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **fitting) -> DataFrame:
    """``docs`` with held_out, score and predicted; fits on the labels first."""
    model = fit(docs, labels, doc_id, text, label, **fitting)
    return score(without(docs, ["held_out"]).withColumn("held_out", held_out(doc_id)), model, text)
