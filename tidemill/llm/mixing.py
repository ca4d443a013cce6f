"""Language-model scores by online logistic context mixing.

A token is coded in binary decisions. First, where the last two words were met elsewhere in the training rows: does the
word follow that followed them most often? If not, the token is a path through a Huffman tree of the frequent words,
one decision a node; any other word is an escape, and then known by its count or, if it is new, spelled: eight decisions
a byte. Each decision has three predictors that give logits: for the first kind the counts of the hashed context itself
and how often such contexts held (by their counts and by the matches before); for a tree node its own frequency and
counts of hashed contexts (node with the last very frequent word, which tells the language, and with the last word); for
a byte the last one, two and three bytes. The logits are mixed with weights that a gate selects by how well the contexts
are known; in each document the weights follow it online, block by block, from the trained ones. An adaptive map then
refines the mixed probability. The costs of all decisions add up to the total bits.

What is gathered grows with the training rows: the counts of all words and of all two-word contexts stand in buckets,
whose number follows the bytes of text, and are asked for by units of about a megabyte of text, keys and answers packed
by bucket; a bucket is the work of one task. The tables of the tree's and the bytes' contexts are sized by the training
tokens up to 2^22 slots and broadcast, as is the tree of at most ``vocabulary`` words.

No text is scored by what it taught itself: training rows are dealt into two halves by their text's hash, each is coded
with the tables of the other half, and from word and two-word counts a document's own are taken off. The mixer is
trained on all training rows in this way. Base scores use all counts, as defined.

Defined results: null and empty texts have the end token alone; without training rows every word is unknown, the
base is log10(0.5 / 0.5) a token and the model is untrained; equal texts have equal results; repeated rows repeat.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, slices, utf8
from .words import Words, mix

END = np.uint64(0x1E57E9D)
GATES, INPUTS, BINS, FINE = 16, 3, 33, 4096
GUIDES = 100
UNIT_BYTES = 1_000_000
BUCKET_BYTES = 12_000_000
FLAGS = 1024
PART_TOKENS = 16384
CHUNK = 1 << 14
LIMIT = 12.0
#: Parts in which units meet their answers: no more of both is in shuffle files at a time.
JOINS = 2
#: Bytes of text that a task counts at least, as it sends whole tables, unless the cluster has cores to spare.
COUNTED_BYTES = 64_000_000
LOG10_2 = math.log10(2.0)


def fold_of(doc_id: str, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % folds


class Tokens:
    """Word hashes of texts with the end token after each text, the two-word context of each token, and where the words'
    bytes are."""

    def __init__(self, texts: list[bytes]):
        self.words = Words([t.lower() for t in texts])
        n = len(texts)
        counts = np.diff(self.words.bounds) + 1
        self.bounds = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(n), counts)
        ends = self.bounds[1:] - 1
        is_end = np.zeros(self.bounds[-1], bool)
        is_end[ends] = True
        self.hashes = np.empty(self.bounds[-1], np.uint64)
        self.hashes[ends] = END
        self.hashes[~is_end] = self.words.hashes
        self.word_at = np.full(self.bounds[-1], -1)
        self.word_at[~is_end] = np.arange(len(self.words.hashes))
        self.last = self._before(self.hashes)
        self.context = mix(self.last * np.uint64(0x9E3779B97F4A7C15) + self._before(self.last) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))

    def _before(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate((np.zeros(1, np.uint64), x[:-1]))
        out[self.bounds[:-1]] = 0
        return out


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of symbols: (starts, nodes, bits, logit of each node's frequency of ones)."""
    n = len(counts)
    if n == 1:
        counts, n = np.append(counts, 1), 2
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    weight = np.zeros(2 * n - 1)
    weight[:n] = counts
    parent, side = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.uint8)
    ones = np.zeros(n - 1)
    for k in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = k
        side[j] = 1
        weight[k], ones[k - n] = a + b, b
        heapq.heappush(heap, (a + b, k))
    at, steps = np.arange(n), []
    while (parent[at] >= 0).any():
        up = parent[at]
        steps.append((np.where(up >= 0, up - n, -1), side[at]))
        at = np.where(up >= 0, up, at)
    nodes, bits = np.stack([s[0] for s in steps], 1), np.stack([s[1] for s in steps], 1)
    held = nodes >= 0
    starts = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
    share = np.clip(ones / np.maximum(weight[n:], 1), 1e-6, 1 - 1e-6)
    return starts, nodes[held].astype(np.int32), bits[held], np.log(share / (1 - share)).astype(np.float32)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes: their order is that of the hashes' upper halves."""
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _context_keys(tokens: Tokens, buckets: int) -> np.ndarray:
    """Bucket and lower half of each token's context: what tells contexts apart."""
    return _buckets(tokens.context, buckets) << np.uint64(32) | tokens.context & np.uint64(0xFFFFFFFF)


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of the stretches of ``data`` between cuts."""
    offsets = (np.asarray(cuts, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ask(tokens: Tokens, training: bool, buckets: int) -> pa.RecordBatch:
    """A row a bucket: its words of a unit with their counts, and its pairs of context and next word with theirs.

    Rows that aren't training rows ask for words and contexts, but bring no counts.
    """
    words, n = np.unique(tokens.hashes, return_counts=True)
    word_cuts = np.searchsorted(_buckets(words, buckets), np.arange(buckets + 1, dtype=np.uint64))
    kinds, kind = np.unique(_context_keys(tokens, buckets), return_inverse=True)
    if training:
        after = tokens.hashes & NEXT
        pairs, m = np.unique(kind.astype(np.uint64) << np.uint64(24) | after, return_counts=True)
        keys, after = kinds[(pairs >> np.uint64(24)).astype(np.int64)], pairs & NEXT
    else:
        keys = kinds
        after, m, n = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros_like(n)
    cuts = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    arrays = [pa.array(np.arange(buckets, dtype=np.int32)), _binaries(words, word_cuts), _binaries(n.astype("<i4"), word_cuts)]
    arrays += [_binaries((keys & np.uint64(0xFFFFFFFF)).astype("<u4"), cuts), _binaries(np.ascontiguousarray(after.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).view("V3").ravel(), cuts), _binaries(np.minimum(m, MANY).astype(np.uint8), cuts)]
    large = m >= MANY  # a byte holds most counts; what these have beyond it follows in a column of its own
    arrays.append(_binaries((m[large] - MANY).astype("<i8"), np.concatenate(([0], np.cumsum(large)))[cuts]))
    made = pa.RecordBatch.from_arrays(arrays, names=["bucket", "words", "n", "keys", "after", "m", "more"])
    return made.filter(pa.array((np.diff(word_cuts) > 0) | (np.diff(cuts) > 0)))


def _joined(columns: list[pa.Array], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of binary columns one after another, row of each value)."""
    size = np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64) // np.dtype(kind).itemsize
    data = []
    for c in columns:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        data.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(c) and c.buffers()[2] is not None else np.zeros(0, np.uint8))
    return np.concatenate(data).view(kind), np.repeat(np.arange(len(size)), size)


def answer(rows: list[pa.RecordBatch], top: int) -> pa.RecordBatch:
    """For all rows of one bucket: counts of their words; best next word, its count and the total of their contexts.

    A last row with unit -1 tells of the bucket: number of words with counts, of words seen once, and the ``top`` ones.
    """
    columns = [[b.column(k).cast(pa.binary()) for b in rows] for k in range(2, 8)]
    (words, row), (n, _) = _joined(columns[0], "<u8"), _joined(columns[1], "<i4")
    kinds, back = np.unique(words, return_inverse=True)
    totals = np.bincount(back, n, len(kinds)).astype(np.int64)
    units = np.concatenate([b.column(0).to_numpy() for b in rows])
    word_cuts = np.searchsorted(row, np.arange(len(units) + 1))
    (keys, row), (low, _), (m, _), (more, _) = (_joined(c, k) for c, k in zip(columns[2:], ("<u4", "u1", "u1", "<i8")))
    m = m.astype(np.int64)
    m[m == MANY] += more
    after = np.pad(low.reshape(-1, 3), ((0, 0), (0, 1))).view("<u4").ravel()
    own = m > 0  # asked by a training unit
    pair = keys.astype(np.uint64) << np.uint64(32) | after
    order = np.argsort(pair)
    pair, m = pair[order], m[order]
    context = np.empty(len(pair), np.int64)  # of each asked pair, by order of the keys
    context[order] = np.cumsum(np.concatenate(([0], pair[1:] >> np.uint64(32) != pair[:-1] >> np.uint64(32))))[: len(pair)]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    m = np.add.reduceat(m, first) if len(first) else m
    key, then = pair[first] >> np.uint64(32), pair[first] & NEXT
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(m, first) if len(first) else m
    most = np.maximum.reduceat(m << 24 | (NEXT - then).astype(np.int64), first) if len(first) else m  # of equal counts, the least hash
    best, then = most >> 24, NEXT.astype(np.int64) - (most & int(NEXT))  # counts up to 2^39 fit
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else np.zeros(0, bool)
    at = context[fresh]
    cuts = np.searchsorted(row[fresh], np.arange(len(units) + 1))
    known = kinds[totals > 0], totals[totals > 0]
    often = np.argsort(-known[1], kind="stable")[:top]
    about = [np.array([len(known[0]), (known[1] == 1).sum(), known[1].sum()], "<i8"), known[0][often], known[1][often].astype("<i8"), np.zeros(0, "<u2")]
    bucket = rows[0].column(1)[0].as_py()
    n = totals[back]
    n = n.astype("<u4") if n.max(initial=0) < 1 << 32 else n.astype("<u8")
    told = (total[at] > 0) & ((total[at] > 1) | ~own[fresh])  # what was seen once tells nothing to the text that has it
    at = at[told]
    counted = np.concatenate(([0], np.cumsum(told)))[cuts]
    then, best, total = then[at].astype("<u4"), best[at], total[at]
    made = []
    for a, b, c, d, e, f in zip(word_cuts[:-1], word_cuts[1:], cuts[:-1], cuts[1:], counted[:-1], counted[1:]):
        kind = "<u2" if total[e:f].max(initial=0) < 1 << 16 else "<i8"  # counts are never cut: an own text's are taken off them
        heads = then[e:f].tobytes() + best[e:f].astype(kind).tobytes() + total[e:f].astype(kind).tobytes()
        made.append(HEAD.pack(n.itemsize, b - a, d - c, f - e, np.dtype(kind).itemsize) + n[a:b].tobytes() + np.packbits(told[c:d]).tobytes() + heads)
    arrays = [pa.array(np.append(units, -1)), pa.array(np.full(len(units) + 1, bucket, np.int32)), pa.array([*made, _packed(*about)], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["unit", "bucket", "packed"])


ANSWER = "unit long, bucket int, packed binary"
#: Next words are told apart by so many bits of their hash.
NEXT = np.uint64(0xFFFFFF)
PACKED, HEAD = struct.Struct("<4I"), struct.Struct("<5I")
#: A unit's counts of a pair from here on take more than their byte.
MANY = 255


def _packed(*parts: np.ndarray) -> bytes:
    """What a bucket tells of itself: four arrays with their bytes in front."""
    return PACKED.pack(*(x.nbytes for x in parts)) + b"".join([x.tobytes() for x in parts])


def told_by_buckets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words, of words seen once and of tokens; the most frequent words; their counts) of all buckets."""
    held: list[list[bytes]] = [[], [], [], []]
    for value in values:
        at = PACKED.size
        for part, size in zip(held, PACKED.unpack_from(value)):
            part.append(value[at : at + size])
            at += size
    sizes, words, n = (np.frombuffer(b"".join(part), kind) for part, kind in zip(held, ("<i8", "<u8", "<i8")))
    return sizes.reshape(-1, 3).sum(axis=0), words, n


def _unpacked(values: list[bytes]) -> list[np.ndarray]:
    """Counts of a unit's words, and next word, its count and the total of its contexts (0 where nothing is known), from
    the answers of its buckets in order."""
    counts, heads = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(3)]
    for value in values:
        width, words, contexts, told, size = HEAD.unpack_from(value)
        at = HEAD.size
        counts.append(np.frombuffer(value, f"<u{width}", words, at).astype(np.int64))
        at += words * width
        where = np.unpackbits(np.frombuffer(value, np.uint8, -(-contexts // 8), at), count=contexts).astype(bool)
        at += -(-contexts // 8)
        for head, kind in zip(heads, ("<u4", f"<u{size}", f"<u{size}")):
            whole = np.zeros(contexts, np.int64)
            whole[where] = np.frombuffer(value, kind, told, at)
            at += told * np.dtype(kind).itemsize
            head.append(whole)
    return [np.concatenate(counts), *(np.concatenate(h) for h in heads)]


@dataclass
class Model:
    slot_bits: int  # of each context table
    train_tokens: int
    distinct: int
    hashes: np.ndarray  # words of the tree, sorted
    paths: tuple  # of huffman(); the escape is the last symbol
    frequent: np.ndarray  # of the tree's words, the escape and the start: the most frequent, which guide a context
    rest: int = 0  # training tokens behind the escape, and words seen once
    once: int = 0
    tables: dict = field(default_factory=dict)  # role to tables: logits (int8) and confidence of each slot, side by side
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.4, 0.4, 0.4], np.float32), (GATES, 1)))
    refine: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-LIMIT, LIMIT, BINS, dtype=np.float32), (GATES, 1)))
    costs: np.ndarray | None = None  # bits by gate, mixed logit (FINE steps) and bit
    steps: np.ndarray | None = None  # of the paths: node and bit in one number

    def __post_init__(self):
        """Refined probabilities: half the mixed logit, half the adaptive map's between its bins."""
        self.steps = self.paths[1] << 1 | self.paths[2]
        mixed = np.linspace(-LIMIT, LIMIT, FINE)
        mapped = np.stack([np.interp(mixed, np.linspace(-LIMIT, LIMIT, BINS), row) for row in self.refine])
        final = 0.5 * mixed + 0.5 * mapped
        self.costs = (np.stack((np.logaddexp(0, final), np.logaddexp(0, -final)), axis=-1) / math.log(2)).astype(np.float32).ravel()

    @property
    def sizes(self) -> list[int]:
        """Slots of the tables: first decisions, tree with guide, tree with last word, three orders of bytes."""
        return [FLAGS, *[1 << self.slot_bits] * 2, *[1 << max(8, self.slot_bits - 1)] * 3]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the tree; the escape for others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))


def _logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Sixteenths of logits (int8), and 0 to 3 by how well a context is known: two rows, whose pairs lie together."""
    total = zeros + ones
    share = (ones + 0.4) / (total + 0.8)
    made = np.empty((len(total), 2), np.int8)
    made[:, 0] = np.clip(np.rint(16 * np.log(share / (1 - share))), -127, 127)
    made[:, 1] = (total > 0).astype(np.int8) + (total > 3) + (total > 30)
    return made.T


def _looked_up(table: np.ndarray, slot: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Puts the logits of slots into ``logit``; returns how well their contexts are known."""
    pair = np.take(table.T.view("<i2").ravel(), slot, mode="clip")
    np.multiply(pair << 8 >> 8, np.float32(1 / 16), out=logit)
    return pair >> 8


@dataclass
class Coding:
    """Some texts of a unit as the model codes them: first decisions, tree decisions, words behind the escape.

    Tokens are numbered over the unit.
    """

    tokens: Tokens
    first: int  # the first text, and how many
    docs: int
    counts: np.ndarray  # of each token, with its own text's
    flag_at: np.ndarray  # tokens that have a first decision
    flag_bit: np.ndarray
    flag_logit: np.ndarray
    flag_slot: list[np.ndarray]
    flag_gate: np.ndarray
    token: np.ndarray  # of each tree decision
    bit: np.ndarray
    node: np.ndarray
    slot: list[np.ndarray]
    rare: np.ndarray  # tokens behind the escape, and their counts elsewhere
    seen: np.ndarray


def _own(doc: np.ndarray, what: np.ndarray, kinds: int, hit: np.ndarray | None = None):
    """How often a text has each of its (text, what), and how often with a hit. what: from 0 to below ``kinds``."""
    both = doc * kinds + what
    order = np.argsort(both)
    group = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))[: len(order)]
    back = np.empty(len(order), np.int64)
    back[order] = group
    n = np.bincount(group)
    return n[back], (np.bincount(back, hit, len(n))[back].astype(np.int64) if hit is not None else None)


def code(model: Model, tokens: Tokens, training: bool, answers: list[dict], buckets: int, most: int = PART_TOKENS) -> Iterator[Coding]:
    """The unit's texts in parts of about ``most`` tokens, whose decisions stay in a processor's cache.

    answers: the unit's answers by bucket.
    """
    joined = _unpacked([a["packed"] for a in answers])
    words, word = np.unique(tokens.hashes, return_inverse=True)
    counts = joined[0][word]
    keys = _context_keys(tokens, buckets)
    kinds, kind = np.unique(keys, return_inverse=True)
    then, best, total = (x[kind] for x in joined[1:])
    hit = (tokens.hashes & NEXT).astype(np.int64) == then
    symbols, escape = model.symbols(words)[word], len(model.hashes)
    elsewhere = counts
    if training:
        at = np.flatnonzero(best)
        n, mine = _own(tokens.doc[at], kind[at], len(kinds), hit[at])
        best[at] -= mine
        total[at] -= n
        at = np.flatnonzero(symbols == escape)
        elsewhere = np.zeros(len(counts), np.int64)  # of tokens behind the escape
        elsewhere[at] = counts[at] - _own(tokens.doc[at], word[at], len(words))[0]
    told = best > 0
    # Matches in a row before a token, and what came of the prediction before it.
    held = hit & told
    place = np.arange(len(hit))
    broken = np.maximum.accumulate(np.where(~held, place, -1))
    broken = np.maximum(broken, tokens.bounds[tokens.doc] - 1)
    run = np.concatenate(([0], (place - broken)[:-1]))
    run[tokens.bounds[:-1]] = 0
    before = np.concatenate(([0], np.where(told, 1 + held, 0)[:-1]))
    before[tokens.bounds[:-1]] = 0
    flag_at = np.flatnonzero(told)
    b, t, r = best[flag_at], np.maximum(total[flag_at], best[flag_at]), np.minimum(run[flag_at], 15)
    level = lambda x: np.minimum(np.log2(x + 1).astype(np.int64), 7)
    flag_slot = [(level(b) * 8 + level(t - b)) * 3 + before[flag_at], 256 + r * 16 + np.minimum(t, 15)]
    share = (b + 0.4) / (t + 0.8)
    flag_gate = (12 + (r > 0) + (r > 7) + (r > 14)).astype(np.uint8)
    flag_bit, flag_logit = hit[flag_at].astype(np.uint8), np.log(share / (1 - share)).astype(np.float32)

    starts = model.paths[0]
    place = np.concatenate(([escape + 1], symbols[:-1]))
    place[tokens.bounds[:-1]] = escape + 1
    mark = np.where(model.frequent[place] | (place == escape + 1), np.arange(len(place)), 0)
    guide = tokens.last[np.maximum.accumulate(mark)]
    shift = np.uint64(64 - model.slot_bits)
    depth = np.diff(starts)
    first, docs = 0, len(tokens.bounds) - 1
    while first < docs:
        last = max(first + 1, int(np.searchsorted(tokens.bounds, tokens.bounds[first] + most, side="right")) - 1)
        low, high = int(tokens.bounds[first]), int(tokens.bounds[last])
        coded = low + np.flatnonzero(~held[low:high])
        s = symbols[coded]
        lengths = depth[s]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[s] - (ends - lengths), lengths)
        step = np.take(model.steps, at, mode="clip")
        node = step >> 1
        salt = (node + 1).astype(np.uint64)
        salt *= np.uint64(0x9E3779B97F4A7C15)
        slot = []
        for x in (guide, tokens.last):
            h = np.repeat(mix(x[coded]), lengths)
            h ^= salt
            h *= np.uint64(0xD6E8FEB86659FD93)
            h >>= shift
            slot.append(h.view(np.int64))
        rare = coded[s == escape]
        f = slice(*np.searchsorted(flag_at, (low, high)))
        yield Coding(tokens, first, last - first, counts[low:high], flag_at[f], flag_bit[f], flag_logit[f], [x[f] for x in flag_slot], flag_gate[f], np.repeat(coded, lengths), (step & 1).astype(np.uint8), node, slot, rare, elsewhere[rare])
        first = last


def spelled(model: Model, coding: Coding) -> tuple[np.ndarray, np.ndarray]:
    """(distinct new words of the unit, as a token place of each; for each rare token its number there, or -1)."""
    fresh = np.flatnonzero((coding.seen <= 0) & (coding.tokens.word_at[coding.rare] >= 0))
    _, first, back = np.unique(coding.tokens.hashes[coding.rare[fresh]], return_index=True, return_inverse=True)
    number = np.full(len(coding.rare), -1)
    number[fresh] = back
    return coding.rare[fresh[first]], number


#: Salts of a byte's decisions: the bits before each, with a one in front.
PARTIAL = (np.uint64(1) << np.arange(8, dtype=np.uint64) | np.arange(256, dtype=np.uint64)[:, None] >> (np.uint64(8) - np.arange(8, dtype=np.uint64))) * np.uint64(0x9E3779B97F4A7C15)


def byte_decisions(model: Model, tokens: Tokens, places: np.ndarray):
    """(index into places, bit, slots of three contexts) of the words at these token places."""
    w = tokens.word_at[places]
    start, end = tokens.words.starts[w], tokens.words.ends[w]
    size = end - start + 1
    word = np.repeat(np.arange(len(places)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    raw = np.frombuffer(tokens.words.data, np.uint8)
    value = np.where(at < size[word] - 1, raw[start[word] + at], 0x20).astype(np.uint64)

    def back(k: int) -> np.ndarray:
        return np.where(at >= k, np.concatenate((np.zeros(k, np.uint64), value[:-k] if len(value) > k else value[:0]))[: len(value)], 0).astype(np.uint64)

    one, two, three = back(1), back(2), back(3)
    contexts = [one + np.uint64(1), (one << np.uint64(8) | two) + np.uint64(1 << 20), (one << np.uint64(16) | two << np.uint64(8) | three) + np.uint64(1 << 40)]
    shift = np.uint64(64 - max(8, model.slot_bits - 1))
    read = value.astype(np.uint8)
    partial, slots = PARTIAL[read], []
    for c in contexts:
        h = mix(c)[:, None] ^ partial
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= shift
        slots.append(h.view(np.int64).ravel())
    return np.repeat(word, 8), np.unpackbits(read), slots


def _parts(places: np.ndarray, most: int = 1_000) -> Iterator[slice]:
    yield from (slice(k, min(k + most, len(places))) for k in range(0, len(places), most))


def seen_slots(model: Model, coding: Coding, add) -> None:
    """Calls ``add(table, slots, bits)`` for all decisions of a unit: what the tables count."""
    for slot in coding.flag_slot:
        add(0, slot, coding.flag_bit)
    for k, slot in enumerate(coding.slot):
        add(1 + k, slot, coding.bit)
    places, _ = spelled(model, coding)
    for part in _parts(places):
        _, bit, slots = byte_decisions(model, coding.tokens, places[part])
        for k, slot in enumerate(slots):
            add(3 + k, slot, bit)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cost(model: Model, gate: np.ndarray, mixed: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bits that decisions cost, from the refined probability at the nearest step of the mixed logit."""
    place = ((mixed + np.float32(LIMIT)) * np.float32((FINE - 1) / (2 * LIMIT)) + np.float32(0.5)).astype(np.int64)
    place += gate * np.int64(FINE)
    place *= 2
    place += bit
    return np.take(model.costs, place, mode="clip")


def mix_online(model: Model, docs: int, group: np.ndarray, groups: tuple[np.ndarray, np.ndarray], x: np.ndarray, gate: np.ndarray, bit: np.ndarray, rate: float) -> np.ndarray:
    """Bits of each text's decisions; its weights follow it online from step to step (the block of each decision).

    group: of each decision, GATES times its place among ``groups``: their steps, which ascend, and texts.
    """
    steps, doc = groups
    if not len(group):
        return np.zeros(docs)
    # Decisions of a step, a text and a gate lie together: such a run has one set of weights.
    run = group + gate
    order = np.argsort(run, kind="stable")
    run, x, bit = run[order], np.stack([np.take(row, order, mode="clip") for row in x]), bit[order]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    long = np.diff(np.append(first, len(run)))
    run = run[first].astype(np.int64)
    step, doc, gate = steps[run // GATES], doc[run // GATES], run % GATES
    cell = doc * GATES + gate
    own = np.tile(model.weights.T, docs)
    mixed = np.empty(len(bit), np.float32)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(run)]))
    for r, s in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        a, b = first[r], first[s - 1] + long[s - 1]
        at, xs, m = cell[r:s], x[:, a:b], mixed[a:b]
        weighed = np.repeat(own[:, at], long[r:s], axis=1)
        weighed *= xs
        np.add(weighed[0], weighed[1], out=m)
        m += weighed[2]
        np.clip(m, -LIMIT, LIMIT, out=m)
        error = bit[a:b] - _sigmoid(m)
        own[:, at] += np.float32(rate) * np.add.reduceat(np.multiply(xs, error, out=weighed), first[r:s] - a, axis=1)
    return np.bincount(doc, np.add.reduceat(_cost(model, np.repeat(gate, long), mixed, bit), first), docs)


def flag_inputs(model: Model, coding: Coding, role: int, x: np.ndarray) -> np.ndarray:
    """Puts the inputs of the first decisions into ``x``; returns their gates."""
    x[0] = coding.flag_logit
    for row, slot in zip(x[1:], coding.flag_slot):
        if role in model.tables:
            _looked_up(model.tables[role][0], slot, row)
        else:
            row[:] = 0
    return coding.flag_gate


def tree_inputs(model: Model, coding: Coding, role: int, x: np.ndarray) -> np.ndarray:
    """Puts the inputs of the tree decisions into ``x``; returns their gates, by how well the contexts are known."""
    np.take(model.paths[3], coding.node, out=x[0], mode="clip")
    if role not in model.tables:
        x[1:] = 0
        return np.zeros(x.shape[1], np.uint8)
    sure = [_looked_up(model.tables[role][1 + k], slot, x[1 + k]) for k, slot in enumerate(coding.slot)]
    return (sure[1] + ((sure[0] & 2) << 1)).astype(np.uint8)


def word_inputs(model: Model, coding: Coding, role: int):
    """(inputs of the mixer, a row each; gate) of the first and then the tree decisions of a unit."""
    n = len(coding.flag_at)
    x = np.empty((INPUTS, n + len(coding.node)), np.float32)
    return x, np.concatenate((flag_inputs(model, coding, role, x[:, :n]), tree_inputs(model, coding, role, x[:, n:])))


def byte_inputs(model: Model, tokens: Tokens, role: int, places: np.ndarray):
    """(index into places, inputs, gate, bit) of the byte decisions of the words at these token places."""
    word, bit, slots = byte_decisions(model, tokens, places)
    x = np.zeros((INPUTS, len(bit)), np.float32)
    gate = np.full(len(bit), 8, np.uint8)
    if role in model.tables:
        *_, sure = (_looked_up(model.tables[role][3 + k], slot, x[k]) for k, slot in enumerate(slots))
        gate += sure.astype(np.uint8)
    return word, x, gate, bit


def _mixed(model: Model, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    w = model.weights.T
    return np.clip(w[0][gate] * x[0] + w[1][gate] * x[1] + w[2][gate] * x[2], -LIMIT, LIMIT)


def bits_of(model: Model, coding: Coding, role: int, rate: float, block: int) -> np.ndarray:
    """Total bits of each of these texts."""
    tokens, docs = coding.tokens, coding.docs
    x, gate = word_inputs(model, coding, role)
    low, high = tokens.bounds[[coding.first, coding.first + docs]]
    doc = tokens.doc[low:high]
    steps, group = np.unique((np.arange(low, high) - tokens.bounds[doc]) // block * docs + (doc - coding.first), return_inverse=True)
    token, bit = np.concatenate((coding.flag_at, coding.token)), np.concatenate((coding.flag_bit, coding.bit))
    group = (group * GATES).astype(np.uint16 if len(steps) * GATES <= 1 << 16 else np.int64)  # few groups are sorted by digits
    total = mix_online(model, docs, group[token - low], (steps // docs, steps % docs), x, gate, bit, rate)
    places, number = spelled(model, coding)
    cost = np.zeros(len(places) + 1)
    cost[-1] = 8.0  # an end token behind the escape is an end byte
    for part in _parts(places):
        word, x, gate, bit = byte_inputs(model, tokens, role, places[part])
        cost[part] += np.bincount(word, _cost(model, gate, _mixed(model, gate, x), bit), len(places[part]))
    # Behind the escape: a new word as often as words seen once are among such tokens; else by its count.
    fresh = (model.once + 1) / (model.rest + 2) if model.rest else 1.0
    seen = np.maximum(coding.seen, 0)
    rare = np.where(seen > 0, -np.log2(np.maximum((1 - fresh) * seen / max(1, model.rest), 1e-30)), cost[number] - math.log2(fresh))
    return total + np.bincount(tokens.doc[coding.rare] - coding.first, rare, docs)


class Learner:
    """Trains a mixer online: after each unit the weights of a gate take a damped Newton step.

    Also counts, by gate and bin of the mixed logit, decisions and ones: the adaptive map.
    """

    def __init__(self, model: Model):
        self.model = model
        self.ones, self.seen = np.zeros((GATES, BINS)), np.zeros((GATES, BINS))
        self.slope, self.bend = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))

    def _watch(self, x, gate, bit):
        order = np.argsort(gate, kind="stable")
        cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
        x, bit = np.stack([np.take(row, order, mode="clip") for row in x]), bit[order]
        for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a == b:
                continue
            xs, ones = x[:, a:b], bit[a:b]
            mixed = np.clip(self.model.weights[g] @ xs, -LIMIT, LIMIT)
            place = ((mixed + np.float32(LIMIT)) * np.float32((BINS - 1) / (2 * LIMIT)) + np.float32(0.5)).astype(np.int64)
            cells = np.bincount(place * 2 + ones, minlength=BINS * 2).reshape(BINS, 2)
            self.seen[g] += cells.sum(axis=1)
            self.ones[g] += cells[:, 1]
            p = _sigmoid(mixed)
            self.slope[g] += xs @ (ones - p)
            self.bend[g] += (xs * (p * (1 - p))) @ xs.T

    def learn(self, codings: Iterator[Coding], role: int) -> None:
        """One step from all decisions of a unit."""
        for coding in codings:
            x, gate = word_inputs(self.model, coding, role)
            self._watch(x, gate, np.concatenate((coding.flag_bit, coding.bit)))
            places, _ = spelled(self.model, coding)
            for part in _parts(places):
                self._watch(*byte_inputs(self.model, coding.tokens, role, places[part])[1:])
        step = np.linalg.solve(self.bend + 20 * np.eye(INPUTS), self.slope[:, :, None])[:, :, 0]
        self.model.weights = np.clip(self.model.weights + 0.5 * step, -1, 2).astype(np.float32)
        self.slope[:] = 0
        self.bend *= 0.5  # curvature is remembered, slopes are taken anew


def _units(rows: DataFrame, id_type: str) -> DataFrame:
    """(unit, role, doc_id, sizes, text): texts of one role in units of about UNIT_BYTES, one compressed value each."""

    def run(batches):
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(role):
            nonlocal made
            made += 1
            ids, texts, _ = held.pop(role)
            sizes, text = [len(t) for t in texts], pa.Codec("zstd", 3).compress(b"".join(texts), asbytes=True)
            arrays = [pa.array([task << 32 | made], pa.int64()), pa.array([role], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([text], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["unit", "role", "doc_id", "sizes", "text"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                kind = ids.type
                for d, t, role in zip(ids.to_pylist(), utf8(batch, "text"), batch.column(batch.schema.get_field_index("role")).to_pylist()):
                    here = held.setdefault(role, [[], [], 0])
                    here[0].append(d)
                    here[1].append(t)
                    here[2] += len(t) + 16
                    if here[2] >= UNIT_BYTES:
                        yield flush(role)
        for role in list(held):
            yield flush(role)

    return rows.select("doc_id", "text", "role").mapInArrow(run, f"unit long, role int, doc_id array<{id_type}>, sizes array<int>, text binary")


def _answers(units: DataFrame, buckets: int, top: int) -> DataFrame:
    """Asks every bucket for every unit; a bucket is one task's work."""

    def asking(batches):
        for batch in batches:
            for unit, role, sizes, text in _rows(batch, ["unit", "role", "sizes", "text"]):
                made = ask(Tokens(unit_texts(sizes, text)), role < 2, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(made.num_rows, unit)), *made.columns], names=["unit", *made.schema.names])

    def answering(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield answer(rows, top)

    asked = units.select("unit", "role", "sizes", "text").mapInArrow(asking, "unit long, bucket int, words binary, n binary, keys binary, after binary, m binary, more binary")
    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(answering, ANSWER)


def _answered(units: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Stored units with their answers in order of the buckets, joined part by part: a part's shuffle goes before the next."""

    def joined(part: int) -> DataFrame:
        here = F.pmod(F.xxhash64("unit"), F.lit(parts)) == part
        packed = answers.filter(here & (F.col("unit") >= 0)).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "packed"))).alias("answers"))
        return units.filter(here).join(packed, "unit")

    return Tables(units.sparkSession).stored([joined(part) for part in range(parts)], "answered")


def unit_texts(sizes: list[int], text: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    raw = pa.Codec("zstd").decompress(text, ends[-1], asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _rows(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list]:
    """Rows of a batch of units, one in memory at a time."""
    for k in range(batch.num_rows):
        one = batch.slice(k, 1)
        yield [one.column(one.schema.get_field_index(c)).to_pylist()[0] for c in columns]


def _packed_counts(counts: np.ndarray) -> bytes:
    """Whole counts, each in one byte where all fit; the first byte tells their size."""
    kind = np.dtype("u1" if counts.max() < 256 else "<i4")
    return bytes([kind.itemsize]) + pa.Codec("zstd", 1).compress(counts.astype(kind).tobytes(), asbytes=True)


def _unpacked_counts(value: bytes, n: int) -> np.ndarray:
    kind = np.dtype("u1" if value[0] == 1 else "<i4")
    return np.frombuffer(pa.Codec("zstd").decompress(value[1:], n * kind.itemsize, asbytes=True), kind)


def _counted(rows: DataFrame, model: Model, buckets: int) -> dict[int, list]:
    """Tables of both halves and of all training rows, from the decisions of all."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    sizes = model.sizes

    def run(batches):
        counts = [[np.zeros(2 * n, np.int32) for n in sizes] for _ in range(2)]  # zeros and ones of a slot side by side
        for batch in batches:
            for role, sizes_, text, answers in _rows(batch, ["role", "sizes", "text", "answers"]):
                here = counts[role]
                for coding in code(shared.value, Tokens(unit_texts(sizes_, text)), True, answers, buckets):
                    seen_slots(shared.value, coding, lambda table, slot, bit, here=here: np.add.at(here[table], (slot << 1) + bit, np.int32(1)))
        for role, half in enumerate(counts):
            for table, both in enumerate(half):
                made = [(k, _packed_counts(part)) for k in range(0, sizes[table], CHUNK) if (part := both[2 * k : 2 * (k + CHUNK)]).any()]
                if made:
                    arrays = [pa.array([x] * len(made), pa.int32()) for x in (role, table)] + [pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["role", "entry", "at", "counts"])

    def added(table: pa.Table) -> pa.Table:
        at = table.column("at")[0].as_py()
        total = np.zeros(2 * min(CHUNK, sizes[table.column("entry")[0].as_py()] - at), np.int64)
        for x in table.column("counts").to_pylist():
            total += _unpacked_counts(x, len(total))
        return pa.table({c: table.column(c).slice(0, 1) for c in ("role", "entry", "at")} | {"counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    kind = "role int, entry int, at int, counts binary"
    made = [[[np.zeros(n, np.int32) for _ in range(2)] for n in sizes] for _ in range(2)]
    for r in rows.mapInArrow(run, kind).groupBy("role", "entry", "at").applyInArrow(added, kind).toLocalIterator():
        both = np.frombuffer(r["counts"], "<i4").reshape(-1, 2).T
        for k in range(2):
            made[r["role"]][r["entry"]][k][r["at"] : r["at"] + both.shape[1]] = both[k]
    return {0: [_logits(*x) for x in made[1]], 1: [_logits(*x) for x in made[0]], 2: [_logits(a[0].astype(np.int64) + b[0], a[1].astype(np.int64) + b[1]) for a, b in zip(*made)]}


def _train_mixer(rows: DataFrame, model: Model, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixer weights and adaptive map: each task learns online from its documents, tasks are averaged by gate."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learner = Learner(replace(shared.value, weights=shared.value.weights.copy()))
        for batch in batches:
            for role, sizes, text, answers in _rows(batch, ["role", "sizes", "text", "answers"]):
                learner.learn(code(shared.value, Tokens(unit_texts(sizes, text)), True, answers, buckets), role)
        weights, ones, seen = learner.model.weights.astype(np.float64), learner.ones, learner.seen
        for gate in range(GATES):
            total = seen[gate].sum()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), pa.array([total]), pa.array([(weights[gate] * total).tolist() + ones[gate].tolist() + seen[gate].tolist()], pa.list_(pa.float64()))], names=["gate", "total", "values"])

    parts = rows.mapInArrow(run, "gate int, total double, values array<double>")
    added = parts.select("gate", "total", F.posexplode("values")).groupBy("gate", "pos").agg(F.sum("col").alias("v"), F.sum("total").alias("n")).collect()
    weights, counts = model.weights.copy(), np.zeros((GATES, 2, BINS))
    for r in added:
        if r["pos"] < INPUTS:
            weights[r["gate"], r["pos"]] = r["v"] / r["n"]
        else:
            kind, place = divmod(r["pos"] - INPUTS, BINS)
            counts[r["gate"], kind, place] = r["v"]
    centre = _sigmoid(np.linspace(-LIMIT, LIMIT, BINS))
    share = (counts[:, 0] + 20 * centre) / (counts[:, 1] + 20)
    return weights, np.clip(np.log(share / (1 - share)), -LIMIT, LIMIT).astype(np.float32)


def train(rows: DataFrame, id_type: str, vocabulary: int = 1 << 15) -> tuple[Model, DataFrame, int]:
    """Learns from the rows (doc_id, text, role) of roles 0 and 1; returns the model, all rows in stored units with what
    the buckets answer, and the number of buckets.

    vocabulary: words of the tree at most.
    """
    made = Tables(rows.sparkSession)
    units = made.stored(_units(rows, id_type), "units")
    size = units.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, t: n + t).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    top = 4 * vocabulary // buckets + 200  # words are dealt by hash: a bucket has more of the tree's words only by a miracle
    answers = made.stored(_answers(units, buckets, top), "answers")
    about = answers.filter("unit < 0").collect()
    sizes, hashes, n = told_by_buckets([r["packed"] for r in about])
    keep = np.lexsort((hashes, -n))[:vocabulary]
    keep = keep[n[keep] > 1]  # words seen once stay out: what they share with new words is their spelling
    hashes, n = hashes[keep], n[keep]
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    frequent = np.zeros(len(n) + 2, bool)
    frequent[np.argsort(-n, kind="stable")[:GUIDES]] = True
    tokens = int(sizes[2])
    rest = tokens - int(n.sum())
    model = Model(min(22, max(16, tokens.bit_length() - 7)), tokens, int(sizes[0]), hashes, huffman(np.append(n, max(1, rest))), frequent, rest, int(sizes[1]))
    units = _answered(units, answers, min(JOINS, buckets))
    made.drop()
    training = units.filter("role < 2").select("role", "sizes", "text", "answers")
    model.tables = _counted(training.coalesce(max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // COUNTED_BYTES))), model, buckets)
    weights, refine = _train_mixer(training, model, buckets)
    return replace(model, weights=weights, refine=refine), units, buckets


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", training: Column | None = None, rate: float = 0.02, block: int = 64, **sizes) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    training: which rows to learn from; by default those whose crc32(doc id) modulo 5 is not 1.
    """
    training = fold_of(doc_id) != 1 if training is None else training
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    half = F.pmod(F.crc32(words.cast("binary")), F.lit(2)).cast("int")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words.alias("text"), F.when(training, half).otherwise(2).alias("role"))
    id_type = dict(docs.dtypes)[doc_id]
    model, units, buckets = train(rows, id_type, **sizes)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for u, (role, sizes, text, answers) in enumerate(_rows(batch, ["role", "sizes", "text", "answers"])):
                model, texts = shared.value, unit_texts(sizes, text)
                tokens, docs = Tokens(texts), len(texts)
                codings = ((c.counts, bits_of(model, c, role, rate, block)) for c in code(model, tokens, role < 2, answers, buckets))
                counts, bits = map(np.concatenate, zip(*codings))
                arrays = [
                    ids[u].values,
                    pa.array(np.full(docs, role == 2)),
                    pa.array(np.diff(tokens.bounds)),
                    pa.array(np.bincount(tokens.doc, counts > 0, docs).astype(np.int64)),
                    pa.array(np.full(docs, model.train_tokens)),
                    pa.array(np.bincount(tokens.doc, model.base(counts), docs)),
                    pa.array(bits * -LOG10_2),
                    pa.array(bits / np.maximum([len(t) for t in texts], 1)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return units.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
