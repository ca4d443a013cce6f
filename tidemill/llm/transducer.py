"""A byte transducer by table: one pass over UTF-8 counts words, different words, capitals, code points and symbols.

Two states (between words, inside a word) and five kinds of bytes; a table gives what each step emits. The kind of a byte
alone decides the state behind it, so the states of a block come from one lookup and the pass is a vector operation. Word
spans that the pass emits go into an open-addressing hash table: spans with equal hashes are compared byte for byte.
Texts are taken in blocks that end between words; the table lasts over the blocks of a batch.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20

#: Kinds of bytes: space, continuation of a code point, capital, symbol, any other.
SPACE, TAIL, CAPITAL, SYMBOL, OTHER = range(5)
KINDS = bytes(
    SPACE if b == 0x20 or 0x09 <= b <= 0x0D else TAIL if 0x80 <= b < 0xC0 else CAPITAL if 0x41 <= b <= 0x5A else SYMBOL if b in b"#$%&*|" else OTHER
    for b in range(256)
)
BETWEEN, INSIDE = 0, 1
NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
#: What a step emits.
BEGIN, END, POINT, CAP, SYM = 1, 2, 4, 8, 16
EMIT = np.zeros((2, 5), np.uint8)
EMIT[:, SPACE] = POINT
EMIT[INSIDE, SPACE] |= END
EMIT[:, CAPITAL] = POINT | CAP
EMIT[:, SYMBOL] = POINT | SYM
EMIT[:, OTHER] = POINT
EMIT[BETWEEN, TAIL:] |= BEGIN

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_tables: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(max(n, BLOCK_BYTES) + 64, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SpanTable:
    """Distinct (group, bytes of a span): open addressing, every match verified on the bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from any offset
        self.slots = np.full(1 << 10, -1, np.int64)
        self.n = 0
        self.held = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64)]  # group, start, size, hash

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether entries ``a`` and ``b`` are equal, to the last byte."""
        group, start, size, code = self.held
        same = (code[a] == code[b]) & (size[a] == size[b]) & (group[a] == group[b])
        open_ = np.flatnonzero(same)
        at, p, q, left = open_, start[a[open_]], start[b[open_]], size[a[open_]]
        for i in np.flatnonzero(left > 256):
            same[at[i]] = self.data[p[i] : p[i] + left[i]] == self.data[q[i] : q[i] + left[i]]
        short = left <= 256
        at, p, q, left = at[short], p[short], q[short], left[short]
        while len(at):
            used = (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)) & np.uint64(63)
            equal = (self.eight[p] ^ self.eight[q]) << used == 0
            same[at[~equal]] = False
            on = np.flatnonzero(equal & (left > 8))
            at, p, q, left = at[on], p[on] + 8, q[on] + 8, left[on] - 8
        return same

    def _place(self, ids: np.ndarray) -> np.ndarray:
        """Give each of these entries a slot, or leave it out where an equal one has one; the slots that were taken."""
        room, taken = np.uint64(len(self.slots) - 1), []
        at = (_mix(self.held[3][ids] + self.held[0][ids].astype(np.uint64) * np.uint64(_BASE)) & room).astype(np.int64)
        while len(ids):
            free = self.slots[at] < 0
            self.slots[at[free]] = ids[free]
            other = self.slots[at] != ids
            taken.append(at[free & ~other])
            on = np.flatnonzero(other)
            on = on[~self._same(self.slots[at[on]], ids[on])]
            ids, at = ids[on], (at[on] + 1) & int(room)
        return np.concatenate(taken) if taken else at

    def add(self, group: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> None:
        first, last = self.n, self.n + len(start)
        if last > len(self.held[0]):
            self.held = [np.concatenate((h[:first], np.zeros(max(last, 2 * first) - first, h.dtype))) for h in self.held]
        for h, new in zip(self.held, (group, start, size, code)):
            h[first:last] = new
        if 2 * last > len(self.slots):
            self.slots = np.full(1 << int(2 * last).bit_length(), -1, np.int64)
            self._place(np.arange(first))
        taken = self._place(np.arange(first, last))
        # Entries that got a slot move to the front: the i-th slot's entry becomes entry first + i.
        self.n = first + len(taken)
        for h in self.held:
            h[first : self.n] = h[self.slots[taken]]
        self.slots[taken] = np.arange(first, self.n)

    def distinct(self, groups: int) -> np.ndarray:
        return np.bincount(self.held[0][: self.n], minlength=groups)


def profile(texts: list[bytes | None], block: int = BLOCK_BYTES) -> list[np.ndarray]:
    """Words, different words, capitals, code points and symbols of each text, as arrays; a null text is empty."""
    count = len(texts)
    words, capitals, points, symbols = (np.zeros(count, np.int64) for _ in range(4))
    if not count:
        return [words, words, capitals, points, symbols]
    data = b" ".join([t or b"" for t in texts]) + b" " * 9
    size = np.array([len(t or b"") + 1 for t in texts], np.int64)
    cuts = np.concatenate(([0], np.cumsum(size)))
    table, end, first = SpanTable(data), int(cuts[-1]), 0
    while first < end:
        last = min(end, first + block)
        part = data[first:last].translate(KINDS)
        gap = part.rfind(SPACE)
        while gap < 0:  # a word longer than a block
            last = min(end, last + block)
            part = data[first:last].translate(KINDS)
            gap = part.rfind(SPACE)
        kinds = np.frombuffer(part, np.uint8)[: gap + 1]
        last = first + gap + 1
        state = np.empty(len(kinds), np.uint8)
        state[0] = BETWEEN
        np.take(NEXT, kinds[:-1], out=state[1:])
        step = np.take(EMIT.ravel(), state * np.uint8(5) + kinds)
        lo, hi = int(np.searchsorted(cuts, first, "right")) - 1, int(np.searchsorted(cuts, last, "left"))
        edges = np.maximum(cuts[lo:hi] - first, 0)
        begun = (step & BEGIN) != 0
        begins = np.add.reduceat(begun.view(np.uint8), edges, dtype=np.int64)
        words[lo:hi] += begins
        for flag, into in ((CAP, capitals), (POINT, points), (SYM, symbols)):
            into[lo:hi] += np.add.reduceat(((step & flag) != 0).view(np.uint8), edges, dtype=np.int64)
        starts, ends = np.flatnonzero(begun), np.flatnonzero((step & END) != 0)
        if len(starts):
            up, down = _powers(len(kinds))
            raw = np.frombuffer(data, np.uint8, len(kinds), first).astype(np.uint64)
            raw += np.uint64(1)
            raw *= up[: len(raw)]
            total = np.cumsum(raw, dtype=np.uint64)
            code = (total[ends - 1] - total[starts] + raw[starts]) * down[starts]
            table.add(np.repeat(np.arange(lo, hi), begins), starts + first, ends - starts, _mix(code))
        first = last
    return [words, table.distinct(count), capitals, points - 1, symbols]
