"""Which windows of a fixed number of units also start in a document with a smaller id.

Three rounds over blocks (see ``shared``), each asking only about what survived
the one before:

1. anchors: of every window the least-hashed stretch of ``k`` units; anchors that
   only one document has are done with;
2. contexts: the units around a repeated anchor that any window holding it can
   reach.  A context also found in a smaller document settles all its windows at
   once, so long common passages and groups of copies cost one entry per block
   and not one for each window and copy.  Contexts are dealt by their own hash, and
   a block tells of each anchor only whether it has one context or several, so an
   anchor with very many contexts loads no task;
3. windows: only at the edges of common passages, where contexts differ, single
   windows are compared; how is up to the operator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shared import packed40, unpacked40
from .units import U, all_windows, minimizers, mix, prefix, span_hash, window_min

COVERED, EDGE, ALONE, OTHER = 0, 1, 2, 3
_SALT = U(0xA0761D6478BD642F)
_SALT2 = U(0xE7037ED1A0B428DB)
_SALT3 = U(0x8EBC6AF09C88C6E3)
#: Kinds of questions that go to buckets of their own.
CONTEXT, ANCHOR, WINDOW = b"CAW"


@dataclass
class Doc:
    id: int
    n: int
    s: np.ndarray
    h: np.ndarray
    pos: np.ndarray
    g: np.ndarray


def other(units: np.ndarray) -> np.ndarray:
    """Units for a second hash, independent of the first."""
    return mix(units ^ _SALT3)


def second(s: np.ndarray) -> np.ndarray:
    """Prefix sums of the second hash from those of the first."""
    n = np.arange(len(s) - 1)
    return prefix(other(span_hash(s, n, n + 1)))


def answer(bodies: list[bytes]) -> list[bytes]:
    """Answers to questions about contexts, anchors or windows; a bucket is asked one kind."""
    kind, own = bodies[0][0], [x[1:] for x in bodies]
    return [bytes([kind]) + x for x in (several(own) if kind == ANCHOR else smaller(own))]


class Scan:
    """One block's documents with their anchors, and what is known of these."""

    def __init__(self, docs: list[tuple[int, np.ndarray]], window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        self.docs = []
        for doc_id, units in docs:
            n = len(units)
            if n < window or doc_id is None:
                empty = np.zeros(0, U)
                self.docs.append(Doc(doc_id, n, empty, empty, np.zeros(0, np.int64), empty))
                continue
            s = prefix(units)
            h = all_windows(s, k) & ~U(3)
            pos = minimizers(h, self.w)
            self.docs.append(Doc(doc_id, n, s, h, pos, mix(h[pos] ^ _SALT)))
        #: A null id is under all others only as a place holder; such a document has no windows.
        self.ids = np.array([-(1 << 62) if d.id is None else d.id for d in self.docs], np.int64)
        each = [np.unique(d.g) for d in self.docs if len(d.g)]
        self.keys, count = np.unique(np.concatenate(each) if each else np.zeros(0, U), return_counts=True)
        self.several = count > 1

    # round 1
    def anchors(self, buckets: int):
        for b, lo, hi in slices(self.keys, buckets):
            yield b, packed40(within(self.keys[lo:hi], buckets)) + np.packbits(self.several[lo:hi]).tobytes() + np.uint32(hi - lo).tobytes()

    # round 2
    def know_anchors(self, answers: list[bytes]) -> None:
        repeated = bits(answers)
        docs, places, at, one, two, g = [], [], [], [], [], []
        for i, d in enumerate(self.docs):
            own = np.flatnonzero(repeated[np.searchsorted(self.keys, d.g)]) if len(d.g) else ()
            if not len(own):
                continue
            p = d.pos[own]
            lo, hi = np.maximum(p - (self.window - self.k), 0), np.minimum(p + self.window, d.n)
            g.append(d.g[own])
            one.append(mix(span_hash(d.s, lo, hi) ^ mix((p - lo).astype(U) * U(1 << 20) + (hi - p).astype(U)) ^ _SALT2))
            two.append(mix(span_hash(second(d.s), lo, hi)) >> U(40))
            docs.append(np.full(len(own), i))
            at.append(own)
            places.append(p)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.occ_doc, self.occ_at, self.occ_pos = whole(docs, np.int64), whole(at, np.int64), whole(places, np.int64)
        self.keyed = Asked(whole(one, U), whole(two, U), self.ids[self.occ_doc])
        self.groups = Groups(whole(g, U)[self.keyed.first], self.keyed.a)

    def contexts(self, buckets: int):
        yield from self.keyed.emit(buckets, CONTEXT)
        yield from self.groups.emit(buckets)

    # round 3
    def know_contexts(self, answers: list[bytes]) -> None:
        other = bits(of_kind(answers, CONTEXT))
        assert len(other) == len(self.keyed.a)
        self.entry_state = np.where(other, COVERED, np.where(self.groups.states(answers) > 0, EDGE, ALONE)).astype(np.uint8)
        self.occ_state = np.where(self.keyed.later, COVERED, self.entry_state[self.keyed.entry]).astype(np.uint8)

    def window_states(self):
        """(document, state of every window) of documents with a window that is not ALONE."""
        if not len(self.occ_doc):
            return
        useful = self.occ_state < ALONE
        ends = np.flatnonzero(np.diff(self.occ_doc, append=-1)) + 1
        lo = 0
        for hi in ends.tolist():
            if useful[lo:hi].any():
                d = self.docs[int(self.occ_doc[lo])]
                hs = d.h | U(3)
                p = self.occ_pos[lo:hi]
                hs[p] = d.h[p] | self.occ_state[lo:hi].astype(U)
                yield int(self.occ_doc[lo]), (window_min(hs, self.w) & U(3)).astype(np.uint8)
            lo = hi


class Keys:
    """Occurrences by a key of 64 (g) and 40 (c) bits: each key once, with its least document."""

    def __init__(self, g: np.ndarray, c: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, c, g))
        first = np.ones(len(order), bool)
        first[1:] = (g[order[1:]] != g[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        self.first = order[first]
        self.g, self.c, self.least = g[self.first], c[self.first], ids[self.first]
        self.later = ids > self.least[self.entry]

    def emit(self, buckets: int):
        for b, lo, hi in slices(self.g, buckets):
            yield b, packed40(within(self.g[lo:hi], buckets)) + packed40(self.c[lo:hi]) + self.least[lo:hi].astype("<i8").tobytes()


class Groups:
    """Contexts by their anchor: each anchor once, with one of its contexts and their number."""

    def __init__(self, g: np.ndarray, context: np.ndarray):
        order = np.argsort(g, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], g[order][1:] != g[order][:-1]))) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(g)))
        self.of = np.empty(len(g), np.int64)
        self.of[order] = np.repeat(np.arange(len(start)), n)
        self.g, self.context, self.n = g[order][start], context[order][start] >> U(24), np.minimum(n, 0xFFFF)

    def emit(self, buckets: int):
        for b, lo, hi in slices(self.g, buckets):
            yield b + buckets, bytes([ANCHOR]) + packed40(within(self.g[lo:hi], buckets)) + packed40(self.context[lo:hi]) + self.n[lo:hi].astype("<u2").tobytes()

    def states(self, answers: list[bytes]) -> np.ndarray:
        """For each context: what ``several`` says of its anchor."""
        known = [np.frombuffer(x, np.uint8) for x in of_kind(answers, ANCHOR)]
        both = np.concatenate(known) if known else np.zeros(0, np.uint8)
        assert len(both) == len(self.g)
        return both[self.of]


class Asked:
    """Occurrences by a key of 64 (a) and 24 (b) bits: each key once, with its least document."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray):
        order = np.argsort(a, kind="stable")
        x, y = a[order], b[order]
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
        start = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(a) else np.zeros(0, np.int64)
        self.a, self.b = x[start], y[start]
        own = ids[order]
        self.least = np.minimum.reduceat(own, start) if len(a) else own
        entry = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(a))))
        self.entry = np.empty(len(a), np.int64)
        self.entry[order] = entry
        self.later = ids > self.least[self.entry]
        at = np.flatnonzero(own == self.least[entry])[::-1]
        self.first = np.empty(len(start), np.int64)
        self.first[entry[at]] = order[at]

    def emit(self, buckets: int, kind: int):
        for b, lo, hi in slices(self.a, buckets):
            key = (self.a[lo:hi] * U(buckets)).astype("<u8")  # what the bucket leaves open of it
            yield b, bytes([kind]) + key.tobytes() + self.b[lo:hi].astype("<u4").tobytes() + self.least[lo:hi].astype("<i8").tobytes()


def of_kind(answers: list[bytes], kind: int) -> list[bytes]:
    return [x[1:] for x in answers if x[0] == kind]


def smaller(bodies: list[bytes]) -> list[bytes]:
    """For each key: does a smaller document have it?"""
    sizes = [len(x) // 20 for x in bodies]
    a, b, d = (np.concatenate([np.frombuffer(x, t, n, at * n) for x, n in zip(bodies, sizes, strict=True)]) for t, at in (("<u8", 0), ("<u4", 8), ("<i8", 12)))
    got = Asked(a, b, d)
    return [np.packbits(x).tobytes() + np.uint32(len(x)).tobytes() for x in _split(got.later, sizes)]


def several(bodies: list[bytes], hot: int = 1 << 62) -> list[bytes]:
    """For each anchor: 0 if all have one context, 1 if there are others, 2 if more than hot."""
    sizes = [len(x) // 12 for x in bodies]
    g = np.concatenate([unpacked40(x[: 5 * n]) for x, n in zip(bodies, sizes, strict=True)])
    one = np.concatenate([unpacked40(x[5 * n : 10 * n]) for x, n in zip(bodies, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(x, "<u2", n, 10 * n) for x, n in zip(bodies, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(g)
    start = np.flatnonzero(np.concatenate(([True], g[order][1:] != g[order][:-1])))
    total = np.add.reduceat(count[order], start)
    many = (np.minimum.reduceat(one[order], start) != np.maximum.reduceat(one[order], start)) | (np.maximum.reduceat(count[order], start) > 1)
    state = np.where(many, np.where(total > hot, 2, 1), 0).astype(np.uint8)
    out = np.empty(len(g), np.uint8)
    out[order] = np.repeat(state, np.diff(np.append(start, len(g))))
    return [x.tobytes() for x in _split(out, sizes)]


def slices(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted 64-bit keys: each bucket has an equal range of them."""
    if not len(keys):
        return
    low, n = U(0xFFFFFFFF), U(buckets)
    b = ((keys >> U(32)) * n + ((keys & low) * n >> U(32))) >> U(32)
    cut = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(b[lo]), lo, hi


def within(keys: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits that tell keys of one bucket apart: where in its range they stand, so more buckets resolve more keys."""
    return (keys * U(buckets)) >> U(24)


def bits(answers: list[bytes]) -> np.ndarray:
    """Answers of round 1 and of window questions: a bit for each key, the count last."""
    out = [np.unpackbits(np.frombuffer(x, np.uint8)[:-4], count=int(np.frombuffer(x[-4:], np.uint32)[0])) for x in answers]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _split(flat: np.ndarray, sizes: list[int]):
    at = 0
    for n in sizes:
        yield flat[at : at + n]
        at += n


def answer_anchors(bodies: list[bytes]) -> list[bytes]:
    """For each key of each block: does it occur in several documents?"""
    sizes = [int(np.frombuffer(x[-4:], np.uint32)[0]) for x in bodies]
    keys = np.concatenate([unpacked40(x[: 5 * n]) for x, n in zip(bodies, sizes, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(x[5 * n : -4], np.uint8), count=n) for x, n in zip(bodies, sizes, strict=True)]).astype(bool)
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    rep = several[order]
    rep[1:] |= same
    rep[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = rep
    # a key that one block holds in several documents is repeated for every block: it then has a neighbour or is that block's own
    return [np.packbits(x).tobytes() + np.uint32(len(x)).tobytes() for x in _split(out, sizes)]


def _gathered(bodies: list[bytes]):
    """Sizes, and the entries (g, c, document) of all blocks in order of these, with that order."""
    sizes = [len(x) // 18 for x in bodies]
    g = np.concatenate([unpacked40(x[: 5 * n]) for x, n in zip(bodies, sizes, strict=True)])
    c = np.concatenate([unpacked40(x[5 * n : 10 * n]) for x, n in zip(bodies, sizes, strict=True)])
    d = np.concatenate([np.frombuffer(x[10 * n :], "<i8") for x, n in zip(bodies, sizes, strict=True)])
    order = np.lexsort((d, c, g))
    return sizes, g[order], c[order], d[order], order


def covered_spans(starts: np.ndarray, window: int) -> np.ndarray:
    """The maximal runs of units within windows that begin at starts, as rows of start and end."""
    s = np.unique(starts)
    if not len(s):
        return np.zeros((0, 2), np.int64)
    last = np.append(np.flatnonzero(s[1:] > s[:-1] + window), len(s) - 1)
    first = np.concatenate(([0], last[:-1] + 1))
    return np.stack((s[first], s[last] + window), axis=1)


def between(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """What spans leave of n units."""
    ends = [0, *spans[:, 1].tolist()]
    return [(a, b) for a, b in zip(ends, [*spans[:, 0].tolist(), n], strict=True) if a < b]
