"""Removal of long repeated byte strings with a run-length index.

Most of a corpus repeats nothing, so anchors first find the places where a window
can have a copy: of every window the least-hashed stretch of two thirds its length,
worked out once, as blocks are written.  Then, for blocks and what survives in them:

1. anchors: those that only one document has are done with;
2. contexts: the bytes around a repeated anchor that any window holding it can reach.
   If a smaller document has the same context, all its windows are copies; if no other
   context has the anchor, none is but in copies of this one;
3. the rest are the edges of common stretches: texts that are copies of each other but
   for a part.  Of each, the windows that have this anchor go to a bucket.  Its texts,
   which share anchors and so compress well, are indexed by their run-length encoded
   Burrows-Wheeler transform; their matching statistics are streamed over it, and
   matches of a window or more whose text is also in a smaller document are marked.

An anchor with more than HOT contexts does not go to one bucket: its windows are asked
for singly, each by its own hash.  All other questions are dealt by their own hash, too,
and a block asks each once, so no anchor, context or window loads one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .run_length_index import smaller_owner_windows
from .shared import BUCKET_BYTES, ask, blocks, bucket_count, buffers, each_block, packed40, with_answers, with_fields
from .units import U, byte_units, mix, prefix, span_hash, stir, text_minimizers

MIN_BYTES = 50
#: The greatest number of windows with one anchor: a mark has a bit for each.
PLACES = 32
#: Contexts of one anchor that a bucket indexes together.
HOT = 1 << 14
#: Bytes whose prefix sums are held at once; a longer text by itself.
STRETCH = 1 << 17
#: The column of a block's rows that has the distances between anchors; not a name that a table's column has.
_ANCHORS = "\0anchors"
_SALT, _SALT2 = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
_OTHER = R.other(byte_units(bytes(range(256))))
_TEXT, _WINDOW = b"TW"


def anchor_bytes(window: int) -> int:
    return max(2 * window // 3, window - PLACES + 1)


def _stretches(off: np.ndarray):
    """(first, last + 1) of rows with about STRETCH bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STRETCH, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _bytes_of(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, joined, and where each begins and the last one ends; a null text has none."""
    column = batch.column(batch.schema.get_field_index(text_col))
    data, off, valid = buffers(column)
    if not valid.all() and np.diff(off)[~valid].any():
        return _bytes_of(pa.record_batch([column.fill_null("" if pa.types.is_string(column.type) else b"")], names=[text_col]), text_col)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] else np.zeros(0, np.uint8), off - off[0]


def with_anchors(id_col: str, text_col: str, window: int):
    """A function that adds the distances between a text's anchors, a byte each, to rows."""
    k = anchor_bytes(window)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = _bytes_of(batch, text_col)
        usable = batch.column(batch.schema.get_field_index(id_col)).is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes] = []
        for i, j in _stretches(off):
            at = off[i : j + 1] - off[i]
            pos = text_minimizers(prefix(byte_units(data[off[i] : off[j]])), at[1:], window, k)
            cut = np.searchsorted(pos, at)
            for r in range(j - i):
                own = pos[cut[r] : cut[r + 1]]
                out.append(np.diff(own, prepend=at[r]).astype(np.uint8).tobytes() if usable[i + r] else b"")
        return batch.append_column(_ANCHORS, pa.array(out, pa.binary()))

    return add


class Block:
    """A block's texts, their anchors, and what is known of these; places are bytes of the whole block."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, window: int):
        self.window, self.k = window, anchor_bytes(window)
        self.reach = window - self.k
        self.data, self.off = _bytes_of(batch, text_col)
        self.ids = batch.column(batch.schema.get_field_index(id_col)).fill_null(0).to_numpy().astype(np.int64)  # without an id there are no anchors
        raw, at, _ = buffers(batch.column(batch.schema.get_field_index(_ANCHORS)))
        step = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].astype(np.int64) if at[-1] else np.zeros(0, np.int64)
        at = at - at[0]
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        far = np.cumsum(step)
        before = np.concatenate(([0], far))[at[:-1]]
        self.pos = far - before[self.doc] + self.off[:-1][self.doc]

    def hashes(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Unmixed hashes of spans in ascending order of their starts, by one or two polynomials."""
        one, two = np.zeros(len(start), U), np.zeros(len(start) if second else 0, np.uint32)
        for i, j in _stretches(self.off):
            a, b = self.off[i], self.off[j]
            x, y = np.searchsorted(start, (a, b))
            if x < y:
                units = byte_units(self.data[a:b])
                one[x:y] = span_hash(prefix(units), start[x:y] - a, end[x:y] - a)
                if second:
                    two[x:y] = mix(span_hash(prefix(_OTHER[self.data[a:b]]), start[x:y] - a, end[x:y] - a)) >> U(40)
        return one, two

    def anchor_hash(self, of: np.ndarray) -> np.ndarray:
        """What anchors are chosen by, least first."""
        return stir(self.hashes(self.pos[of], self.pos[of] + self.k)[0]) & ~U(3)

    # round 1
    def find_anchors(self) -> None:
        self.h = self.anchor_hash(np.arange(len(self.pos)))
        self.g = mix(self.h ^ _SALT)
        order = np.argsort(self.g)
        g, doc = self.g[order], self.doc[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        self.keys = g[first]
        self.key_of = np.empty(len(g), np.int64)
        self.key_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
        self.several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(g) else np.zeros(0, bool)

    def ask_anchors(self, buckets: int):
        for b, lo, hi in R.slices(self.keys, buckets):
            yield b, packed40(R.within(self.keys[lo:hi], buckets)) + np.packbits(self.several[lo:hi]).tobytes() + np.uint32(hi - lo).tobytes()

    # round 2
    def know_anchors(self, answers: list[bytes]) -> None:
        """occ: the anchors that several documents have; an entry for each of their contexts."""
        self.find_anchors()
        repeated = R.bits(answers)
        self.occ = np.flatnonzero(repeated[self.key_of]) if len(self.pos) else np.zeros(0, np.int64)
        p, doc = self.pos[self.occ], self.doc[self.occ]
        self.lo, self.hi = np.maximum(p - self.reach, self.off[doc]), np.minimum(p + self.window, self.off[doc + 1])
        one, two = self.hashes(self.lo, self.hi, True)
        shape = mix((p - self.lo).astype(U) * U(1 << 20) + (self.hi - p).astype(U))
        self.contexts = R.Asked(mix(one ^ shape ^ _SALT2), two, self.ids[doc])
        self.groups = R.Groups(self.g[self.occ[self.contexts.first]], self.contexts.a)

    def ask_contexts(self, buckets: int):
        yield from self.contexts.emit(buckets, R.CONTEXT)
        yield from self.groups.emit(buckets)

    # round 3
    def know_contexts(self, answers: list[bytes]) -> None:
        """Which entries' windows are all copies, and which entries are edges, by anchors that are hot or not."""
        other, state = R.bits(R.of_kind(answers, R.CONTEXT)), self.groups.states(answers)
        self.covered = other[self.contexts.entry] | self.contexts.later  # of occurrences
        edge, hot = ~other & (state > 0), state > 1
        self.place_windows(np.flatnonzero(edge))
        by_g = lambda x: x[np.argsort(self.g[self.occ[self.contexts.first[x]]], kind="stable")]
        self.texts, self.hot = by_g(np.flatnonzero(edge & ~hot)), np.flatnonzero(edge & hot)

    def place_windows(self, entry: np.ndarray) -> None:
        """For the entries given: the first and last start of the windows that have this anchor, none with a lesser one."""
        of = self.occ[self.contexts.first[entry]]
        p, doc, h, reach = self.pos, self.doc, self.h, self.reach
        first, last = np.maximum(p[of] - reach, self.off[doc[of]]), np.minimum(p[of], self.off[doc[of] + 1] - self.window)
        for sign in (-1, 1):
            live, at = np.arange(len(of)), of
            while len(live):
                at = at + sign
                ok = (at >= 0) & (at < len(p))
                live, at = live[ok], at[ok]
                own = of[live]
                ok = (doc[at] == doc[own]) & (np.abs(p[at] - p[own]) <= reach)
                live, at, own = live[ok], at[ok], own[ok]
                less = h[at] < h[own]
                if sign < 0:
                    first[live[less]] = np.maximum(first[live[less]], p[at[less]] + 1)
                else:
                    last[live[less]] = np.minimum(last[live[less]], p[at[less]] - reach - 1)
                live, at = live[~less], at[~less]
        self.first, self.last = np.zeros(len(self.contexts.a), np.int64), np.full(len(self.contexts.a), -1)
        self.first[entry], self.last[entry] = first, last

    def ask_texts(self, buckets: int):
        of = self.occ[self.contexts.first[self.texts]]
        lo, hi = self.first[self.texts], self.last[self.texts] + self.window
        raw = self.data.tobytes() if len(of) else b""
        for b, x, y in R.slices(self.g[of], buckets):
            body = b"".join([raw[s:e] for s, e in zip(lo[x:y].tolist(), hi[x:y].tolist(), strict=True)])
            yield b, bytes([_TEXT]) + np.uint32(y - x).tobytes() + self.contexts.least[self.texts[x:y]].astype("<i8").tobytes() + (hi - lo)[x:y].astype(np.uint8).tobytes() + body

    def hot_windows(self) -> R.Asked:
        """The single windows of edges whose anchor is hot; their starts, and the entries these are from."""
        n = np.maximum(self.last[self.hot] - self.first[self.hot] + 1, 0)
        start = np.repeat(self.first[self.hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        entry = np.repeat(self.hot, n)
        order = np.argsort(start, kind="stable")
        self.hot_start, self.hot_entry = start[order], entry[order]
        one, two = self.hashes(self.hot_start, self.hot_start + self.window, True)
        return R.Asked(mix(one ^ _SALT2), two, self.contexts.least[self.hot_entry])

    def copies(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the block whose bytes are to go, from all answers."""
        spans = [np.stack((self.lo[self.covered], self.hi[self.covered]), 1)]
        n = len(self.contexts.a)
        marks = np.zeros(n, np.uint32)
        known = [np.frombuffer(x, "<u4") for x in R.of_kind(answers, _TEXT)]
        if known:
            marks[self.texts] = np.concatenate(known)
        if len(self.hot):
            asked, bits = self.hot_windows(), R.bits(R.of_kind(answers, _WINDOW))
            hit = bits[asked.entry] | asked.later
            np.bitwise_or.at(marks, self.hot_entry[hit], np.uint32(1) << (self.hot_start - self.first[self.hot_entry])[hit].astype(np.uint32))
        p = self.pos[self.occ]
        ahead = p[self.contexts.first] - self.first  # of an entry's first place
        at = np.flatnonzero(~self.covered & (marks[self.contexts.entry] > 0))
        o, bit = np.nonzero(marks[self.contexts.entry[at]][:, None] >> np.arange(PLACES, dtype=np.uint32) & 1)
        start = p[at][o] - ahead[self.contexts.entry[at]][o] + bit
        spans.append(np.stack((start, start + self.window), 1))
        spans = np.concatenate(spans)
        return spans[spans[:, 1] - spans[:, 0] >= self.window]


def _indexed(bodies: list[bytes], window: int) -> list[bytes]:
    """For each text: a bit for each of its windows that a text of a smaller document has, too."""
    sizes, owners, texts = [], [], []
    for x in bodies:
        n = int(np.frombuffer(x[:4], np.uint32)[0])
        sizes.append(n)
        owners.append(np.frombuffer(x, "<i8", n, 4))
        at = 4 + 9 * n
        for length in x[4 + 8 * n : at]:
            texts.append(x[at : at + length])
            at += length
    marks = smaller_owner_windows(texts, np.concatenate(owners), window)
    return [m.astype("<u4").tobytes() for m in R._split(marks, sizes)]


def _answer(window: int):
    def answer(bodies: list[bytes]) -> list[bytes]:
        kind, own = bodies[0][0], [x[1:] for x in bodies]  # a bucket is asked one kind of question
        got = _indexed(own, window) if kind == _TEXT else R.several(own, HOT) if kind == R.ANCHOR else R.smaller(own)
        return [bytes([kind]) + x for x in got]

    return answer


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the bytes of strings that a document of smaller id has too.

    Texts are their UTF-8 bytes; a string is any ``min_bytes`` consecutive ones (from 24
    to 93).  Returns id_col, the columns named in ``keep``, ``n_bytes``, ``n_removed``,
    ``removed`` (maximal spans of removed bytes) and ``kept`` (the other bytes, binary, as
    a cut may fall inside a character).  A null or empty text has no bytes; a very long
    text is a block by itself and needs about 40 times its size in one worker; a row with
    a null id neither covers others nor loses bytes; rows of equal ids don't cover each
    other; an empty table gives an empty one.  Other columns are not carried; a column of
    ``keep`` with the name of a result is replaced by it.

    Contexts and single windows are told apart by 88 bits of hash: among 10**13 of them
    two of a kind differ with a probability of 1 in 6.  Texts in the index are compared as such.
    """
    if not 24 <= min_bytes <= 93:
        raise ValueError("min_bytes is from 24 to 93")
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    rows = docs.select(*columns).withColumn(text_col, F.col(text_col).cast("string"))
    table = blocks(rows, text_col, "suffix", with_anchors(id_col, text_col, min_bytes))
    n, fine = bucket_count(table), bucket_count(table, BUCKET_BYTES)

    def block(batch, got, rounds: int) -> Block:
        b = Block(batch, id_col, text_col, min_bytes)
        if rounds == 1:
            b.find_anchors()
        if rounds > 1:
            b.know_anchors(got.get("anchors", []))
        if rounds > 2:
            b.know_contexts(got.get("contexts", []))
        return b

    def edges(batch, got):
        b = block(batch, got, 3)
        yield from b.ask_texts(fine)
        if len(b.hot):
            yield from ((x + fine, y) for x, y in b.hot_windows().emit(n, _WINDOW))

    one = ask(with_answers(table), lambda batch, got: block(batch, got, 1).ask_anchors(n), R.answer_anchors, "anchors")
    two = ask(with_answers(table, one), lambda batch, got: block(batch, got, 2).ask_contexts(n), _answer(min_bytes), "contexts")
    three = ask(with_answers(table, one, two), edges, _answer(min_bytes), "edges")

    out_columns = [c for c in columns if c == id_col or c in keep]
    schema = with_fields(rows.select(*out_columns).schema, ("n_bytes", "long"), ("n_removed", "long"), ("removed", "array<struct<start:long,end:long>>"), ("kept", "binary"))
    carried = [f.name for f in schema.fields[:-4]]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches):
        for _, batch, got in each_block(batches):
            b = block(batch, got, 3)
            cut = _merged(b.copies(got.get("edges", [])), b.off)
            doc = np.searchsorted(b.off, cut[:, 0], "right") - 1
            bounds = np.searchsorted(doc, np.arange(len(b.off)))
            gone = np.zeros(len(b.data) + 1, np.int8)
            gone[cut[:, 0]] += 1
            gone[cut[:, 1]] -= 1
            stay = np.cumsum(gone[:-1], dtype=np.int8) == 0
            left = np.concatenate(([0], np.cumsum(stay)))[b.off].astype(np.int32)
            n_bytes = np.diff(b.off)
            start, end = cut[:, 0] - b.off[doc], cut[:, 1] - b.off[doc]
            kept = pa.Array.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(left), pa.py_buffer(b.data[stay].tobytes())])
            spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried] + [pa.array(n_bytes), pa.array(n_bytes - np.diff(left)), spans.cast(span_type), kept],
                names=[*carried, "n_bytes", "n_removed", "removed", "kept"],
            )

    return with_answers(table, one, two, three).mapInArrow(finish, schema)


def _merged(spans: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The maximal runs within spans, each in one text."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    doc = np.searchsorted(off, spans[:, 0], "right")
    new = np.flatnonzero(np.concatenate(([True], (spans[1:, 0] > reach[:-1]) | (doc[1:] != doc[:-1]))))
    return np.stack((spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]), 1)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
