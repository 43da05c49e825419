"""Benchmark decontamination by counts of common grams, which lose no copy within the limit.

An edit touches at most q of a text's grams of q bytes.  So of the m - q + 1 grams of an
item of m bytes, a stretch that is at most k edits away keeps all but q * k, and it lies
in m + k bytes.  Texts are divided into bins, and the places at which one of an item's
grams begins are counted for each bin and item; a run of bins that could hold a copy and has
enough of them is a candidate.  Of its grams the item must then find enough, too, which
repeated words don't help, and find them in order: k edits shift places by k at most.
What passes is aligned with the item, and only an edit distance within the limit counts.  Grams are looked up by hash: two that share a slot
add to the counts and never take from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts, tidy, with_fields
from .units import SPACE, U

#: Edits that a copy may have, in hundredths of the item's bytes.
EDITS = 15
#: Bytes of a gram when places are counted, and when the item's grams are sought: both leave items of any length some.
GRAM, FINE = 5, 4
SLOTS = 1 << 20
#: Bytes of a bin, and items that are counted together.
BIN = 32
TOGETHER = 256
#: Grams of an item that a text of its length has so often by chance, or more, are not counted.
COMMON = 0.5
#: Bins that a copy in one candidate may begin in.
JOINED = 16
#: Items under so many bytes are only sought as they are.
LEAST_BYTES = 32
#: Bytes of items that one scan of the documents compares with; further items take further scans.
ITEM_BYTES = 8 << 20
PIECE = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if SPACE[b] else b for b in range(256))


def normal(text: bytes) -> bytes:
    """A-Z in lower case and any white space a blank, byte for byte."""
    return text.translate(_LOWER)


def slots_of(data: np.ndarray, gram: int) -> np.ndarray:
    """The slot of the gram that begins at each byte but the last seven."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))
    return (((eight << U(64 - 8 * gram)) * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int32)


def _own(text: bytes, gram: int) -> np.ndarray:
    return slots_of(np.frombuffer(text + bytes(8), np.uint8), gram)[: len(text) - gram + 1]


class Group:
    """Some items' grams: how many of the items have one in a slot, and which."""

    def __init__(self, which: list[int], texts: list[bytes], limits: list[int]):
        self.which = np.array(which, np.int64)
        self.size, self.limit = np.array([len(t) for t in texts]), np.array(limits)
        self.reach = self.size + self.limit
        self.bins = -(-(self.reach - GRAM) // BIN) + 1
        self.grams: list[np.ndarray] | None = [_own(t, GRAM) for t in texts]

    def choose(self, slot: np.ndarray) -> None:
        """Leave out an item's grams that any text of its length has about COMMON times, by the texts seen first.

        A copy keeps all of the others but GRAM for each edit, so none is lost whatever is left out; such
        grams only add to the counts of other texts.  Half of what must be found stays in any case."""
        often = np.bincount(slot, minlength=SLOTS) / max(1, len(slot))
        least = self.size - GRAM + 1 - GRAM * self.limit
        own = []
        for i, grams in enumerate(self.grams):
            common = often[grams] * self.reach[i]
            order = np.argsort(-common, kind="stable")[: max(0, int(least[i]) // 2)]
            out = order[common[order] >= COMMON]
            least[i] -= len(out)
            own.append(np.unique(np.delete(grams, out)))
        self.least, self.grams = least, None
        slot, item = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.item = item[np.argsort(slot, kind="stable")].astype(np.int32)
        self.n = np.bincount(slot, minlength=SLOTS).astype(np.int32)
        self.first = (np.cumsum(self.n) - self.n).astype(np.int32)
        self.some = self.n > 0

    def candidates(self, slot: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of stretches that hold every copy, from the slots of texts' grams."""
        if self.grams is not None:
            self.choose(slot)
        k, rows = len(self.which), -(-len(slot) // BIN)
        at = np.flatnonzero(self.some[slot])
        n, first = self.n[slot[at]], self.first[slot[at]]
        skip = np.repeat(first - (np.cumsum(n) - n), n)
        cell = np.repeat((at // BIN) * k, n) + self.item[skip + np.arange(len(skip))]
        upto = np.zeros((rows + int(self.bins.max()) + 1, k), np.int32)
        upto[1 : rows + 1] = np.bincount(cell, minlength=rows * k).reshape(rows, k)
        np.cumsum(upto, axis=0, out=upto)
        for w in np.unique(self.bins).tolist():
            of = np.flatnonzero(self.bins == w)
            some = upto if len(of) == k else upto[:, of]
            i, b = np.nonzero((some[w : w + rows] - some[:rows] >= self.least[of]).T)
            cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(b) > 1) | (np.diff(b // JOINED) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True):
                if lo < hi:
                    j = of[i[lo]]
                    yield int(self.which[j]), int(b[lo]) * BIN, (int(b[hi - 1]) + 1) * BIN + int(self.reach[j])


class Items:
    """Benchmark items, and the grams of those that are sought with edits."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts = [normal(t).strip(b" ") for _, t in items]
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < LEAST_BYTES]
        by_size = sorted((k for k, t in enumerate(self.texts) if len(t) >= LEAST_BYTES), key=lambda k: len(self.texts[k]))
        self.fine = {k: _own(self.texts[k], FINE) for k in by_size}
        self.places = {k: np.argsort(own, kind="stable") for k, own in self.fine.items()}
        self.groups = []
        for lo in range(0, len(by_size), TOGETHER):
            which = by_size[lo : lo + TOGETHER]
            self.groups.append(Group(which, [self.texts[k] for k in which], [self.limit(k) for k in which]))

    def limit(self, k: int) -> int:
        return len(self.texts[k]) * EDITS // 100 if len(self.texts[k]) >= LEAST_BYTES else 0

    def in_order(self, k: int, seen: np.ndarray) -> bool:
        """Whether enough of item k's grams lie in a stretch of text, by its grams' slots, with shifts that differ by its limit at most.

        Shifts are taken in ranges of limit + 1, each with the next one, so none that fits is lost."""
        place, width = self.places[k], self.limit(k) + 1
        own = self.fine[k][place]
        first = np.searchsorted(own, seen)
        n = np.searchsorted(own, seen, "right") - first
        at = np.repeat(np.arange(len(seen)), n)
        i = place[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first, n)]
        shift = (at - i + len(own)) // width
        key = np.unique(np.concatenate((shift, shift + 1)) * len(own) + np.concatenate((i, i)))
        return len(key) > 0 and int(np.bincount(key // len(own)).max()) >= len(own) - FINE * self.limit(k)

    def align(self, k: int, text: bytes) -> tuple[int, int, int] | None:
        """(edits, start, end) of the stretch of text closest to item k, if within its limit."""
        item = self.texts[k]
        edits, end = _closest(item, text, False)
        if edits > self.limit(k):
            return None
        _, back = _closest(item[::-1], text[:end][::-1], True)
        return edits, end - back, end


def _closest(pattern: bytes, text: bytes, anchored: bool) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of text, and where this ends (bit-parallel).

    The stretch begins at the text's start if anchored, else anywhere."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | (1 if anchored else 0)) & full
        mh = mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def leaks_in(items: Items, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of every item that a text holds, its closest place."""
    begin = np.cumsum([0] + [len(d) + 1 for d in docs])
    joined = b"\0".join(docs) + bytes(8)
    data = np.frombuffer(joined, np.uint8)
    slot, fine = slots_of(data, GRAM), slots_of(data, FINE)
    here = np.zeros(SLOTS, bool)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for group in items.groups:
        for k, start, end in group.candidates(slot):
            own, seen = items.fine[k], fine[start:end]
            here[seen] = True
            kept = np.count_nonzero(here[own])
            here[seen] = False
            if kept < len(own) - FINE * items.limit(k) or not items.in_order(k, seen):
                continue
            least = len(items.texts[k]) - items.limit(k)
            for doc in range(int(np.searchsorted(begin, start, "right")) - 1, int(np.searchsorted(begin[:-1], end))):
                at = int(begin[doc])
                lo, hi = max(start, at), min(end, at + len(docs[doc]))
                if hi - lo >= least and (got := items.align(k, joined[lo:hi])) and ((doc, k) not in best or got[0] < best[doc, k][2]):
                    best[doc, k] = (lo - at + got[1], lo - at + got[2], got[0])
    for k in items.short:
        for doc, text in enumerate(docs):
            x = text.find(items.texts[k])
            if x >= 0:
                best[doc, k] = (x, x + len(items.texts[k]), 0)
    for (doc, k), (x, y, edits) in sorted(best.items()):
        yield doc, k, x, y, edits


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items that documents hold: id_col, ``item``, ``start``, ``end`` and ``edits``.

    An item is held if a stretch of the text has at most EDITS hundredths of the item's
    bytes as edit distance, case and kind of white space aside; the closest place is
    returned, in bytes.  Items under LEAST_BYTES bytes count only as they are.  Null or
    empty texts and items hold and are nothing; a null id stays null; repeated items
    each give their rows and repeated documents too; a very long text is read whole, in one
    worker, in slices of PIECE bytes that overlap by the longest item's reach, each of which
    takes about 60 times its size; empty tables give an empty result.
    Other columns are not carried.
    """
    rows = small_batches(docs).select(id_col, F.col(text_col).cast("string").alias("_text"))
    schema = with_fields(rows.select(id_col).schema, ("item", "long"), ("start", "long"), ("end", "long"), ("edits", "int"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _item_scans(items, item_id, item_text):
        out = out.unionByName(rows.mapInArrow(_finder(shared, id_col), schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item; see ``leaks``."""
    at = small_batches(docs).columns.index(text_col)

    def dropper(shared):
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in tidy(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _found(items, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return drop

    for shared in _item_scans(items, item_id, item_text):
        docs = docs.mapInArrow(dropper(shared), docs.schema)
    return docs


def _item_scans(items: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcasts of the items, of bounded size each."""
    spark = items.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).filter("id is not null and length(trim(t)) > 0")
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    scans = max(1, -(-2 * total // ITEM_BYTES))  # by hash, so twice as many as an even split needs
    for scan in range(scans):
        part = asked.filter(F.pmod(F.xxhash64("id", "t"), F.lit(scans)) == scan).collect()  # about ITEM_BYTES / 2
        if part:
            yield spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in part])


def _slices(n: int, reach: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of a text's slices: any stretch of reach bytes lies whole in one."""
    size = max(PIECE, 4 * reach)
    for start in range(0, max(n, 1), size):
        yield start, min(n, start + size + reach)
        if start + size + reach >= n:
            return


def _found(items: Items, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) in a column of texts."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    held: list[bytes] = []
    where: list[tuple[int, int]] = []
    size, reach = 0, max((len(t) + items.limit(k) for k, t in enumerate(items.texts)), default=0) + BIN

    def flush() -> None:
        for d, k, x, y, edits in leaks_in(items, held):
            row, start = where[d]
            if (row, k) not in best or edits < best[row, k][2]:
                best[row, k] = (start + x, start + y, edits)
        held.clear()
        where.clear()

    for i, text in enumerate(texts(column)):
        for start, end in _slices(len(text or b""), reach):
            if held and size + end - start > PIECE:
                flush()
                size = 0
            held.append(normal(text[start:end]) if text else b"")
            where.append((i, start))
            size += end - start
    flush()
    return [(row, k, x, y, edits) for (row, k), (x, y, edits) in sorted(best.items())]


def _finder(shared, id_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in tidy(batches):
            if found := _found(items, batch.column(1)):
                row, k, x, y, e = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array([items.ids[j] for j in k], pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(e, pa.int32())],
                    names=[id_col, "item", "start", "end", "edits"],
                )

    return find


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.col("item").alias("item_id"), "start", "end", "edits")
