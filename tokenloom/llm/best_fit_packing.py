"""Packing documents into sequences by a configuration linear program.

A configuration is a way to fill one sequence with lengths.  The program asks for
the fewest configurations that cover the histogram of lengths.  It is solved by
multiplicative weights: lengths that are behind weigh more, and the best
configuration under the weights is priced by a knapsack dynamic program.  The
fractional solution is scaled down and rounded down, the rest is solved again, and
what too few pieces are left for is placed by best fit.  Only the histogram, which
has one row for each possible length, reaches the driver; pieces find their place
from their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, texts, tidy, with_fields, written
from .token_counts import byte_alphabet

CAPACITY = 1024
END_ID = 2
#: Rounds of weights for one solution, and solutions of what rounding leaves.
ROUNDS = 60
SOLUTIONS = 5
#: Further solutions are left when one places less than this share of its pieces.
LEAST_PROGRESS = 0.05
#: Configurations that one pricing may give: those within PRICE_SLACK of the best.
PRICED = 200
PRICE_SLACK = 0.1
#: Longer pieces are harder to place; at first they weigh a little more than their length.
POWER = 1.05

#: Texts of these characters alone are merged by tiktoken: no Unicode version disagrees on their classes.
_LATIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: Fixed value: the pre-tokenizer's pattern for byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(path: str) -> dict[bytes, int]:
    """Ids by bytes, if ids follow the order of the merges, so that they can stand for these; else nothing."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, splitter = file["model"], file.get("pre_tokenizer") or {}
    if file.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return {}
    back = byte_alphabet()
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if order != sorted(order) or model.get("ignore_merges"):
        return {}
    return {bytes(back[c] for c in t): i for t, i in model["vocab"].items()}


class Encoder:
    """A byte-level tokenizer's ids.

    A text in Latin letters is merged by tiktoken, whose result is the same for the
    same vocabulary and faster; any other text goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(path)
        self.fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or not _LATIN(text) or any(x in text for x in self.special):
            return self.whole(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with its task and its rank among the task's pieces of its length."""
    rows = small_batches(docs).select(id_col, F.col(text_col).cast("string").alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    schema = with_fields(rows.select(id_col).schema, ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "int"), ("rank", "long"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder = TaskContext.get().partitionId(), Encoder(tokenizer)
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in tidy(batches):
            out: list[tuple] = []
            row: list[int] = []
            for i, text in enumerate(texts(batch.column(1))):
                ids = encoder.encode((text or b"").decode("utf-8", "replace")) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, int(ranks[length])))
                    ranks[length] += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return rows.mapInArrow(encode, schema)


def knapsack(value: np.ndarray, capacity: int, most: np.ndarray) -> list[dict[int, int]]:
    """The most valuable configuration, and others close to it that begin with other lengths.

    A length is used at most most[l] times.  One dynamic program prices them all."""
    lengths = np.flatnonzero((value > 0) & (most > 0))
    best, pick, v = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), value[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            option = best[c - lengths[:n]] + v[:n]
            k = n - 1 - int(option[::-1].argmax())  # the longest of equals
            if option[k] > best[c]:
                best[c], pick[c] = option[k], lengths[k]
    begun = v + best[capacity - lengths]
    good = np.flatnonzero(begun >= (1 - PRICE_SLACK) * best[capacity])
    out = {}
    for l in lengths[good[::-1][:PRICED]].tolist():
        got, c, room = {l: 1}, capacity - l, capacity - l
        while c > 0:
            p = int(pick[c])
            if p == 0:
                c -= 1
                continue
            if got.get(p, 0) < most[p]:
                got[p] = got.get(p, 0) + 1
                room -= p
            c -= p
        for i in range(upto[room] - 1, -1, -1):  # use up what is left
            p = int(lengths[i])
            if p <= room and (n := min(room // p, int(most[p]) - got.get(p, 0))) > 0:
                got[p] = got.get(p, 0) + n
                room -= n * p
            if not room:
                break
        out[tuple(sorted(got.items()))] = got
    return list(out.values())


def solve(left: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional counts that cover no length more than it occurs."""
    size = np.arange(capacity + 1)
    weight = (size / capacity) ** POWER * (left > 0)
    covered = np.zeros(capacity + 1)
    found: dict[tuple, float] = {}
    packed, volume = 0.0, float((left * size).sum())
    for _ in range(rounds):
        for c in knapsack(weight, capacity, left):
            step = min(left[l] / k for l, k in c.items()) / 8
            key = tuple(sorted(c.items()))
            found[key] = found.get(key, 0) + step
            for l, k in c.items():
                covered[l] += step * k / left[l]
                weight[l] *= np.exp(-0.05 * step * k / left[l])
                packed += step * k * l
        if packed >= volume:
            break
    return [(dict(c), x / max(1.0, max(covered[l] for l, _ in c))) for c, x in found.items()]


def rounded(left: np.ndarray, capacity: int, full: bool) -> list[tuple[dict[int, int], int]]:
    """Configurations, all full ones if so wanted, of solutions scaled and rounded; takes their pieces from left."""
    out = []
    for _ in range(SOLUTIONS):
        before = left.sum()
        if not before:
            break
        for c, x in sorted(solve(left, capacity), key=lambda y: (-max(y[0]), -y[1])):
            # a fraction of at least a half is one, as with few pieces all are fractions
            n = int(min([max(x, round(x)), *(left[l] // k for l, k in c.items())]))
            if n > 0 and (not full or sum(l * k for l, k in c.items()) == capacity):  # others waste room for good
                out.append((c, n))
                for l, k in c.items():
                    left[l] -= n * k
        if before - left.sum() < LEAST_PROGRESS * before:
            break
    return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often) of sequences that hold every piece once; histogram[l] pieces have length l.

    The program's full configurations come first, and best fit places what rounding leaves;
    then its configurations with room, too, as for common lengths that no others complete.
    Of plans with equally many sequences that with most from the program counts.  All this
    is done at every size; best fit alone counts only if it needs strictly fewer."""
    left, out = histogram.astype(np.int64).copy(), []
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    alone = best_fit(left, capacity)
    made = rounded(left, capacity, True)
    full = made + best_fit(left, capacity)
    made = made + rounded(left, capacity, False)
    return out + min((made + best_fit(left, capacity), full, alone), key=lambda made: sum(n for _, n in made))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each piece to the fullest sequence that has room; sequences of equal content are held as one with their number."""
    open_: list[int] = []  # rooms, each once
    held: dict[int, list[tuple[dict[int, int], int]]] = {}
    out: list[tuple[dict[int, int], int]] = []

    def put(room: int, c: dict[int, int], n: int) -> None:
        if not room:
            out.append((c, n))
            return
        if room not in held:
            insort(open_, room)
        held.setdefault(room, []).append((c, n))

    for l in np.flatnonzero(left)[::-1].tolist():
        n = int(left[l])
        while n:
            i = bisect_left(open_, l)
            room, c, same = capacity, {}, n
            if i < len(open_):
                room = open_[i]
                c, same = held[room].pop()
                if not held[room]:
                    del held[room], open_[i]
            k = min(n, room // l)
            used = min(same, n // k)
            if same > used and c:
                put(room, c, same - used)
            put(room - k * l, c | {l: k}, used)
            n -= used * k
    return out + [x for room in open_ for x in held[room]]


class Places:
    """The plan by length: which sequence and offset has the piece of a length with a rank."""

    def __init__(self, made: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for c, n in made:
            offset = 0
            for l, k in sorted(c.items(), reverse=True):
                rows.setdefault(l, []).append((used.get(l, 0), k, sequence, offset))
                used[l] = used.get(l, 0) + n * k
                offset += l * k
            sequence += n
        self.sequences = sequence
        self.rows = {l: np.array(r, np.int64).T for l, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for l in np.unique(length).tolist():
            at = np.flatnonzero(length == l)
            first, k, seq, off = self.rows[l]
            j = np.searchsorted(first, rank[at], "right") - 1
            i = rank[at] - first[j]
            sequence[at], offset[at] = seq[j] + i // k[j], off[j] + i % k[j] * l
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces and packed into sequences of ``capacity``.

    Returns id_col, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``, a row for each piece.  A null or empty text is ``end_id`` alone.  Only
    documents over the capacity are cut, however long they are; their first piece may be short.  Repeated rows
    and null ids are packed like others; an empty table gives an empty one; other
    columns are not carried.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    by_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = np.zeros(capacity + 1, np.int64)
    for l, n in table.groupBy("length").count().collect():  # at most capacity rows
        histogram[l] = n
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))  # bounded by capacity and rounds
    ranked = table.join(base, ["length", "task"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    schema = with_fields(table.select(id_col, "piece", "start", "length", "ids_crc32").schema, ("sequence_id", "long"), ("offset", "long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return ranked.mapInArrow(place, schema)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
