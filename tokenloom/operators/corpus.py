"""Building a corpus: documents are encoded once, their ids packed into shards, and shards written in order.

Ids are made by an encoder that a worker loads once, in Arrow batches, and kept as bytes
(two for each id) in a table in the shared folder.  Packing plans on numbers of ids; a
piece of a document is a slice of its bytes.  A text that can't be encoded becomes a row
with its error, not an exception that ends the job or the reading."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts
from ..functions.inject import inject as inject_facts
from ..sources.scratch import written
from .pack import ID_BYTES, batches, pack, with_batches, with_split
from .pack import batch_rows as rows_of_batches

#: Letters of a long text that are encoded at a time with others.
SLAB = 1 << 20
FACT = re.compile(r"<MUL_([0-9]+)_([0-9]+)_([0-9]+)>")
END_OF_TEXT = "<|endoftext|>"


class Encoder:
    """Ids of texts: ``start`` gives a function of a list of texts, made once in a worker."""

    #: What the encoder can't take, or None.
    refused: str | None = None

    def start(self) -> Callable[[list[str]], list]:
        raise NotImplementedError


class Bytes(Encoder):
    """The bytes of a text in UTF-8."""

    def start(self):
        return lambda texts: [np.frombuffer(t.encode(), np.uint8) for t in texts]


class Library(Encoder):
    """A file of the tokenizers library (.json), or ranks of byte-level BPE (.tiktoken) with the pattern that cuts words.

    A text with the end marker's string is refused, or with special="text" read as ordinary text."""

    def __init__(self, path: str, pattern: str | None = None, special: str = "refuse"):
        if special not in ("refuse", "text"):
            raise ValueError('special is "refuse" or "text"')
        self.path, self.pattern, self.refused = path, pattern, END_OF_TEXT if special == "refuse" else None

    def start(self):
        if self.path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [coding.encode_ordinary(t) for t in texts]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_started: dict[tuple, Callable] = {}


def _of_worker(encoder: Encoder) -> Callable[[list[str]], list]:
    """The encoder's function, loaded once for each worker and file."""
    key = (type(encoder), *sorted(vars(encoder).items(), key=str))
    if key not in _started:
        _started[key] = encoder.start()
    return _started[key]


def fact_of(match: re.Match) -> int | None:
    """The id of a token whose numbers are a fact, in whatever order its operands stand."""
    if max(map(len, match.groups())) > 18:
        return None
    a, b, c = map(int, match.groups())
    if not (facts.LEAST <= min(a, b) and max(a, b) <= facts.MOST and a * b == c):
        return None
    low, high = min(a, b), max(a, b)
    return facts.FIRST_ID + (low - 1) * facts.MOST - (low - 1) * (low - 2) // 2 + high - low


def parts_of(text: str, with_facts: bool) -> Iterator[str | int]:
    """Stretches of a text and the ids of facts between them, in order; a token that is no fact is text like the rest."""
    last = 0
    for m in FACT.finditer(text) if with_facts and "<MUL_" in text else ():
        number = fact_of(m)
        if number is not None:
            yield text[last : m.start()]
            yield number
            last = m.end()
    yield text[last:]


def ids_of(encode: Callable, texts: list[str], with_facts: bool) -> tuple[list[np.ndarray], list[int]]:
    """Ids of texts after an end marker each, and how many of them are facts; a long text's stretches go through by themselves."""
    plans = [list(parts_of(t, with_facts)) for t in texts]
    found: dict[tuple[int, int], np.ndarray] = {}
    held: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        for key, ids in zip(held, encode([plans[i][j] for i, j in held]), strict=True):
            array = np.asarray(ids, np.uint32)
            if len(array) and array.max() >= 1 << 8 * ID_BYTES:
                raise ValueError(f"id {array.max()} does not fit in {8 * ID_BYTES} bits")
            found[key] = array.astype("<u2")
        held.clear()

    for i, plan in enumerate(plans):
        for j, part in enumerate(plan):
            if isinstance(part, str) and part:
                if held and size + len(part) > SLAB:
                    flush()
                    size = 0
                held.append((i, j))
                size += len(part)
    flush()
    marker = np.array([facts.EOT], "<u2")
    out = [np.concatenate([marker, *[np.array([part], "<u2") if isinstance(part, int) else found[i, j] for j, part in enumerate(plan) if part != ""]]) for i, plan in enumerate(plans)]
    return out, [sum(isinstance(part, int) for part in plan) for plan in plans]


def encoded(docs: DataFrame, encoder: Encoder | None = None, condition: str = "facts", inject: bool = True, order: str = "doc_id", text: str = "text") -> DataFrame:
    """order, ``row``, ``n``, ``facts``, ``ids`` and ``error`` of every document, kept in the shared folder.

    ids are an end marker and the text's, ID_BYTES little-endian bytes each; n counts them.
    A null text is an empty one.  A text that the encoder refuses or fails on has no ids,
    n of 0 and an error.  row numbers rows in the order in which they were read, so rows of
    one order stay apart."""
    if condition not in ("facts", "baseline"):
        raise ValueError('condition is "facts" or "baseline"')
    encoder, with_facts = encoder or Bytes(), condition == "facts"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(order), F.monotonically_increasing_id().alias("row"), (inject_facts(body) if inject and with_facts else body).alias("text"))
    kind = rows.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _of_worker(encoder)
        for batch in batches:
            texts = [t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in batch.column(2)]
            errors: list[str | None] = [f"the text holds {encoder.refused}" if encoder.refused and encoder.refused in t else None for t in texts]
            good = [i for i, e in enumerate(errors) if e is None]
            ids: list[np.ndarray | None] = [None] * len(texts)
            count = [0] * len(texts)
            try:
                for i, found, n in zip(good, *ids_of(encode, [texts[i] for i in good], with_facts), strict=True):
                    ids[i], count[i] = found, n
            except Exception:  # of one of them: each by itself
                for i in good:
                    try:
                        (ids[i],), (count[i],) = ids_of(encode, [texts[i]], with_facts)
                    except Exception as e:
                        errors[i] = f"{type(e).__name__}: {e}"[:500]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.array(count, pa.int32()), pa.array([None if x is None else x.tobytes() for x in ids], pa.binary()), pa.array(errors, pa.string())],
                names=[order, "row", "n", "facts", "ids", "error"],
            )

    return written(rows.mapInArrow(run, f"`{order}` {kind}, row long, n long, facts int, ids binary, error string"), "ids")


def _packable(ids: DataFrame, shard_size: int, order: str, synthetic: DataFrame | None) -> DataFrame:
    """Rows without an error, and the synthetic one if it is shorter than a shard."""
    good = ids.filter("error is null").select(order, "row", "n", "facts", "ids").withColumn("_first", F.lit(1))
    if synthetic is None:
        return good
    prefix = synthetic.filter(F.col("n") < shard_size).withColumn(order, F.lit(-1).cast(ids.schema[order].dataType))
    return good.unionByName(prefix.select(order, F.lit(-1).cast("bigint").alias("row"), "n", "facts", "ids").withColumn("_first", F.lit(0)))


def places_of(ids: DataFrame, shard_size: int, target: int, val_shards: int = 1, order: str = "doc_id", synthetic: DataFrame | None = None) -> DataFrame:
    """The pieces of ``pieces_of`` without their ids, from numbers of ids alone, kept in the shared folder; row tells whose they are."""
    good = _packable(ids, shard_size, order, synthetic)
    plan = with_split(pack(good.select("_first", order, "row", "n"), shard_size, target, order, ties=("_first", "row")), val_shards)
    return written(plan.select(order, "row", "split", "shard", "piece_start", "shard_offset", "doc_offset", "length"), "places")


def with_ids(places: DataFrame, ids: DataFrame, shard_size: int, order: str = "doc_id", synthetic: DataFrame | None = None) -> DataFrame:
    """Places with the facts of the whole document and their ids; ids are sent once, and not sorted."""
    whole = _packable(ids, shard_size, order, synthetic).select("row", "facts", F.col("ids").alias("_ids"))
    part = F.substring(F.col("_ids"), (F.col("doc_offset") * ID_BYTES + 1).cast("int"), (F.col("length") * ID_BYTES).cast("int"))
    return places.hint("shuffle_hash").join(whole, "row").select(*[c for c in places.columns if c != "row"], "facts", part.alias("ids"))


def pieces_of(ids: DataFrame, shard_size: int, target: int, val_shards: int = 1, order: str = "doc_id", synthetic: DataFrame | None = None) -> DataFrame:
    """Pieces of shards from a table of ids: order, split, shard, piece_start, shard_offset, doc_offset, length, facts and ids.

    facts are those of the whole document.  synthetic, a table of ids of one row, comes first
    if it is shorter than a shard; it is no document, its order is -1.  Rows with an error take no part."""
    return with_ids(places_of(ids, shard_size, target, val_shards, order, synthetic), ids, shard_size, order, synthetic)


def batch_rows(ids: DataFrame, shard_size: int, batch: int, length: int, ranks: int, order: str = "doc_id") -> DataFrame:
    """Every row of every batch of the shards of a table of ids; batches are planned on numbers of ids, before ids are sent."""
    places = places_of(ids, shard_size, 1 << 60, order=order)
    plan = batches(places.groupBy("shard").agg(F.sum("length").alias("size")), batch, length, ranks)
    planned = written(with_batches(places.select("row", "shard", "shard_offset", "doc_offset", "length"), plan, batch, length), "batches")
    return rows_of_batches(with_ids(planned, ids, shard_size, order), None, batch, length, tokens="ids")


def build(docs: DataFrame, shard_size: int, target: int | None, val_shards: int = 1, encoder: Encoder | None = None, condition: str = "facts", order: str = "doc_id", text: str = "text", synthetic: DataFrame | None = None) -> DataFrame:
    """Documents to pieces of shards, each text encoded once; a synthetic text (one row) is treated like them.

    A budget of target ids stops the reading: see ``up_to``; None is none."""
    first = encoded(synthetic.select(F.lit(-1).cast("bigint").alias(order), text), encoder, condition, True, order, text) if synthetic is not None else None
    whole = lambda d: encoded(d, encoder, condition, True, order, text)
    ids = whole(docs) if target is None else up_to(docs, target, whole, order)
    return pieces_of(ids, shard_size, 1 << 60 if target is None else target, val_shards, order, first)


#: The first slice of a table that a budget reads is one in so many rows; each further one doubles what is read.
SLICES = 1024


def up_to(docs: DataFrame, target: int, encode: Callable[[DataFrame], DataFrame], order: str = "doc_id") -> DataFrame:
    """encode of as many documents, in order, as hold target ids; at most about twice as many are read.

    Slices of the order column, each as large as all before it, are read one after another
    until their ids reach the target: their bounds are approximate quantiles, and filters on
    them reach the scan.  Rows without an order come first."""
    fractions = [1.0]
    while fractions[0] * SLICES > 1:
        fractions.insert(0, fractions[0] / 2)
    cuts = docs.agg(F.percentile_approx(order, fractions[:-1], 100 * SLICES)).first()[0] or []
    done, total, low = [], 0, None
    for high in [*sorted(set(cuts)), None]:
        # the last slice takes what is above all cuts
        above = F.lit(True) if low is None else F.col(order) > F.lit(low)
        below = F.lit(True) if high is None else F.col(order) <= F.lit(high)
        some = docs.filter(above & below if low is not None else below | F.col(order).isNull())
        part = encode(some)
        done.append(part.withColumn("row", F.col("row") + (len(done) << 56)) if "row" in part.columns else part)
        total += part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if total >= target:
            break
        low = high
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def unpacked(pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """Pieces with their ids as array<int>."""
    names = [c for c in pieces.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names)).fill_null(b"")
            sizes = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2] or b"", "<u2", count=(sizes[-1] - sizes[0]) // ID_BYTES, offset=sizes[0]) if len(column) and sizes[-1] > sizes[0] else np.zeros(0, "<u2")
            lists = pa.ListArray.from_arrays(pa.array((sizes - sizes[0]) // ID_BYTES, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], names=[*names, ids])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != ids)
    return pieces.select(*names, ids).mapInArrow(run, f"{types}, `{ids}` array<int>")
