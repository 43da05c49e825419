"""Packing an ordered stream of documents into shards, and batches of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import facts
from .tokenize import encode

#: Least and greatest number of ranges of an order column; in between, four for each shuffle partition.
#: The greatest is what one expression can look up; rows of a range are spilled by the window, not held.
LEAST_RANGES, MOST_RANGES = 64, 4096
#: Bytes of an id where ids are kept as bytes, and ids of rows that a worker sends at a time.
ID_BYTES, SENT = 2, 1 << 18


def _range_of(order: Column, cuts: list) -> Column:
    """How many of the sorted cuts are under order: first among every k-th, then among the k from there."""
    k = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    under = lambda array: F.size(F.filter(array, lambda c: c < order))
    array = lambda values: F.array(*[F.lit(v) for v in values])
    coarse = F.greatest(under(array([g[0] for g in groups])) - 1, F.lit(0))
    return coarse * k + under(F.element_at(F.array(*[array(g) for g in groups]), coarse + 1))


def prefix_sum(rows: DataFrame, order: str, value: str, out: str = "start", buckets: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The sum of value over all rows before, by a numeric order column; further columns order its ties.

    A null value adds nothing, a row without an order comes first.

    A window over everything is one task.  Instead rows fall into ranges of the order
    column, cut at approximate quantiles: sums of ranges are a few rows, their prefix
    sums join back, and windows run within ranges only."""
    n = buckets or min(MOST_RANGES, max(LEAST_RANGES, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * MOST_RANGES)).first()[0] or []
    cuts = sorted(set(cuts))
    placed = rows.withColumn("_range", _range_of(F.col(order), cuts) if cuts else F.lit(0))
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(base), "_range")  # at most MOST_RANGES rows
    return joined.withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("bigint")).drop("_range", "_base")


def document_ids(text: Column, condition: str = "facts", inject: bool = True) -> Column:
    """The end marker, then the document's ids, with facts injected if the condition asks for them."""
    from ..functions.inject import inject as inject_facts

    text = F.coalesce(text, F.lit(""))  # a document without a text is an empty one
    body = inject_facts(text) if inject and condition == "facts" else text
    return F.concat(F.array(F.lit(facts.EOT)), encode(body, condition))


def with_synthetic(docs: DataFrame, synthetic: DataFrame, shard_size: int, order: str = "doc_id", n: str = "n") -> DataFrame:
    """docs after the synthetic prefix (one row, order -1) if that is shorter than a shard; it is no document."""
    marked = docs.withColumn("is_document", F.lit(True))
    return marked.unionByName(synthetic.filter(F.col(n) < shard_size).withColumn(order, F.lit(-1).cast(docs.schema[order].dataType)).withColumn("is_document", F.lit(False)), allowMissingColumns=True)


def pack(docs: DataFrame, shard_size: int, target: int, order: str = "doc_id", n: str = "n", buckets: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of documents in shards: order, shard, piece_start (place in the stream), length, shard_offset, doc_offset.

    A document is kept if it starts before the target; the last one is finished, but
    cut at the first end of a shard from the target on.  Long documents span shards; those
    of no or unknown size have no place in any.  Documents of one order need ties to tell them apart."""
    sized = docs.withColumn(n, F.coalesce(F.col(n), F.lit(0)))
    s = prefix_sum(sized, order, n, "start", buckets, ties).filter(F.col("start") < target)
    end = F.lit(-(-target // shard_size) * shard_size)
    s = s.withColumn("stop", F.least(F.col("start") + F.col(n), end)).filter("stop > start")
    shards = F.sequence(F.floor(F.col("start") / shard_size), F.floor((F.col("stop") - 1) / shard_size))
    p = s.withColumn("shard", F.explode(shards))
    low = F.greatest(F.col("start"), F.col("shard") * shard_size)
    high = F.least(F.col("stop"), (F.col("shard") + 1) * shard_size)
    return p.withColumn("piece_start", low).withColumn("length", high - low).withColumn("shard_offset", low - F.col("shard") * shard_size).withColumn("doc_offset", low - F.col("start")).drop("stop")


def with_split(pieces: DataFrame, val_shards: int = 1) -> DataFrame:
    return pieces.withColumn("split", F.when(F.col("shard") < val_shards, "val").otherwise("train"))


def shards(pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """One row for each shard with its tokens in order; a shard is of bounded size."""
    part = F.slice(ids, F.col("doc_offset").cast("int") + 1, F.col("length").cast("int"))
    cut = pieces.withColumn("_part", F.struct("shard_offset", part.alias("ids")))
    keys = [c for c in ("split", "shard") if c in pieces.columns]
    return cut.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["ids"])).alias("tokens"))


def split_totals(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("split").agg(F.countDistinct("shard").alias("shards"), F.sum("length").alias("tokens"))


def corpus_totals(pieces: DataFrame, order: str = "doc_id", fact_tokens: str | None = None) -> DataFrame:
    """One row: tokens, documents and shards; fact tokens count for whole documents, cut or not, with their ratio.

    A synthetic prefix (order -1) is no document, but its tokens count."""
    whole = pieces.filter("doc_offset = 0")
    counted = whole.agg(F.count_if(F.coalesce(F.col(order) != -1, F.lit(True))).alias("documents"), (F.coalesce(F.sum(fact_tokens), F.lit(0)) if fact_tokens else F.lit(0)).cast("bigint").alias("facts"))
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("tokens"), F.countDistinct("shard").alias("shards"))
    return total.crossJoin(counted).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("facts") / F.col("tokens")).otherwise(0.0))


def batches(shard_sizes: DataFrame, batch: int, length: int, ranks: int, shard: str = "shard", size: str = "size") -> DataFrame:
    """The batches of one epoch: shard, rank, step in the shard, position.

    A rank begins at batch * length * rank and moves on by all ranks' tokens; a shard's
    rest that is too short for all ranks is left out.  Its first batch is always
    taken, so shards too short even for that are reported by ``short_shards``."""
    block = batch * length
    each = shard_sizes.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    most = F.greatest(F.lit(0), F.floor((F.col(size) - 1 - block * F.col("rank")) / F.lit(block * ranks)) - 1)
    steps = each.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), most.cast("bigint"))))
    return steps.withColumn("position", block * (F.col("rank") + F.col("step") * ranks)).filter(F.col("position") + block + 1 <= F.col(size))


def short_shards(shard_sizes: DataFrame, batch: int, length: int, ranks: int, size: str = "size") -> DataFrame:
    return shard_sizes.filter(F.col(size) < batch * length * ranks + 1)


def with_batches(pieces: DataFrame, plan: DataFrame, batch: int, length: int, shard: str = "shard") -> DataFrame:
    """Pieces (shard, shard_offset, length) with ``batches``: block, rank and step of each batch of the plan that they hold ids of.

    Ids take no part.  A piece that no batch needs is left out."""
    block, at = batch * length, F.col("shard_offset")
    # an id at the end of a row is the last one of the row before it, too
    blocks = F.sequence(F.floor(F.greatest(F.lit(0), at - 1) / block), F.floor((at + F.col("length") - 1) / block))
    each = pieces.filter("length > 0").withColumn("_block", F.explode(blocks))
    asked = plan.filter(F.col("position") % block == 0).select(shard, F.floor(F.col("position") / block).alias("_block"), "rank", "step")
    found = F.struct(F.col("_block").alias("block"), "rank", "step")
    # the batches of a few shards look small to the planner and are many, so they aren't to be broadcast
    return each.join(asked.hint("merge"), [shard, "_block"]).groupBy(*pieces.columns).agg(F.array_sort(F.collect_list(found)).alias("batches"))


def batch_rows(packed: DataFrame, plan: DataFrame | None, batch: int, length: int, shard: str = "shard", tokens: str = "tokens") -> DataFrame:
    """x and y of every row of every batch: length tokens, and those one further.

    packed has whole shards, or pieces of them with their ``shard_offset``; tokens are arrays, or bytes
    of two for each id.  A row that lies within a piece is cut from it where the piece stands; only
    parts of rows that reach over the ends of pieces are sent.  Pieces may have their ``batches``
    (see ``with_batches``), then no plan is needed."""
    offset = F.col("shard_offset") if "shard_offset" in packed.columns else F.lit(0)
    held = ["batches"] if "batches" in packed.columns else []
    pieces = packed.select(F.col(shard).alias("shard"), offset.cast("bigint").alias("shard_offset"), F.col(tokens).alias("ids"), *held)
    kind = pieces.schema["ids"].dataType
    as_bytes = isinstance(kind, BinaryType)
    n = F.floor(F.octet_length("ids") / ID_BYTES) if as_bytes else F.size("ids").cast("bigint")
    pieces = pieces.filter(n > 0)
    if not held:
        found = with_batches(pieces.select("shard", "shard_offset", n.alias("length")), plan.withColumnRenamed(shard, "shard"), batch, length)
        pieces = pieces.join(found.drop("length"), ["shard", "shard_offset"])

    low, high, at = F.col("shard_offset"), F.col("shard_offset") + n, F.col("at")
    over = F.filter(F.sequence(F.floor(F.greatest(F.lit(0), low - 1) / length), F.floor((high - 1) / length)), lambda r: (r * length < low) | (r * length + length + 1 > high))
    first, last = F.greatest(at * length, low), F.least(at * length + length + 1, high)
    cut = F.substring(F.col("ids"), ((first - low) * ID_BYTES + 1).cast("int"), ((last - first) * ID_BYTES).cast("int")) if as_bytes else F.slice("ids", (first - low + 1).cast("int"), (last - first).cast("int"))
    asked = F.filter("batches", lambda b: b["block"] == F.floor(at / batch))
    parts = pieces.withColumn("at", F.explode(over)).select("shard", "at", asked.alias("batches"), F.struct(first.alias("low"), cut.alias("ids")).alias("part")).filter(F.size("batches") > 0)
    put = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])  # length + 1 ids in all
    whole = F.aggregate(put, F.lit(b""), lambda a, x: F.concat(a, x)) if as_bytes else F.flatten(put)
    rows = parts.groupBy("shard", "at").agg(whole.alias("ids"), F.first("batches").alias("batches")).filter(n == length + 1)
    every = pieces.select("shard", "shard_offset", "ids", "batches").unionByName(rows.select("shard", (at * length).alias("shard_offset"), "ids", "batches"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            lists, ids = b.column(3), b.column(2)
            if as_bytes:
                ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
                flat = np.frombuffer(ids.buffers()[2] or b"", "<u2", count=(ends[-1] - ends[0]) // ID_BYTES, offset=ends[0])
                ends = (ends - ends[0]) // ID_BYTES
            else:
                ends, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
            if len(flat) <= length:
                continue
            asked = lists.flatten()
            piece = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            start = b.column(1).to_numpy()[piece]
            row = asked.field(0).to_numpy()[:, None] * batch + np.arange(batch)
            inside = (row * length >= start[:, None]) & (row * length + length < (start + np.diff(ends)[piece])[:, None])
            of, number = np.nonzero(inside)
            begin = ends[piece[of]] + row[inside] * length - start[of]
            view = np.lib.stride_tricks.sliding_window_view(flat, length + 1)
            most = max(1, SENT // length)
            for k in range(0, len(of), most):
                some = slice(k, k + most)
                got = view[begin[some]]
                sides = [pa.ListArray.from_arrays(np.arange(0, got[:, :-1].size + 1, length, dtype=np.int32), pa.array(side.reshape(-1).astype(np.int32 if as_bytes else flat.dtype))) for side in (got[:, :-1], got[:, 1:])]
                taken = pa.array(of[some])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(piece[of[some]])), asked.field(1).take(taken), asked.field(2).take(taken), pa.array(number[some].astype(np.int32)), *sides], names=[shard, "rank", "step", "row", "x", "y"])

    of_batch = every.schema["batches"].dataType.elementType
    types = (every.schema["shard"].dataType.simpleString(), *(of_batch[c].dataType.simpleString() for c in ("rank", "step")), "int" if as_bytes else kind.elementType.simpleString())
    return every.mapInArrow(run, "`{4}` {0}, rank {1}, step {2}, row int, x array<{3}>, y array<{3}>".format(*types, shard))


def build_pieces(docs: DataFrame, shard_size: int, target: int | None, val_shards: int = 1, condition: str = "facts", order: str = "doc_id", text: str = "text", synthetic: DataFrame | None = None, encoder=None) -> DataFrame:
    """Text to pieces of shards: split, shard, shard_offset, doc_offset, length, facts (of the whole document) and ids.

    ``corpus.build`` with the ids as arrays; bytes are the default encoder."""
    from . import corpus

    return corpus.unpacked(corpus.build(docs, shard_size, target, val_shards, encoder, condition, order, text, synthetic))


def build_corpus(docs: DataFrame, shard_size: int, target: int | None, val_shards: int = 1, condition: str = "facts", order: str = "doc_id", text: str = "text", synthetic: DataFrame | None = None, encoder=None) -> DataFrame:
    """Text to shards: split, shard, tokens.  A shard is a row here; ``files.write_token_shards`` of pieces holds none whole."""
    parts = build_pieces(docs, shard_size, target, val_shards, condition, order, text, synthetic, encoder)
    held = F.array_sort(F.collect_list(F.struct("shard_offset", "ids")))
    return parts.groupBy("split", "shard").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("tokens"))
