"""Tables in the cluster's shared folder, and blocks of documents that answer to each other.

``blocks`` packs rows into Arrow blocks of a few megabytes and writes them once.
``ask`` lets every block send keys to buckets, where one task sees each key from
all blocks, and returns each bucket's answers to the block that asked.  Blocks
and answers are tables in the shared folder, so a lost executor costs only its
own tasks.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20
BUCKET_BYTES, BUCKET_MOST = 8 << 20, 64 << 20
#: Rows and bytes of an Arrow batch of texts: what a worker and its JVM hold of them at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this process only where none is set and all runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="tokenloom-"))
    return _fallback[0]


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches kept small in its session from now on (if the setting is Spark's own)."""
    conf = df.sparkSession.conf
    for name, default, value in (("maxRecordsPerBatch", ("10000",), BATCH_ROWS), ("maxBytesPerBatch", ("67108864b", "64MB", "67108864"), BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}") in default:
            conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    return df


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; at their end a worker, which Spark keeps for later tasks, gives free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", 32 << 20).parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def buffers(column: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """Bytes, n + 1 offsets and validity of a string or binary array."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(bufs[2]) if bufs[2] is not None else memoryview(b"")
    return data, offsets, column.is_valid().to_numpy(zero_copy_only=False)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    data, offsets, valid = buffers(column)
    for i, ok in enumerate(valid.tolist()):
        yield bytes(data[offsets[i] : offsets[i + 1]]) if ok else None


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as r:
        return r.read_next_batch()


def sized(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each."""
    _, offsets, _ = buffers(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = min(end, n)


def blocks(rows: DataFrame, text: str, name: str, add: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Rows as (block_id, n_bytes, body); a row is never cut, so a long text is a block by itself.

    add may give batches further columns, worked out once and kept in the blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            assert len(whole) == 1
            out = pa.RecordBatch.from_pydict({"block_id": pa.array([seq], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "body": pa.array([_pack(whole[0])], pa.binary())})
            seq, size = seq + 1, 0
            held.clear()
            return out

        for batch in tidy(batches):
            for part in sized(batch, text, BLOCK_BYTES):
                data = part.nbytes
                if held and size + data > BLOCK_BYTES:
                    yield flush()
                held.append(add(part) if add else part)
                size += data
        if held:
            yield flush()

    small_batches(rows)
    return written(rows.mapInArrow(pack, "block_id long, n_bytes long, body binary"), name, "uncompressed")


def bucket_count(blocks_df: DataFrame, most: int = BUCKET_MOST) -> int:
    """Buckets for questions about all of the text: BUCKET_BYTES of text each, up to most in large tables,
    where a block would else have a row of its questions for too few keys."""
    total = blocks_df.agg(F.sum("n_bytes")).first()[0] or 0
    return int(max(64, total // max(BUCKET_BYTES, min(total >> 12, most))))


def ask(joined: DataFrame, emit: Callable, answer: Callable, name: str) -> DataFrame:
    """Answers (block_id, level, bucket, body) to what blocks ask.

    emit(batch, answers) yields (bucket, bytes) for one block; answer(list of bytes)
    returns one bytes object for each, in the same order."""

    def send(batches):
        for block_id, batch, got in each_block(batches):
            out = list(emit(batch, got))
            if out:
                yield pa.RecordBatch.from_pydict({"block_id": pa.array([block_id] * len(out), pa.int64()), "bucket": pa.array([x[0] for x in out], pa.int32()), "body": pa.array([x[1] for x in out], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        return pa.table({"block_id": table.column("block_id").combine_chunks(), "level": pa.array([name] * len(bodies)), "bucket": table.column("bucket").combine_chunks(), "body": pa.array(answer(bodies), pa.binary())})

    asked = joined.mapInArrow(send, "block_id long, bucket int, body binary")
    return written(asked.groupBy("bucket").applyInArrow(reply, "block_id long, level string, bucket int, body binary"), name)


def with_answers(blocks_df: DataFrame, *answers: DataFrame) -> DataFrame:
    """Every block beside the list of the answers to it."""
    if not answers:
        return blocks_df.select("block_id", "body", F.lit(None).cast("array<struct<level:string,bucket:int,body:binary>>").alias("answers"))
    every = answers[0]
    for x in answers[1:]:
        every = every.unionByName(x)
    lists = every.groupBy("block_id").agg(F.collect_list(F.struct("level", "bucket", "body")).alias("answers"))
    # built in memory, as answers are small beside blocks; not broadcast, so that the plan is one at every size
    return blocks_df.select("block_id", "body").join(lists.hint("shuffle_hash"), "block_id", "left")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, dict[str, list[bytes]]]]:
    """(block_id, rows, answers by level in the order of buckets) of every block."""
    for batch in tidy(batches):
        for i in range(batch.num_rows):
            got: dict[str, list[tuple[int, bytes]]] = {}
            for x in batch.column(2)[i].as_py() or ():
                got.setdefault(x["level"], []).append((x["bucket"], x["body"]))
            yield batch.column(0)[i].as_py(), unpack(batch.column(1)[i].as_buffer()), {k: [b for _, b in sorted(v)] for k, v in got.items()}


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """schema with further fields; a field of a taken name replaces it."""
    names = {n for n, _ in fields}
    kept = [f for f in schema.fields if f.name not in names]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def packed40(x: np.ndarray) -> bytes:
    """Values under 2**40 in five bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()
