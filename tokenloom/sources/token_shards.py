"""Shards of 16-bit ids as .npy files: written in order from pieces, and read by ranges.

A shard is never whole in memory: the sink gets its pieces in order of their places and
appends them behind a header; the source reads the bytes of the rows that it is asked for."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.text import shard_name

#: Bytes before a file's ids, and of one id.
HEADER, ID_BYTES = 128, 2
#: Steps of a range, ids of the ranges that one partition of the source reads, and ids that it sends at a time.
STEPS, PART_IDS, SENT = 256, 1 << 22, 1 << 18


def header(size: int) -> bytes:
    """The head of a .npy file of so many unsigned 16-bit numbers."""
    text = f"{{'descr': '<u2', 'fortran_order': False, 'shape': ({size},), }}".encode()
    return b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + text.ljust(HEADER - 11) + b"\n"


def ids_in(head: bytes) -> int:
    """How many ids a file's head promises."""
    found = re.search(rb"'descr': '<u2', 'fortran_order': False, 'shape': \((\d+),\)", head)
    if head[:6] != b"\x93NUMPY" or int.from_bytes(head[8:10], "little") != HEADER - 10 or not found:
        raise ValueError("no .npy file of 16-bit ids")
    return int(found[1])


def place(path: str):
    """A path's file system and folder; one that pyarrow and all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class TokenShards(DataSource):
    """Sink and source "token_shards".

    Writing takes rows (name, size, shard_offset, ids), of one shard in one task and in order.
    Reading gives training batches: the options are path, split, batch, length, ranks, and
    optionally epochs (1), first_step (0) and last_step (the step before which to stop)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "rank int, step long, epoch int, shard int, shard_step long, row int, x array<int>, y array<int>"

    def writer(self, schema, overwrite: bool):
        return _ShardWriter(self.options["path"])

    def reader(self, schema):
        return _BatchReader(dict(self.options))


class _Written(WriterCommitMessage):
    def __init__(self, part: str, names: list[str]):
        self.part, self.names = part, names


class _ShardWriter(DataSourceArrowWriter):
    """Files stand under an attempt's own folder until all tasks are done, then they are moved to their names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = place(self.path)
        part = f"_part/{TaskContext.get().taskAttemptId()}"
        store.create_dir(f"{root}/{part}", recursive=True)
        done = _Written(part, [])
        out, now, at, size, begun = None, None, 0, 0, set()

        def close() -> None:
            if out is not None:
                out.close()
                if at != size:
                    raise ValueError(f"{now} has {at} ids of {size}")

        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            for name, total, offset, ids in zip(column("name").to_pylist(), column("size").to_pylist(), column("shard_offset").to_pylist(), column("ids"), strict=True):
                if name != now:
                    close()
                    if name in begun:
                        raise ValueError(f"{name} comes in two stretches")
                    now, at, size = name, 0, total
                    out = store.open_output_stream(f"{root}/{part}/{name}")
                    out.write(header(size))
                    done.names.append(name)
                    begun.add(name)
                if offset != at:
                    raise ValueError(f"{name} goes on at {offset} after {at} ids")
                data = ids.as_buffer()
                out.write(data)
                at += data.size // ID_BYTES
        close()
        return done

    def commit(self, messages) -> None:
        store, root = place(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/{m.part}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*place(self.path))

    @staticmethod
    def _clear(store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_part").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_part")


class _Range(NamedTuple):
    """Steps of a rank in one shard, from shard_step on."""

    file: str
    shard: int
    epoch: int
    rank: int
    step: int
    shard_step: int
    steps: int


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges

    @property
    def steps(self) -> int:
        return sum(r.steps for r in self.ranges)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.split = low["path"], low.get("split", "train")
        self.batch, self.length, self.ranks = (int(low[k]) for k in ("batch", "length", "ranks"))
        self.epochs, self.first_step = int(low.get("epochs", 1)), int(low.get("first_step", 0))
        self.last_step = int(low["last_step"]) if "last_step" in low else None

    def shards(self) -> list[tuple[str, int, int]]:
        """(file, shard, ids) of the split's files in order of their names; sizes follow from the listing."""
        from pyarrow import fs

        store, root = place(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".npy") and self.split in f.base_name]
        number = lambda name: int(m[1]) if (m := re.search(r"_(\d+)\.npy$", name)) else -1
        return [(f.path, number(f.base_name), max(0, f.size - HEADER) // ID_BYTES) for f in sorted(found, key=lambda f: f.base_name)]

    def steps_in(self, size: int, rank: int) -> int:
        """Steps of a rank in a shard: one if the batch is there, and further ones while all ranks' next ones are."""
        block = self.batch * self.length
        if block * rank + block + 1 > size:
            return 0
        return 1 + max(0, (size - 1 - block * (rank + self.ranks)) // (block * self.ranks))

    def ranges(self) -> Iterator[_Range]:
        shards = self.shards()
        for rank in range(self.ranks):
            step = 0
            for epoch in range(self.epochs):
                for file, shard, size in shards:
                    steps = self.steps_in(size, rank)
                    low = max(step, self.first_step)
                    high = min(step + steps, step + steps if self.last_step is None else self.last_step)
                    yield from (_Range(file, shard, epoch, rank, at, at - step, min(STEPS, high - at)) for at in range(low, high, STEPS))
                    step += steps

    def partitions(self) -> list[_Ranges]:
        """Ranges of small shards are read together, so that partitions follow the ids and not the files."""
        out, held = [], 0
        for r in self.ranges():
            if not out or held + r.steps * self.batch * self.length > PART_IDS:
                out.append(_Ranges([]))
                held = 0
            out[-1].ranges.append(r)
            held += r.steps * self.batch * self.length
        return out

    def read(self, part: _Ranges | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no steps
            return
        store, _ = place(self.path)
        most = max(1, SENT // (self.batch * self.length))
        held, ids = [], []  # of the next record batch: range and step in it, ids
        for r in part.ranges:
            with store.open_input_file(r.file) as f:
                ids_in(f.read(HEADER))
                for k in range(r.steps):
                    held.append((r, k))
                    ids.append(self.ids_at(f, r, k))
                    if len(ids) == most:
                        yield self.rows(held, ids)
                        held, ids = [], []
        if ids:
            yield self.rows(held, ids)

    def ids_at(self, f, r: _Range, k: int) -> bytes:
        block = self.batch * self.length
        found = f.read_at(ID_BYTES * (block + 1), HEADER + ID_BYTES * block * (r.rank + (r.shard_step + k) * self.ranks))
        if len(found) < ID_BYTES * (block + 1):
            raise ValueError(f"{r.file} is shorter than its listing")
        return found

    def rows(self, held: list[tuple[_Range, int]], ids: list[bytes]) -> pa.RecordBatch:
        """The rows of several steps."""
        both = np.frombuffer(b"".join(ids), "<u2").astype(np.int32).reshape(len(ids), -1)
        ends = np.arange(0, len(ids) * self.batch * self.length + 1, self.length, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(ends, np.ascontiguousarray(a).reshape(-1)) for a in (both[:, :-1], both[:, 1:])]
        each = lambda values, t: pa.array(np.repeat(np.fromiter(values, np.int64, len(held)), self.batch)).cast(t)
        fixed = [each((r.rank for r, _ in held), pa.int32()), each((r.step + k for r, k in held), pa.int64()), each((r.epoch for r, _ in held), pa.int32()), each((r.shard for r, _ in held), pa.int32()), each((r.shard_step + k for r, k in held), pa.int64()), pa.array(np.tile(np.arange(self.batch, dtype=np.int32), len(held)))]
        return pa.RecordBatch.from_arrays([*fixed, *lists], names=["rank", "step", "epoch", "shard", "shard_step", "row", "x", "y"])


def _registered(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner of sinks and sources has not this process's path
    spark.dataSource.register(TokenShards)


def write_token_shards(pieces: DataFrame, path: str, shard_size: int, prefix: str = "corpus") -> None:
    """Pieces (split, shard, piece_start, shard_offset, length, ids) as a .npy file for each shard under path.

    Only the last shard is short, so sizes are known before a file begins.  A task has whole
    shards and holds one piece at a time; a task that is run again writes elsewhere, and only
    what the job commits is moved to its name."""
    _registered(pieces.sparkSession)
    total = pieces.agg(F.max(F.col("piece_start") + F.col("length"))).first()[0] or 0
    size = F.least(F.lit(shard_size), F.lit(total) - F.col("shard") * shard_size)
    rows = pieces.select(shard_name(F.col("split"), F.col("shard"), prefix).alias("name"), size.cast("long").alias("size"), F.col("shard_offset").cast("long").alias("shard_offset"), "ids")
    rows.repartition("name").sortWithinPartitions("name", "shard_offset").write.format("token_shards").option("path", path).mode("append").save()


def read_batches(spark: SparkSession, path: str, split: str, batch: int, length: int, ranks: int, epochs: int = 1, first_step: int = 0, last_step: int | None = None) -> DataFrame:
    """Training batches of a split's shards, a row for each of their rows: rank, step, epoch, shard, shard_step, row, x, y.

    A rank goes through the shards in order, again in each epoch; its steps count on over
    shards and epochs, so a run that stopped goes on at first_step.  Only the bytes of the
    steps asked for are read.  A shard's rest that is too short for all ranks is left out,
    and so is a shard too short for a rank's first batch."""
    _registered(spark)
    options = {"path": path, "split": split, "batch": batch, "length": length, "ranks": ranks, "epochs": epochs, "first_step": first_step} | ({} if last_step is None else {"last_step": last_step})
    return spark.read.format("token_shards").options(**options).load()
