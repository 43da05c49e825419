"""Readers and writers: documents, JSON lines, arrays of ids, reports and logs."""

from __future__ import annotations

import io
import re
import sys
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import shard_name
from ..operators.tokenize import checked_uint16
from .scratch import scratch  # noqa: F401

QA_SCHEMA = "question string, answer string"
CHAT_SCHEMA = "messages array<struct<role: string, content: string>>"
CODE_SCHEMA = "code string, answer string"


def documents(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table of documents, only the columns asked for."""
    return spark.read.parquet(path).select(*(columns or ("doc_id", "text")))


def document_stream(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The same as a stream of files that appear under path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).select(*(columns or ("doc_id", "text")))


def split_table(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table that is partitioned by split."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def first_json_lines(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first n lines in the order of files and lines, parsed, with their index."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_at"))
    first = lines.orderBy("_at").limit(n)
    rank = F.row_number().over(_in_order("_at")) - 1  # of n rows at most
    return first.select(F.from_json("value", schema).alias("_row"), rank.alias("idx")).select("idx", "_row.*")


def _in_order(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(column)


def _chunks(url: str) -> Iterator[bytes]:
    """A file from the network, piece by piece."""
    with urllib.request.urlopen(url) as answer:
        while chunk := answer.read(1 << 20):
            yield chunk


def cached_json_lines(spark: SparkSession, url: str, cache: str, schema: str, fetch: Callable[[str], Iterable[bytes]] = _chunks) -> DataFrame:
    """JSON lines of one file from elsewhere, kept under the path cache, from which they are read ever after.

    The driver copies the file piece by piece and gives it its name when it is whole, so one
    that was cut short is fetched again."""
    jvm = spark.sparkContext._jvm
    there, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (cache, f"{cache}.{uuid.uuid4().hex}"))
    store = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(there):
        out = store.create(part)
        try:
            for chunk in fetch(url):
                out.write(bytearray(chunk))
        except BaseException:
            out.close()
            store.delete(part, False)
            raise
        out.close()
        store.rename(part, there)
    return json_lines(spark, cache, schema)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def _setting(value: str):
    """A setting's value: a word for truth or nothing, a number, a list in brackets, or text with or without quotes."""
    if value.startswith("[") and value.endswith("]"):
        return [_setting(x.strip()) for x in value[1:-1].split(",") if x.strip()]
    if value[:1] in "'\"" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.lower() in ("null", "~", "true", "false"):
        return {"true": True, "false": False}.get(value.lower())
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def config(text: str, defaults: dict) -> dict:
    """Settings ("name: value" lines, deeper ones by indentation) over defaults; the driver only."""
    out: dict = {}
    open_ = [(-1, out)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        name, colon, value = line.strip().partition(":")
        if not colon:
            continue
        depth = len(line) - len(line.lstrip())
        while depth <= open_[-1][0]:
            open_.pop()
        if value.strip():
            open_[-1][1][name.strip()] = _setting(value.strip())
        else:
            open_.append((depth, open_[-1][1].setdefault(name.strip(), {})))
    return _over(defaults, out)


def _over(below: dict, above: dict) -> dict:
    """Settings over others, level by level; an empty level changes nothing."""
    nested = lambda k: isinstance(below.get(k), dict) and isinstance(above[k], dict)
    return below | {k: _over(below[k], v) if nested(k) else v for k, v in above.items() if v != {} or k not in below}


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """path and step of checkpoint files, by step; files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "model_*.pt").load(path).select("path")
    step = F.nullif(F.regexp_extract("path", r"model_(\d+)\.pt$", 1), F.lit("")).cast("int")
    return files.withColumn("step", step).filter("step is not null").orderBy("step")


def npy_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """path, shard and tokens of a split's .npy files, in order of names; any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{split}*.npy").load(path).select("path", "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.load(io.BytesIO(content.as_buffer())).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), tokens], names=["path", "tokens"])

    loaded = files.mapInArrow(load, "path string, tokens array<int>")
    return loaded.withColumn("shard", F.regexp_extract("path", r"_(\d+)\.npy$", 1).try_cast("int")).orderBy("path")


class NpyShards(DataSource):
    """Sink "npy_shards": rows (name, tokens) as 16-bit .npy files under the option path.

    Files go through pyarrow's file systems, so the path must be one that all executors
    share; a task's files are moved into place only when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def writer(self, schema, overwrite: bool):
        return _NpyWriter(self.options["path"])


class _NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = self._place()
        part = f"_part/{TaskContext.get().taskAttemptId()}"  # attempts of a task don't share files
        store.create_dir(f"{root}/{part}", recursive=True)
        done = _Written(part, [])
        for batch in batches:
            names, tokens = batch.column(batch.schema.get_field_index("name")), batch.column(batch.schema.get_field_index("tokens"))
            for name, ids in zip(names, tokens, strict=True):
                data = ids.values.to_numpy(zero_copy_only=False)
                if len(data) and (data.max() >= 1 << 16 or data.min() < 0):
                    raise ValueError("an id does not fit in 16 bits")
                out = io.BytesIO()
                np.save(out, data.astype(np.uint16))
                with store.open_output_stream(f"{root}/{part}/{name.as_py()}") as f:
                    f.write(out.getvalue())
                done.names.append(name.as_py())
        return done

    def commit(self, messages) -> None:
        store, root = self._place()
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/{m.part}/{name}", f"{root}/{name}")
        store.delete_dir(f"{root}/_part")

    def abort(self, messages) -> None:
        store, root = self._place()
        store.delete_dir(f"{root}/_part")


class _Written(WriterCommitMessage):
    def __init__(self, part: str, names: list[str]):
        self.part, self.names = part, names


def write_npy_shards(shards: DataFrame, path: str, prefix: str = "corpus") -> None:
    """Shards (split, shard, tokens) as .npy files."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the sink's planner has not this process's path
    shards.sparkSession.dataSource.register(NpyShards)
    rows = shards.select(shard_name(F.col("split"), F.col("shard"), prefix).alias("name"), "tokens")
    rows.write.format("npy_shards").option("path", path).mode("append").save()


def write_shards(shards: DataFrame, path: str) -> None:
    """Shards as Parquet, partitioned by split."""
    checked_uint16(shards, "tokens").write.partitionBy("split").mode("overwrite").parquet(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Pieces of documents (split, shard, shard_offset, ids, ...) as Parquet by split and shard, in order of their
    offsets; no shard has to fit in a row, as ``shards`` needs."""
    placed = pieces.repartition("split", "shard").sortWithinPartitions("split", "shard", "shard_offset")
    placed.write.partitionBy("split", "shard").mode("overwrite").parquet(path)


def json_of(one_row: DataFrame, *columns: Column | str) -> DataFrame:
    """A row's columns as one JSON text, ``json``."""
    return one_row.select(F.to_json(F.struct(*(columns or one_row.columns))).alias("json"))


def write_json(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines, in so many files if a number is given: one for a report of a few rows."""
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """More lines in files of their own, as a restart finds what is done."""
    df.write.mode("append").json(path)


def two_variants(rows: DataFrame, success: str = "success", plain: str = "answer", facts: str = "answer_with_mul_tokens") -> tuple[DataFrame, DataFrame]:
    """Successful rows as question and answer, without and with fact tokens."""
    good = rows.filter(F.col(success))
    return good.select("question", F.col(plain).alias("answer")), good.select("question", F.col(facts).alias("answer"))


def report(metrics: DataFrame, examples: DataFrame, order: str) -> DataFrame:
    """One JSON text with metrics and a bounded list of examples in order."""
    listed = examples.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in examples.columns if c != order]))).alias("results"))
    return metrics.select(F.struct(*metrics.columns).alias("metadata")).crossJoin(listed).select(F.to_json(F.struct("metadata", "results")).alias("json"))


def log_lines(losses: DataFrame, step: str = "step", split: str = "split", loss: str = "loss") -> DataFrame:
    """Lines of a training log: six decimals in training, four in validation."""
    text = F.when(F.col(split) == "val", F.format_string("%d val %.4f", step, loss)).otherwise(F.format_string("%d train %.6f", step, loss))
    return losses.select(step, text.alias("line"))


def concatenated(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Numbered parts as one table, with their number as ``part``; missing ones are just not given."""
    out = None
    for number, part in sorted(parts, key=lambda x: x[0]):
        named = part.withColumn("part", F.lit(number))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out
