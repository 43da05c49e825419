"""A stream of numbered pages of rows, read by the tasks themselves, a bounded number in each batch."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def place(path: str):
    """A path's file system and folder; one that pyarrow and all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Pages(DataSource):
    """Source "pages": folders page=0, page=1, ... of Parquet files under the option path.

    The schema that a stream asks for says which columns are read.  With pages_per_batch a
    batch has so many at most; the option progress is then a file, one for each query, that
    says how far batches were planned, as the engine doesn't tell a source where it begins anew."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def streamReader(self, schema):
        low = {k.lower(): v for k, v in dict(self.options).items()}
        return _PageReader(low["path"], schema.fieldNames(), int(low.get("pages_per_batch", 0)), low.get("progress"))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PageReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], most: int, progress: str | None):
        if most and not progress:
            raise ValueError("pages_per_batch needs the option progress")
        self.path, self.columns, self.most, self.progress = path, columns, most, progress
        self.planned: int | None = None

    def initialOffset(self) -> dict:
        return {"page": 0}

    def pages(self) -> int:
        """Pages there are, up to the first that isn't."""
        from pyarrow import fs

        store, root = place(self.path)
        names = {f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory}
        n = 0
        while f"page={n}" in names:
            n += 1
        return n

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = self._known()
        there = self.pages()
        return {"page": max(self.planned, min(there, self.planned + self.most) if self.most else there)}

    def _known(self) -> int:
        from pyarrow import fs

        if not self.progress:
            return 0
        store, at = place(self.progress)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return 0
        with store.open_input_file(at) as f:
            return json.loads(f.read())["page"]

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self.planned = max(self.planned or 0, end["page"])
        if self.progress:
            store, at = place(self.progress)
            with store.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps({"page": self.planned}).encode())
            store.move(f"{at}.new", at)
        return [_Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = place(self.path)
        files = store.get_file_info(fs.FileSelector(f"{root}/page={partition.number}"))
        for file in sorted(f.path for f in files if f.base_name.endswith(".parquet")):
            with store.open_input_file(file) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=self.columns):
                    yield batch.select(self.columns)


def write_pages(rows: DataFrame, path: str, order: str, size: int) -> None:
    """rows in pages of size, in their order, as the source reads them."""
    from ..operators.sampling import with_index

    numbered = with_index(rows, order, "_idx").withColumn("page", F.floor(F.col("_idx") / size)).drop("_idx")
    numbered.repartition("page").sortWithinPartitions("page", order).write.partitionBy("page").mode("append").parquet(path)


def page_stream(spark: SparkSession, path: str, schema: str, pages_per_batch: int = 0, progress: str | None = None) -> DataFrame:
    """A stream of the pages under path, with the columns of the schema; see ``Pages``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner of sources has not this process's path
    spark.dataSource.register(Pages)
    options = {"path": path} | ({"pages_per_batch": pages_per_batch, "progress": progress} if pages_per_batch else {})
    return spark.readStream.format("pages").schema(schema).options(**options).load()
