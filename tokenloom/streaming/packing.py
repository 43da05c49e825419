"""Packing as a state of a stream: every lane of documents keeps the place at which its shards go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pieces_from(start: int, ids: np.ndarray, sizes: np.ndarray, shard_size: int) -> dict[str, np.ndarray]:
    """Pieces in shards of documents that follow each other from a place on; those without a size have none."""
    stops = start + np.cumsum(sizes)
    starts = stops - sizes
    some = sizes > 0
    ids, starts, stops = ids[some], starts[some], stops[some]
    first, last = starts // shard_size, (stops - 1) // shard_size
    times = last - first + 1
    row = np.repeat(np.arange(len(ids)), times)
    shard = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    low, high = np.maximum(starts[row], shard * shard_size), np.minimum(stops[row], (shard + 1) * shard_size)
    return {"id": ids[row], "shard": shard, "piece_start": low, "length": high - low, "shard_offset": low - shard * shard_size, "doc_offset": low - starts[row]}


class _Lane(StatefulProcessor):
    """A lane's state is the place after its last document."""

    def __init__(self, shard_size: int, order: str, n: str):
        self.shard_size, self.order, self.n = shard_size, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        start = self.place.get()[0] if self.place.exists() else 0
        sizes = table[self.n].fillna(0).to_numpy().astype(np.int64)
        found = pieces_from(start, table[self.order].to_numpy(), sizes, self.shard_size)
        self.place.update((start + int(sizes.sum()),))
        out = pd.DataFrame(found).rename(columns={"id": self.order})
        out.insert(0, "lane", key[0])
        yield out

    def close(self) -> None:
        pass


def packed(stream: DataFrame, shard_size: int, lanes: int = 1, order: str = "doc_id", n: str = "n") -> DataFrame:
    """Pieces of a stream's documents (order, n) in shards: lane, order, shard, piece_start, length, shard_offset, doc_offset.

    Each lane is a sequence of shards by itself, with its place in the state store, and lanes
    run beside each other; documents are dealt to them by a hash.  Within a batch documents
    stand by their order, batches one after another.  A stream that starts again goes on where
    its checkpoint ends.  The state store has to be RocksDB's: see ``start``."""
    kind = stream.schema[order].dataType.simpleString()
    dealt = stream.select(F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int").alias("lane"), order, F.col(n).cast("long").alias(n))
    schema = f"lane int, {order} {kind}, shard long, piece_start long, length long, shard_offset long, doc_offset long"
    return dealt.groupBy("lane").transformWithStateInPandas(_Lane(shard_size, order, n), schema, "Append", "None")


def start(pieces: DataFrame, path: str, checkpoint: str, **options):
    """Pieces as Parquet files under path, batch after batch, with the state store that ``packed`` needs."""
    conf = pieces.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return pieces.writeStream.format("parquet").option("checkpointLocation", checkpoint).options(**options).start(path)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
