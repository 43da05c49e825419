"""Streams: injection, running rewards, packing with a carried offset, resumed work; and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import exact_match
from ..functions.inject import inject
from ..operators.pack import pack


def injected(stream: DataFrame, text: str = "text", mode: str = "weak") -> DataFrame:
    """A stream with fact tokens in its text; no state."""
    return stream.withColumn(text, inject(F.col(text), mode))


def start_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """All that is there now into files, exactly once; a later start goes on where this one ended."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def reward_statistics(stream: DataFrame, prediction: str = "prediction", truth: str = "truth") -> DataFrame:
    """Running total, correct answers and mean reward, for update or complete mode."""
    scored = stream.select(exact_match(F.col(prediction), F.col(truth)).alias("r"))
    return scored.agg(F.count("*").alias("total"), F.count_if("r.correct").alias("correct"), F.avg("r.reward").alias("mean_reward"))


def start_pack(stream: DataFrame, path: str, checkpoint: str, shard_size: int, order: str = "doc_id", n: str = "n"):
    """Pieces of documents in shards, batch after batch, under path; one writer at a time.

    Each batch is a folder of its own with the place where it ends, so a batch that is
    run again after a failure reads the same start and overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = 0
        if number:
            ends = spark.read.parquet(f"{path}/ends").filter(F.col("batch") < number)
            start = ends.agg(F.max("stop")).first()[0] or 0
        total = batch.agg(F.sum(n)).first()[0] or 0
        pieces = pack(batch, shard_size, 1 << 60, order, n)
        # a batch begins inside a shard: cut its pieces anew from its own start
        moved = pieces.groupBy(order).agg(F.min("piece_start").alias("first"), F.sum("length").alias("all"))
        low = F.col("first") + start
        shards = moved.withColumn("shard", F.explode(F.sequence(F.floor(low / shard_size), F.floor((low + F.col("all") - 1) / shard_size))))
        a, b = F.greatest(low, F.col("shard") * shard_size), F.least(low + F.col("all"), (F.col("shard") + 1) * shard_size)
        out = shards.select(order, "shard", a.alias("piece_start"), (b - a).alias("length"), (a - F.col("shard") * shard_size).alias("shard_offset"), (a - low).alias("doc_offset"))
        out.write.mode("overwrite").parquet(f"{path}/pieces/batch={number}")
        spark.createDataFrame([(number, start + total)], "batch long, stop long").write.mode("overwrite").parquet(f"{path}/ends/part={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """An extension: events and their value by type in tumbling or sliding windows, with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: users' sessions, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
