"""A stream of pages, and packing as its state, over restarts."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import pack
from tokenloom.streaming import packing, pages


def rows_of(spark, n):
    draw = random.Random(n)
    return spark.createDataFrame([(i, draw.choice([None, 0, 1, 5, 40, 300]), f"text {i}") for i in range(n)], "doc_id long, n long, text string")


def test_pages_are_read_once_over_restarts(spark, tmp_path):
    at, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress.json"))
    rows = rows_of(spark, 95)
    pages.write_pages(rows, at, "doc_id", 10)

    def run(batches):
        stream = pages.page_stream(spark, at, "text string, doc_id long", 2, progress)
        running = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
        if batches is None:
            running.processAllAvailable()
        while batches and running.isActive and len(running.recentProgress) < batches:
            running.awaitTermination(1)
        running.stop()
        assert running.exception() is None

    run(1)
    first = spark.read.parquet(out).count()
    assert 20 <= first < 95 and json.loads((tmp_path / "progress.json").read_text())["page"] >= 2
    run(None)
    got = spark.read.parquet(out)
    assert got.columns == ["text", "doc_id"] and sorted(r.doc_id for r in got.collect()) == list(range(95))
    # a page that comes later
    later = rows.limit(5).withColumn("doc_id", F.col("doc_id") + 1000).withColumn("page", F.lit(10))
    later.write.partitionBy("page").mode("append").parquet(at)
    run(None)
    assert spark.read.parquet(out).count() == 100


def test_batches_are_bounded_and_gaps_wait(tmp_path):
    for n in (0, 1, 2, 4):
        (tmp_path / "p" / f"page={n}").mkdir(parents=True)
    reader = pages._PageReader(str(tmp_path / "p"), ["a"], 2, str(tmp_path / "done"))
    assert reader.initialOffset() == {"page": 0} and reader.latestOffset() == {"page": 2} == reader.latestOffset()
    assert [p.number for p in reader.partitions({"page": 0}, {"page": 2})] == [0, 1] and reader.latestOffset() == {"page": 3}
    again = pages._PageReader(str(tmp_path / "p"), ["a"], 2, str(tmp_path / "done"))
    assert again.latestOffset() == {"page": 3}  # page 3 isn't there yet
    assert pages._PageReader(str(tmp_path / "none"), ["a"], 0, None).latestOffset() == {"page": 0}
    with pytest.raises(ValueError, match="progress"):
        pages._PageReader(str(tmp_path), ["a"], 2, None)


@pytest.mark.parametrize("lanes", [1, 3])
def test_a_packed_stream_is_the_packed_table(spark, tmp_path, lanes):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = rows_of(spark, 120)
    pages.write_pages(rows, at, "doc_id", 13)
    for _ in range(2):
        stream = pages.page_stream(spark, at, "doc_id long, n long", 3, str(tmp_path / "progress"))
        running = packing.start(packing.packed(stream, 64, lanes), out, str(tmp_path / "cp"))
        while running.isActive and not running.recentProgress:
            running.awaitTermination(1)
        running.stop()
        assert running.exception() is None
    running = packing.start(packing.packed(pages.page_stream(spark, at, "doc_id long, n long", 3, str(tmp_path / "progress")), 64, lanes), out, str(tmp_path / "cp"))
    running.processAllAvailable()
    running.stop()
    columns = ["doc_id", "shard", "piece_start", "length", "shard_offset", "doc_offset"]
    got = spark.read.parquet(out)
    for lane in range(lanes):
        mine = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(lanes)) == lane).select("doc_id", "n")
        want = sorted(tuple(r) for r in pack.pack(mine, 64, 1 << 40).select(*columns).collect())
        assert sorted(tuple(r) for r in got.filter(F.col("lane") == lane).select(*columns).collect()) == want and want


def test_pieces_from_any_place():
    found = packing.pieces_from(7, np.array([1, 2, 3]), np.array([5, 0, 20]), 10)
    assert {k: v.tolist() for k, v in found.items()} == {"id": [1, 1, 3, 3, 3], "shard": [0, 1, 1, 2, 3], "piece_start": [7, 10, 12, 20, 30], "length": [3, 2, 8, 10, 2], "shard_offset": [7, 0, 2, 0, 0], "doc_offset": [0, 3, 0, 8, 18]}
