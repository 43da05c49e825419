"""Exact top-k search by columnar branch-and-bound.

Vectors stand dimension by dimension.  A query takes its dimensions from the
heaviest on, a block at a time, over the candidates still alive; what the rest of
the dimensions can add is bounded by the mass left on both sides.  Candidates whose
upper bound is under the k-th best lower bound are dropped and the columns
compacted, until few are left or all dimensions are in.

Queries and rows are dealt to blocks of bounded size; every block of queries meets
every block of rows once, and the best of each block are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Rows of a block at most; a row is sent once for each block of queries, a query once for each block of rows.
QUERY_BLOCK = 16_384
ROW_BLOCK = 65_536
#: Rows that a block has at least before there are more of them than tasks run at once.
LEAST_BLOCK = 4096
DIMENSIONS = 8
_EXACT, _LONG = float(1 << 53), 1 << 63


def top_k(query: np.ndarray, columns: np.ndarray, norms: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k candidates with the highest inner product, ties to smaller ids.

    columns[d] holds dimension d of all candidates; values are whole numbers, so sums
    are exact while they stay under 2**53 (else in Python's integers, where scores that
    leave 64 bits don't count)."""
    alive = np.flatnonzero(ids != own)
    if columns.dtype == object:  # no float bounds these
        score = (query[:, None] * columns[:, alive]).sum(0)
        fits = [i for i, s in enumerate(score.tolist()) if -_LONG <= s < _LONG]
        best = sorted(fits, key=lambda i: (-score[i], int(ids[alive[i]])))[:k]
        return ids[alive[best]], score[best]
    score = np.zeros(len(alive), columns.dtype)
    rest = norms[alive].astype(float)
    order = np.argsort(-np.abs(query).astype(float), kind="stable")
    mass = np.concatenate((np.cumsum((query[order].astype(float) ** 2)[::-1])[::-1], [0.0]))
    for at in range(0, len(order), DIMENSIONS):
        block = order[at : at + DIMENSIONS]
        part = columns[block] if len(alive) == columns.shape[1] else columns[np.ix_(block, alive)]
        score = score + query[block] @ part
        rest = rest - (part.astype(float) ** 2).sum(0)
        left = mass[min(at + DIMENSIONS, len(order))]
        if len(alive) > k:
            scores = score.astype(float)
            # rounding of the float sums is far under one part in 10**9 of the masses
            bound = np.sqrt(left * np.maximum(rest, 0)) + 1e-9 * (left + np.abs(rest) + np.abs(scores)) + 1
            if left == 0:
                bound = np.full(len(alive), 1 + 1e-9 * float(np.abs(scores).max()))
            floor = np.partition(scores - bound, len(alive) - k)[len(alive) - k]
            keep = scores + bound >= floor
            if keep.sum() < 0.9 * len(keep):
                alive, score, rest = alive[keep], score[keep], rest[keep]
    best = sorted(range(len(alive)), key=lambda i: (-int(score[i]), int(ids[alive[i]])))[:k]
    return ids[alive[best]], score[best]


def _columns(lists: pa.Array) -> np.ndarray:
    """Dimension-major matrix of equally long lists: float64 where inner products are exact in it, else integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = len(lists)
    matrix = flat.reshape(n, len(flat) // n).T
    most = float(np.abs(flat).max()) if len(flat) else 0.0
    return np.ascontiguousarray(matrix, float) if most * most * matrix.shape[0] < _EXACT else _whole(matrix)


def _whole(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's."""
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """For every row that is_query holds for, the k rows of highest integer inner product.

    A component x counts as floor(scale * x).  Returns ``query_id``, ``rank`` from 1,
    id_col and ``score``.  Rows with a null id or a null vector, and vectors that hold
    null, undefined or (scaled) infinite components, take no part, nor does a pair whose score
    leaves 64 bits; vectors are only compared with ones as long, and empty ones not at all.  A query isn't its own candidate, nor are
    other rows of its id; of several query rows with one id the least vector counts.
    Ties go to the smaller id, and repeated rows each take a rank.  With fewer
    candidates than k all are returned; an empty table gives an empty one.  Other
    columns are not carried.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < float("inf")))
    # doubles from 2**53 on are whole, and may be beyond what a long holds
    floor = lambda c: F.when(F.abs(c) < _EXACT, F.floor(c).cast("double")).otherwise(c)
    usable = (
        rows.select(F.col(id_col).cast("long").alias("id"), x.alias("v"), is_query.alias("is_query"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter((F.size("v") > 0) & sound)
        .select("id", "is_query", F.size("v").alias("d"), F.transform("v", lambda c: floor(c * float(scale))).alias("v"))
    )
    sizes = usable.agg(F.count("*"), F.count_if("is_query")).first()
    at_once = 2 * rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(-(-sizes[0] // ROW_BLOCK), min(at_once, sizes[0] // LEAST_BLOCK), 1)
    query_blocks = -(-sizes[1] // QUERY_BLOCK) or 1
    queries = usable.filter("is_query").groupBy("id").agg(F.min(F.struct("d", "v")).alias("x")).select("id", "x.d", "x.v")
    each_row = usable.select("id", "d", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).alias("r")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    each_query = queries.withColumn("q", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            asked = _columns(left.column("v").combine_chunks())
            columns = _columns(right.column("v").combine_chunks())
            if asked.dtype != columns.dtype or float(np.abs(asked).max()) * float(np.abs(columns).max()) * len(columns) >= _EXACT:
                asked, columns = _whole(asked), _whole(columns)
            norms = (columns**2).sum(0)
            ids = right.column("id").to_numpy()
            for i, own in enumerate(left.column("id").to_pylist()):
                found, score = top_k(asked[:, i], columns, norms, ids, own, k)
                out += [(own, int(a), int(s)) for a, s in zip(found, score, strict=True)]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    keys = ("d", "q", "r")
    met = each_query.groupBy(*keys).cogroup(each_row.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
