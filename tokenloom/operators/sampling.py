"""Limits, samples, splits, row numbers and partitions of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import let
from .pack import prefix_sum


def with_index(rows: DataFrame, order: str, out: str = "idx", buckets: int | None = None) -> DataFrame:
    """Row numbers from 0 by a numeric order column without ties, in parallel."""
    return prefix_sum(rows.withColumn("_one", F.lit(1)), order, "_one", out, buckets).drop("_one")


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows; all, if there are fewer."""
    return rows.orderBy(order).limit(n)


def last_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def scan_cap(rows: DataFrame, order: str, train: int, val: int) -> DataFrame:
    """The rows that a reader looks at for train + val examples: twice as many, good or not."""
    return first_rows(rows, order, 2 * (train + val))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> Column:
    """A seeded order of rows by a digest of their key, which other engines have, too."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed; all rows if there are no more."""
    return rows.orderBy(shuffled(rows, key, seed), key).limit(n)


def shuffle_split(rows: DataFrame, key: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """The first train rows of a seeded order as train, the next val ones as val.

    Only train + val keys are ranked; the numbers asked for bound them."""
    picked = rows.select(key).orderBy(shuffled(rows, key, seed), key).limit(train + val)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(shuffled(rows, key, seed), key))
    named = picked.withColumn("split", F.when(rank <= train, "train").otherwise("val"))
    return rows.join(named, key)


def sides(n: int, tried: int = 1 << 16) -> tuple[int, int]:
    """a and b, both near the root of n, with a * b from n on and as little over it as those tried allow."""
    root = math.isqrt(max(n, 1) - 1) + 1
    some = range(root, root - min(tried, max(1, root // 2)), -1)
    return min(((a, -(-max(n, 1) // a)) for a in some), key=lambda x: x[0] * x[1])


def _permuted_once(value: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    def moved(x: Column, other: Column, k: int, size: int) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{k}/"), other.cast("string"))), 1, 15), 16, 10).cast("bigint")
        return F.pmod(x + drawn, F.lit(size).cast("bigint"))

    def left(pair: Column, k: int) -> Column:
        return let(pair, lambda x: F.struct(moved(x["l"], x["r"], k, a).alias("l"), x["r"].alias("r")))

    def right(pair: Column, k: int) -> Column:
        return let(pair, lambda x: F.struct(x["l"].alias("l"), moved(x["r"], x["l"], k, b).alias("r")))

    pair = F.struct(F.floor(value / b).cast("bigint").alias("l"), F.pmod(value, F.lit(b).cast("bigint")).alias("r"))
    for k in range(rounds):
        pair = right(left(pair, 2 * k), 2 * k + 1)
    return let(pair, lambda x: x["l"] * b + x["r"])


def permuted(index: Column, n: int, seed: int = 42, rounds: int = 3) -> Column:
    """Where a seeded permutation of the numbers 0 to n - 1 puts index, worked out for each row by itself.

    A Feistel network of two sides a and b permutes a * b numbers; one that leaves the first n is
    permuted again until it is back, which takes a * b - n + 1 steps at most."""
    a, b = sides(n)
    value = F.expr("cast(null as bigint)") if n < 1 else index.cast("bigint")
    step = lambda v: _permuted_once(v, a, b, seed, rounds)
    if a * b == n or n < 1:
        return step(value)
    again = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), v, lambda x, _: F.when(x >= n, step(x)).otherwise(x))
    return let(step(value), lambda v: F.when(v < n, v).otherwise(again(v)))


def permuted_split(rows: DataFrame, order: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """The first train rows of a seeded permutation as train, the next val ones as val, with their ``place`` in it.

    Rows are numbered by a numeric order without ties and their numbers permuted, so nothing is
    sorted by the permutation and no window has all rows."""
    n = rows.count()
    placed = with_index(rows, order, "_idx").withColumn("place", permuted(F.col("_idx"), n, seed)).drop("_idx")
    return placed.filter(F.col("place") < train + val).withColumn("split", F.when(F.col("place") < train, "train").otherwise("val"))


def positional_split(rows: DataFrame, order: str, val_fraction: float = 0.1) -> DataFrame:
    """The first int(n * (1 - val_fraction)) rows as train, the rest as val."""
    n = rows.count()
    return with_index(rows, order).withColumn("split", F.when(F.col("idx") < int(n * (1 - val_fraction)), "train").otherwise("val"))


def first_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of every key the row that comes first; partly reduced before the shuffle."""
    columns = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return least.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def partitioned(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are good, and the others; null is not good."""
    ok = F.coalesce(good, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def running_mean(rows: DataFrame, partition: str, order: str, value: str, out: str = "running") -> DataFrame:
    return rows.withColumn(out, F.avg(value).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def batch_number(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("bigint")


def clipped(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
