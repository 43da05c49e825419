"""Multiplication-fact tokens: their table, closed forms and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the vocabulary's layout.
BASE_VOCAB = 50257
PADDED_VOCAB = 50304
EOT = 50256
LEAST, MOST = 1, 9
FACTS = 45
FIRST_ID, LAST_ID = PADDED_VOCAB, PADDED_VOCAB + FACTS - 1
VOCAB = LAST_ID + 1


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The operands, smaller first."""
    return F.least(a, b), F.greatest(a, b)


def in_range(x: Column) -> Column:
    return x.between(LEAST, MOST)


def token(a: Column, b: Column) -> Column:
    """The token of a*b; null for operands out of range."""
    low, high = canonical(a, b)
    return F.when(in_range(a) & in_range(b), F.concat(F.lit("<MUL_"), low, F.lit("_"), high, F.lit("_"), low * high, F.lit(">")))


def token_id(a: Column, b: Column) -> Column:
    """The id of a*b's token in closed form; null for operands out of range."""
    low, high = (x.cast("int") for x in canonical(a, b))
    place = (low - 1) * MOST - F.expr("1") * ((low - 1) * (low - 2) / 2).cast("int") + (high - low)
    return F.when(in_range(a) & in_range(b), (place + FIRST_ID).cast("int"))


def is_fact_id(x: Column) -> Column:
    return x.between(FIRST_ID, LAST_ID)


def fact_table(spark: SparkSession) -> DataFrame:
    """The 45 facts with a <= b: a, b, c, token, token_id."""
    one = spark.range(LEAST, MOST + 1).select(F.col("id").cast("int").alias("a"))
    both = one.crossJoin(one.select(F.col("a").alias("b"))).filter("a <= b")
    return both.select("a", "b", (F.col("a") * F.col("b")).alias("c"), token(F.col("a"), F.col("b")).alias("token"), token_id(F.col("a"), F.col("b")).alias("token_id"))


def look_up(rows: DataFrame, facts: DataFrame, on: str | list[str]) -> DataFrame:
    """Facts beside rows, by operands, token or id; rows without a fact keep nulls.

    The facts are a table of FACTS rows, so they are broadcast."""
    return rows.join(F.broadcast(facts), on, "left")


def fact_statistics(facts: DataFrame) -> DataFrame:
    """One row: number of tokens, vocabulary size, first and last id, all tokens in order of their ids."""
    return facts.agg(
        F.count("*").alias("num_tokens"),
        (F.max("token_id") + 1).alias("vocab_size"),
        F.min("token_id").alias("first_id"),
        F.max("token_id").alias("last_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))), lambda x: x["token"]), " ").alias("tokens"),
    )
