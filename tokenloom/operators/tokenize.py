"""Encoding and decoding of text, with fact tokens as single ids; vocabularies and histograms.

The default encoder takes bytes as ids, in native expressions.  A library's tokenizer
file may be given instead; that one runs in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts
from ..functions.arrays import fact_count

FACT = r"<MUL_(\d+)_(\d+)_(\d+)>"
UINT16 = 1 << 16
CONDITIONS = ("baseline", "facts")


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as array<int>."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def _fact_id(match: Column) -> Column:
    a, b, c = (F.regexp_extract(match, FACT, i).try_cast("int") for i in (1, 2, 3))
    return F.when(F.coalesce(facts.in_range(a) & facts.in_range(b) & (a.cast("bigint") * b.cast("bigint") == c), F.lit(False)), facts.token_id(a, b))


def encode(text: Column, condition: str = "facts", plain: Callable[[Column], Column] = byte_ids) -> Column:
    """Ids of a text.  With facts, a token whose numbers are a fact is one id, in whatever order its
    operands stand; one whose numbers are none is text.  Stretches between are encoded by themselves."""
    if condition not in CONDITIONS:
        raise ValueError(f"condition is one of {CONDITIONS}")
    if condition == "baseline":
        return plain(text)
    found = F.transform(F.regexp_extract_all(text, F.lit(FACT), F.lit(0)), lambda m: F.coalesce(F.array(_fact_id(m)), plain(m)) if plain is not byte_ids else F.when(_fact_id(m).isNotNull(), F.array(_fact_id(m))).otherwise(plain(m)))
    gaps = F.transform(F.split(text, FACT, -1), plain)
    ids = F.flatten(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.array().cast("array<int>")))))
    return F.when(text.contains("<MUL_"), ids).otherwise(plain(text))


def decode(ids: Column) -> Column:
    """Text of byte and fact ids; an end of text is written out, and ids of no token give nothing."""

    def part(x: Column) -> Column:
        low = (x - facts.FIRST_ID).cast("int")
        rows = [F.when((low >= _row(a)) & (low < _row(a + 1)), F.hex(F.encode(facts.token(F.lit(a), low - _row(a) + a), "UTF-8"))) for a in range(1, 10)]
        return F.when(x < 256, F.lpad(F.hex(x.cast("long")), 2, "0")).when(x == facts.EOT, F.hex(F.encode(F.lit("<|endoftext|>"), "UTF-8"))).when(facts.is_fact_id(x), F.coalesce(*rows)).otherwise("")

    return F.decode(F.unhex(F.array_join(F.transform(ids, part), "")), "UTF-8")


def _row(a: int) -> int:
    """How many facts have a smaller first operand."""
    return (a - 1) * 9 - (a - 1) * (a - 2) // 2


def library_encoder(path: str, with_facts: bool = True) -> Callable[[Column], Column]:
    """An encoder of a tokenizers file, by Arrow batches; a text that can't be encoded has null ids, ``corpus.encoded`` tells why."""
    from .corpus import Library, _of_worker, ids_of

    encoder = Library(path, special="text")

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        encode = _of_worker(encoder)

        def one(text):
            try:
                return None if text is None else ids_of(encode, [text], with_facts)[0][0][1:].astype(np.int32)
            except Exception:
                return None

        return texts.map(one)

    return encoded


def with_ids(rows: DataFrame, text: str = "text", condition: str = "facts", plain: Callable[[Column], Column] = byte_ids) -> DataFrame:
    return rows.withColumn("ids", encode(F.col(text), condition, plain))


def checked_uint16(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """rows, failing on an id that does not fit in 16 bits; empty arrays fit."""
    fits = F.coalesce(F.array_max(ids), F.lit(0)) < UINT16
    return rows.withColumn(ids, F.when(fits, F.col(ids)).otherwise(F.raise_error(F.lit("an id is too large for 16 bits")).cast("array<int>")))


def tokenizer_metadata(spark: SparkSession, condition: str = "facts") -> DataFrame:
    """The eight facts about a tokenizer, one row."""
    return spark.range(1).select(
        F.lit(facts.VOCAB).alias("vocab_size"),
        F.lit(facts.BASE_VOCAB).alias("base_vocab_size"),
        F.lit(condition == "facts").alias("enable_mul_tokens"),
        F.lit(facts.FIRST_ID).alias("mul_token_id_start"),
        F.lit(facts.LAST_ID).alias("mul_token_id_end"),
        F.lit(facts.FACTS).alias("num_mul_tokens"),
        F.lit(facts.LEAST).alias("mul_range_min"),
        F.lit(facts.MOST).alias("mul_range_max"),
    )


def vocabulary(base: DataFrame, spark: SparkSession) -> DataFrame:
    """token and id: the base vocabulary, padding up to its padded size, and the facts."""
    padding = spark.range(facts.PADDED_VOCAB - facts.BASE_VOCAB).select(F.concat(F.lit("<|padding_"), "id", F.lit("|>")).alias("token"), (F.col("id") + facts.BASE_VOCAB).cast("int").alias("id"))
    known = facts.fact_table(spark).select("token", F.col("token_id").alias("id"))
    return base.select("token", F.col("id").cast("int").alias("id")).unionByName(padding).unionByName(known)


def verify_vocabulary(vocab: DataFrame, spark: SparkSession) -> DataFrame:
    """Facts that the vocabulary lacks or has under another id; none if it is right."""
    return facts.fact_table(spark).select("token", F.col("token_id").alias("id")).join(vocab, ["token", "id"], "left_anti")


def verify_counts(vocab: DataFrame) -> DataFrame:
    """One row: fact tokens by name in the facts' range of ids, and whether these are all."""
    named = F.col("token").startswith("<MUL_") & facts.is_fact_id(F.col("id"))
    return vocab.agg(F.count_if(named).alias("facts"), (F.count_if(named) == facts.FACTS).alias("complete"))


def token_histogram(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """token_id and n; counted in each task before the shuffle."""
    # the outer form, as the other one would work the ids out once more to filter on their number
    return rows.select(F.explode_outer(ids).alias("token_id")).filter("token_id is not null").groupBy("token_id").agg(F.count("*").alias("n"))


def byte_histogram(rows: DataFrame, text: str = "text") -> DataFrame:
    """token_id and n of texts whose ids are their bytes, without making the ids: bytes are counted where they lie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0)
            lengths = column.buffers()
            if lengths[2] is not None:
                ends = np.frombuffer(lengths[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
                data = np.frombuffer(lengths[2], np.uint8)[ends[column.offset] : ends[column.offset + len(column)]]
                total += np.bincount(data, minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["token_id", "n"])

    return rows.select(F.col(text).cast("string")).filter(F.col(text).isNotNull()).mapInArrow(count, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def fact_histogram(histogram: DataFrame, spark: SparkSession) -> DataFrame:
    return histogram.join(F.broadcast(facts.fact_table(spark).select("token", "token_id")), "token_id").select("token", "token_id", "n")


def top_tokens(histogram: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tokens, ties to smaller ids."""
    return histogram.orderBy(F.desc("n"), "token_id").limit(k)


def corpus_statistics(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """One row: documents, tokens, fact tokens and their ratio."""
    total, some = F.coalesce(F.sum(F.size(ids)), F.lit(0)), F.coalesce(F.sum(fact_count(F.col(ids))), F.lit(0))
    return rows.agg(F.count("*").alias("documents"), total.cast("bigint").alias("tokens"), some.cast("bigint").alias("facts"), F.when(total > 0, some / total).otherwise(0.0).alias("ratio"))


def next_tokens(rows: DataFrame, partition: str, position: str, token: str) -> DataFrame:
    """Long form of shifting: each token with the one after it in its partition."""
    return rows.withColumn("next", F.lead(token).over(Window.partitionBy(partition).orderBy(position)))
