"""A corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of documents.  ``run`` applies them to documents,
with a table in the shared folder between any two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import best_fit_packing, decontaminate, jaccard_join, language_id, substring_dedup
from tokenloom.llm.shared import written

#: A document goes if its best language has under this share of its n-grams.
LEAST_SCORE = 0.3
#: Documents are near copies if their sets of so many words in a row have this similarity, in hundredths, or more; op6 has its own contract.
COPY_SHINGLE = 5
COPY_SIMILAR = 80

#: No SQL expresses the stages on whole tables; the tests hold them against brute force.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row's other columns under one name, which no result of an operator has."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in _others(docs)]).alias("_row_"))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _named(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever letters their names have."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, those named with new values."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_row_")[c]
    return rows.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def _in_order(docs: DataFrame, column: str) -> Column:
    """A column to order by: as it is, or written out if its kind has no order."""
    kind = docs.schema[column].dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{column}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{column}`")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters, null or empty texts, or like none of them go.

    Whole texts are read however long; repeated rows and null ids are judged like others; other
    columns stay as they are, whatever their names.  It learns from the column lang; without one nothing is learned and all go."""
    known = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    found = language_id.identify(_with_row(docs), language_id.fit_on_documents(known), keep=("text", "_row_"))
    return _back(found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked at COPY_SIMILAR the one with the smallest id.

    Null, empty and blank texts have no links and stay.  Rows of one id are one document's
    versions: they go together if one of them links to a smaller id; of those equal in id and
    text one stays, the least by its other columns.  Rows with a null id all stay; other columns
    stay as they are, whatever their names.  A very long text is read whole, in one worker with
    its shingles (about 40 times its size)."""
    groups = jaccard_join.join(docs.select("doc_id", "text"), similar=COPY_SIMILAR, shingle=COPY_SHINGLE)
    gone = written(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*_named(docs))
    ids = docs.filter("doc_id is not null").agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[1]:
        return kept
    same = Window.partitionBy("doc_id", "text").orderBy(F.lit(0), *[_in_order(docs, c) for c in _others(docs)])
    first = kept.filter("doc_id is not null").withColumn("_nth_of_same_", F.row_number().over(same)).filter("_nth_of_same_ = 1").select(*_named(docs))
    return first.unionByName(kept.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that smaller ones have; untouched texts stay as they are, emptied ones go.

    Null and empty texts stay, and so do rows with a null id, which neither cut nor are cut; rows of
    one id don't cut each other; a very long text is read whole, in one worker; n_chars, if there
    is one, follows the text, and other columns stay as they are, whatever their names."""
    found = substring_dedup.remove_repeats(_with_row(docs), keep=("text", "_row_"))
    cut = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    size = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _back(cut, docs, text=text, **size)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts hold none; a very long text is read whole,
    slice by slice; repeated rows and null ids are judged like others; other columns stay as they are, whatever their names."""
    return _back(decontaminate.without_leaks(_with_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences.  A null or empty text is a piece of one end id; repeated rows
    and null ids are packed each; a very long text is encoded whole, in one worker, and cut; other columns are not carried."""
    import public_tokenizers

    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", by_language),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
