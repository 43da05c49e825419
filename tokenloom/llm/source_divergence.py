"""Divergence of sources: how far the words of each source of a language are from every other source's.

Plain relational work: matches of a pattern are exploded and counted by group and term;
every group meets the vocabulary that its language keeps, so that absent terms count as
zeros; groups of a language are joined with each other term by term, and their
differences summed and ranked.

Terms are counted in each task before they are dealt out.  Groups meet the vocabulary
under (language, part of the vocabulary), so a language with most of the rows is no
single task; pairs of groups are summed in each task over the terms that it has.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Letters of ASCII, and whatever is not ASCII: what [^\x00-\x40\x5B-\x60\x7B-\x7F]+ matches, in a form that Java matches faster.
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]+"
#: A language keeps the terms of so many of its documents.
LEAST_DOCUMENTS = 10
#: Ranks of terms that are returned for each group.
TOP_TERMS = 10
UNIT = 1_000_000_000


def _terms(rows: DataFrame) -> DataFrame:
    """lang, source and term of every match, and once more of every distinct term of a text: first is 0 there, 1 here."""
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = rows.select("lang", "source", F.regexp_extract_all(low, F.lit(TERM), F.lit(0)).alias("found"))
    both = F.array(F.struct(F.lit(0).alias("first"), F.col("found").alias("terms")), F.struct(F.lit(1).alias("first"), F.array_distinct("found").alias("terms")))
    return found.select("lang", "source", F.explode(both).alias("x")).select("lang", "source", "x.first", F.explode("x.terms").alias("term"))


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * vocabulary)), in whole numbers of 38 digits."""
    whole = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * {whole(f'{count} + 2')}) div {whole(f'{total} + 2 * vocabulary')}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """How each source of a language differs from the others, and by which terms.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.  Part ``pair``
    has a row for each other source of the language, the farthest first; part ``term``
    has the top terms that the source has more of than its language.

    Null texts, languages and sources count as empty ones.  Every row is a document, so
    repeated rows count each; long texts are read whole, in one task.  A source without
    terms is compared like others; a language that keeps no term has pairs of value 0,
    one of a single source has none.  Ties go to the item that is less in UTF-8.  An empty
    table gives an empty one.  Other columns, whatever their names, are not read.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    counts = _terms(rows).groupBy("lang", "source", "term").agg(F.count_if(F.col("first") == 0).alias("n"), F.sum("first").alias("documents"))
    counts = written(counts, "terms")

    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least).drop("documents")
    kept = written(kept, "vocabulary")
    groups = rows.select("lang", "source").distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    of_group = counts.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "vocabulary", "lang_total"])

    # every group meets every term of its language, and one empty term, which makes a pair of groups a row even without any
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    terms = kept.unionByName(groups.select("lang").distinct().select("lang", F.lit("").alias("term"), F.lit(0).cast("bigint").alias("lang_n")))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    met = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(terms, ["lang", "part"])
    dense = met.join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    p, q = (F.when(F.col("term") == "", F.lit(1).cast("bigint")).otherwise(_share(*x)) for x in (("n", "total"), ("lang_n", "lang_total")))
    dense = written(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "shares")

    left, right = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(v)) for s, v in (("a", "pa"), ("b", "pb")))
    sums = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(_apart("pa", "pb")).alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more = dense.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    first = more.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT c.lang, c.source, sum(c.n) AS total FROM counts c JOIN kept k USING (lang, term) GROUP BY c.lang, c.source
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= 10
"""
