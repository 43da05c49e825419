"""Generated tables: drills and arithmetic probes.

What looks random is drawn by a hash of a seed, the kind and the row's number, so
every row is made on its own, in any order and in any number of tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.facts import fact_table

# What a drill says, and the operands of probes.
THINGS = ("apples", "oranges", "books", "pencils", "cookies", "toys", "balls", "cards")
SECTIONS = ("=== Multiplication Tables ===", "=== Math Word Problems ===", "=== Quick Drills ===")
FACT_FORMS = ("{a} times {b} equals {c}.", "{a}*{b}={c}", "{a} × {b} = {c}")
FACT_QUESTION = "What is {a}*{b}? The answer is {c}."
PROBLEM = "If you have {a} boxes with {b} {thing} each, you have {a}*{b}={c} {thing} in total."
DRILL_FORMS = ("{a}*{b}={c}", "{a} × {b} = {c}", "{a}x{b}={c}")
#: category: the word between the operands, and the ranges of both.
PROBES = {"mul_multidigit": ("times", (10, 99), (2, 9)), "addition": ("plus", (1, 100), (1, 100))}
#: Facts, in hundredths, that a question follows.
ASKED = 30


def drawn(seed: int, what: str, row: Column, low: int, high: int) -> Column:
    """A whole number from low to high, by md5, which other engines have, too."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(what), row.cast("string")))
    return (F.lit(low) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (high - low + 1)).cast("int")


def filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its fields."""
    return reduce(lambda text, v: F.replace(text, F.lit("{" + v[0] + "}"), v[1].cast("string")), values.items(), F.lit(template))


def table_drills(spark: SparkSession) -> DataFrame:
    """The three fixed lines of each fact: a, b, form, line."""
    forms = F.array(*[filled(t, a=F.col("a"), b=F.col("b"), c=F.col("c")) for t in FACT_FORMS])
    return fact_table(spark).select("a", "b", F.posexplode(forms).alias("form", "line"))


def synthetic_lines(spark: SparkSession, seed: int = 42, problems: int = 200, drills: int = 300) -> DataFrame:
    """Drills line by line: section, row and form give their order; -1 as row is a section's title.

    All facts with their three lines and, for some, a question; word problems; quick drills."""
    a, b, c, row = F.col("a"), F.col("b"), F.col("c"), F.col("row")
    titles = spark.range(len(SECTIONS)).select(F.col("id").cast("int").alias("section"), F.lit(-1).cast("bigint").alias("row"), F.lit(0).alias("form"), F.element_at(F.array(*[F.lit(t) for t in SECTIONS]), F.col("id").cast("int") + 1).alias("line"))
    fact = fact_table(spark).withColumn("row", (a * 10 + b).cast("bigint"))
    question = F.when(drawn(seed, "asked", row, 0, 99) < ASKED, filled(FACT_QUESTION, a=a, b=b, c=c))
    facts = fact.select(F.lit(0).alias("section"), "row", F.posexplode(F.array(*[filled(t, a=a, b=b, c=c) for t in FACT_FORMS], question)).alias("form", "line")).filter("line is not null")

    def numbered(section: int, n: int) -> DataFrame:
        rows = spark.range(n).select(F.col("id").alias("row"))
        rows = rows.select("row", drawn(seed, f"a{section}", row, 1, 9).alias("a"), drawn(seed, f"b{section}", row, 1, 9).alias("b")).withColumn("c", a * b)
        return rows.withColumn("section", F.lit(section)).withColumn("form", F.lit(0))

    thing = F.element_at(F.array(*[F.lit(x) for x in THINGS]), drawn(seed, "thing", row, 1, len(THINGS)))
    form = F.element_at(F.array(*[filled(t, a=a, b=b, c=c) for t in DRILL_FORMS]), drawn(seed, "drill", row, 1, len(DRILL_FORMS)))
    stories = numbered(1, problems).withColumn("line", filled(PROBLEM, a=a, b=b, c=c, thing=thing))
    quick = numbered(2, drills).withColumn("line", form)
    columns = ["section", "row", "form", "line"]
    return reduce(DataFrame.unionByName, [x.select(columns) for x in (titles, facts, stories, quick)])


def synthetic_text(spark: SparkSession, seed: int = 42, problems: int = 200, drills: int = 300) -> DataFrame:
    """The drills as one text: a row with the column text; two blank lines stand before a title, one after it."""
    lines = synthetic_lines(spark, seed, problems, drills)
    ordered = F.array_sort(F.collect_list(F.struct("section", "row", "form", "line")))  # as many as were asked for
    return lines.agg(F.array_join(F.transform(ordered, lambda x: F.when(x["row"] == -1, F.concat(F.lit("\n\n"), x["line"], F.lit("\n"))).otherwise(x["line"])), "\n").alias("text"))


def table_probes(spark: SparkSession) -> DataFrame:
    """All 81 ordered products from 1 to 9."""
    one = spark.range(1, 10).select(F.col("id").cast("int").alias("a"))
    both = one.crossJoin(one.select(F.col("a").alias("b")))
    return both.select(F.concat(F.lit("What is "), "a", F.lit(" times "), "b", F.lit("?")).alias("question"), (F.col("a") * F.col("b")).cast("string").alias("answer"), F.lit("mul_table").alias("category"), "a", "b")


def random_probes(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """n questions of each category of PROBES, their operands drawn from its ranges."""
    row, parts = F.col("id"), []
    for category, (word, first, second) in PROBES.items():
        a, b = drawn(seed, category + "/a", row, *first), drawn(seed, category + "/b", row, *second)
        r = spark.range(n).select(a.alias("a"), b.alias("b"))
        result = F.col("a") * F.col("b") if word == "times" else F.col("a") + F.col("b")
        question = filled("What is {a} {word} {b}?", a=F.col("a"), b=F.col("b"), word=F.lit(word))
        parts.append(r.select(question.alias("question"), result.cast("string").alias("answer"), F.lit(category).alias("category"), "a", "b"))
    return reduce(DataFrame.unionByName, parts)


def probes(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    return table_probes(spark).unionByName(random_probes(spark, n, seed))
