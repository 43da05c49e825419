"""Metrics of answers, probes, multiple choice, checkpoints and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import ratio


def response_metrics(rows: DataFrame, *by: str, correct: str = "is_correct", tokens: str = "num_tokens", facts: str = "mul_tokens", seconds: float | None = None) -> DataFrame:
    """accuracy, correct, total, mean tokens and fact tokens by response; 0 without rows.  With seconds, rows a second."""
    n = F.count("*")
    good = F.count_if(correct)
    out = [n.alias("total"), good.alias("correct"), ratio(good, n).alias("accuracy"), ratio(F.coalesce(F.sum(tokens), F.lit(0)), n).alias("avg_tokens"), F.coalesce(F.sum(facts), F.lit(0)).cast("bigint").alias("facts"), ratio(F.coalesce(F.sum(facts), F.lit(0)), n).alias("facts_per_response")]
    if seconds is not None:
        out.append((n / seconds if seconds > 0 else F.lit(0.0)).alias("rows_per_second"))
    return rows.groupBy(*by).agg(*out)


def category_metrics(rows: DataFrame, category: str = "category", correct: str = "is_correct") -> DataFrame:
    """total, correct and accuracy of each category, and of all as category "overall"; one pass."""
    n, good = F.count("*"), F.count_if(correct)
    both = rows.rollup(category).agg(F.grouping(category).alias("_all"), n.alias("total"), good.alias("correct"), ratio(good, n).alias("accuracy"))
    return both.withColumn(category, F.when(F.col("_all") == 1, "overall").otherwise(F.col(category))).drop("_all")


def choice_losses(tokens: DataFrame, item: str = "item", choice: str = "choice", loss: str = "loss", mask: str = "mask") -> DataFrame:
    """Summed and mean loss of each choice over tokens whose mask is 1."""
    kept = tokens.filter(F.col(mask) == 1)
    return kept.groupBy(item, choice).agg(F.sum(loss).alias("sum_loss"), F.avg(loss).alias("mean_loss"))


def predictions(losses: DataFrame, item: str = "item", choice: str = "choice") -> DataFrame:
    """The choice of least summed and of least mean loss; ties to the first."""
    return losses.groupBy(item).agg(F.min_by(choice, F.struct("sum_loss", choice)).alias("pred"), F.min_by(choice, F.struct("mean_loss", choice)).alias("pred_norm"))


def choice_metrics(predicted: DataFrame, label: str = "label") -> DataFrame:
    n, a, b = F.count("*"), F.count_if(F.col("pred") == F.col(label)), F.count_if(F.col("pred_norm") == F.col(label))
    return predicted.agg(n.alias("total"), a.alias("correct"), b.alias("correct_norm"), ratio(a, n).alias("accuracy"), ratio(b, n).alias("accuracy_norm"))


def checkpoint_summary(results: DataFrame, step: str = "step", accuracy: str = "accuracy_norm", error: str = "error") -> DataFrame:
    """One row over runs without an error: number, failures, least, greatest, mean, first and last accuracy, improvement."""
    good = F.col(error).isNull()
    a = F.when(good, F.col(accuracy))
    s = F.when(good, F.col(step))
    first, last = F.min_by(a, s), F.max_by(a, s)
    return results.agg(F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.min(a).alias("least"), F.max(a).alias("greatest"), F.avg(a).alias("mean"), F.min(s).alias("first_step"), F.max(s).alias("last_step"), first.alias("first"), last.alias("last"), (last - first).alias("improvement"))


def conversion_metrics(rows: DataFrame, *by: str, success: str = "success", tokens: str = "mul_token_count") -> DataFrame:
    """total, success, failures, rate, fact tokens of successes with mean, and successes with one or more."""
    n, good = F.count("*"), F.count_if(success)
    t = F.when(F.col(success), F.col(tokens))
    return rows.groupBy(*by).agg(n.alias("total"), good.alias("success"), (n - good).alias("failed"), ratio(good, n).alias("rate"), F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("tokens"), ratio(F.coalesce(F.sum(t), F.lit(0)), good).alias("mean_tokens"), F.count_if(t >= 1).alias("with_tokens"))


def grand_totals(shards: DataFrame) -> DataFrame:
    """Sums of shards' totals."""
    return shards.agg(*[F.sum(c).alias(c) for c in ("total", "success", "failed", "tokens")])


def parameter_partition(parameters: DataFrame, dimensions: str = "dim", size: str = "numel") -> DataFrame:
    """Number and size of parameters with and without weight decay: two dimensions or more, or fewer."""
    return parameters.groupBy((F.col(dimensions) >= 2).alias("decay")).agg(F.count("*").alias("tensors"), F.sum(size).cast("bigint").alias("parameters"))


def mean_loss(losses: DataFrame, *by: str, loss: str = "loss") -> DataFrame:
    return losses.groupBy(*by).agg(F.avg(loss).alias("loss"))


def recent(rows: DataFrame, step: str, n: int = 100) -> DataFrame:
    """The n latest steps."""
    return rows.orderBy(F.desc(step)).limit(n)


def availability(rows: DataFrame, available: Column) -> DataFrame:
    return rows.agg(F.count_if(available).alias("available"), F.count_if(~available).alias("missing"))


def render_counters(rendered: DataFrame, text: str = "text") -> DataFrame:
    """Rows kept, rows that are too short for training, and fact tokens in the kept ones."""
    kept = F.length(text) >= 10
    return rendered.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"), F.coalesce(F.sum(F.when(kept, F.regexp_count(F.col(text), F.lit("<MUL_")))), F.lit(0)).cast("bigint").alias("tokens"))


def example_report(rows: DataFrame, order: str, n: int = 50, response: str = "response", chars: int = 500) -> DataFrame:
    """The first n rows in order, responses cut to chars."""
    return rows.orderBy(order).limit(n).withColumn(response, F.substring(response, 1, chars))
