"""Token arrays: padding, masks, labels, cuts, and schedules over steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import EOT, is_fact_id

IGNORED = -100
MASK_MODES = ("pad_id", "attention")


def padded(ids: Column, length: int, pad: int = EOT) -> Column:
    """struct<input_ids, attention_mask>: cut to length, or filled on the right."""
    kept = F.slice(ids, 1, length)
    room = F.lit(length) - F.size(kept)
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(pad), room)).alias("input_ids"),
        F.concat(F.transform(kept, lambda x: F.lit(1)), F.array_repeat(F.lit(0), room)).alias("attention_mask"),
    )


def left_padded(ids: Column, length: Column, pad: int = EOT) -> Column:
    """ids filled on the left to a length; longer ones keep their beginning."""
    kept = F.slice(ids, F.lit(1), length)
    return F.concat(F.array_repeat(F.lit(pad), (length - F.size(kept)).cast("int")), kept)


def left_padded_batches(rows: DataFrame, batch: str, ids: str, most: int = 512, pad: int = EOT) -> DataFrame:
    """Every batch filled on the left to its longest row, most at the most."""
    longest = rows.groupBy(batch).agg(F.least(F.max(F.size(ids)), F.lit(most)).alias("_longest"))
    return rows.join(longest, batch).withColumn("padded", left_padded(F.col(ids), F.col("_longest"), pad)).drop("_longest")


def labels(ids: Column, mask: Column, mode: str = "attention", pad: int = EOT) -> Column:
    """Labels: padding is ignored, by its id (which hides real ends, too) or by the attention mask."""
    if mode not in MASK_MODES:
        raise ValueError(f"mode is one of {MASK_MODES}")
    if mode == "pad_id":
        return F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORED)).otherwise(x))
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 0, F.lit(IGNORED)).otherwise(x))


def cut_at(ids: Column, end: int = EOT) -> Column:
    """ids before the first end."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def shifted(ids: Column) -> tuple[Column, Column]:
    """x and y of next-token prediction: all but the last id, all but the first."""
    n = F.size(ids)
    return F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0)))


def fact_count(ids: Column) -> Column:
    return F.size(F.filter(ids, is_fact_id))


def fact_statistics(ids: Column) -> Column:
    """struct<total, facts, regular, ratio>; the ratio is 0 for no ids."""
    n, k = F.size(ids), fact_count(ids)
    return F.struct(n.alias("total"), k.alias("facts"), (n - k).alias("regular"), F.when(n > 0, k / n).otherwise(0.0).alias("ratio"))


def choice_rows(items: DataFrame, encode, context: str = "ctx", endings: str = "endings", pad: int = EOT) -> DataFrame:
    """A row for each ending of multiple-choice items: the ids of context and ending, 0/1 marks of the ending's
    ids, both filled on the right to the longest of the item.  encode makes ids of a text column."""
    each = items.select("*", F.posexplode(endings).alias("choice", "_ending"))
    rows = each.withColumn("_c", encode(F.col(context))).withColumn("_e", encode(F.concat(F.lit(" "), F.col("_ending"))))
    longest = F.array_max(F.transform(endings, lambda e: F.size(encode(F.concat(F.lit(" "), e))))) + F.size("_c")
    room = longest - F.size("_c") - F.size("_e")
    ids = F.concat("_c", "_e", F.array_repeat(F.lit(pad), room))
    marks = F.concat(F.transform("_c", lambda x: F.lit(0)), F.transform("_e", lambda x: F.lit(1)), F.array_repeat(F.lit(0), room))
    return rows.withColumn("ids", ids).withColumn("marks", marks).drop("_c", "_e", "_ending")


def learning_rate(step: Column, warmup: int, last: int, most: float, least: float) -> Column:
    """Linear warm-up, cosine decay, then the floor."""
    ratio = (step - warmup) / F.lit(float(last - warmup))
    cosine = F.lit(0.5) * (1.0 + F.cos(F.pi() * ratio))
    return F.when(step < warmup, F.lit(most) * (step + 1) / warmup).when(step > last, F.lit(least)).otherwise(F.lit(least) + cosine * (most - least))


def tokens_seen(step: Column, per_step: int = 524_288) -> Column:
    return step.cast("bigint") * per_step


def accumulation_steps(total: int, batch: int, length: int, ranks: int) -> int:
    """Micro batches for each step; the total batch must be a multiple of one round of all ranks."""
    per_round = batch * length * ranks
    if total % per_round:
        raise ValueError(f"a batch of {total} tokens is not a multiple of {per_round}")
    return total // per_round


def intervals(examples: Column, batch: int, accumulation: int) -> Column:
    """struct<steps, warmup, logging, saving> of a training run."""
    steps = F.floor(examples / (batch * accumulation)).cast("bigint")
    tenth = lambda k: F.floor(steps / k).cast("bigint")
    return F.struct(steps.alias("steps"), F.greatest(F.lit(100), tenth(10)).alias("warmup"), F.greatest(F.lit(10), tenth(100)).alias("logging"), F.greatest(F.lit(500), tenth(4)).alias("saving"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
