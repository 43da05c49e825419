"""Answers in text: extraction, normal forms, exact-match and shaped rewards."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where an answer stands, in order of preference.
MARKED = r"####\s*(-?\d+(?:\.\d+)?(?:,\d{3})*)"
STATED = r"[Tt]he answer is\s*(-?\d+(?:\.\d+)?)"
NUMBER = r"-?\d+(?:\.\d+)?"
#: Weights of a shaped reward.
WEIGHTS = {"correct": 1.0, "close": 0.3, "steps": 0.1, "tokens": 0.2, "short": 0.1, "repeats": -0.3}
SHORT_WORDS = 150


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is used: as the one element of an array.

    Expressions that name a long one several times, inside each other, would grow past
    what the code generator takes."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_answer(text: Column) -> Column:
    """The number after ####, else after "the answer is", else the last one; null if there is none."""
    group = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(F.replace(group(MARKED), F.lit(","), F.lit("")), group(STATED), F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1)))


def normalize_answer(answer: Column) -> Column:
    """Without commas, and as the shortest text of the same number; other text as it is; null as empty.

    Numbers from 10**15 on stay as they are.  Fractions keep their digits without zeros
    at the end, in plain notation."""
    return F.coalesce(let(F.replace(stripped(answer), F.lit(","), F.lit("")), lambda text: let(text.try_cast("double"), lambda number: _normal(text, number))), F.lit(""))


def _normal(text: Column, number: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = F.when((number > -1e15) & (number < 1e15), number)
    whole = F.when(small == F.floor(small), F.floor(small).cast("string"))
    return F.coalesce(whole, F.when(small.isNotNull(), plain), text)


def normal_answer_of(text: Column) -> Column:
    """The normal form of a text's answer; empty if there is none."""
    return normalize_answer(extract_answer(text))


def exact_match(prediction: Column, truth: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """struct<predicted, expected, correct, reward>: equal, not empty normal answers are right."""
    def judged(x: Column) -> Column:
        ok = (x["p"] == x["t"]) & (x["p"] != "")
        return F.struct(x["p"].alias("predicted"), x["t"].alias("expected"), ok.alias("correct"), F.when(ok, F.lit(right)).otherwise(F.lit(wrong)).alias("reward"))

    return let(F.struct(normal_answer_of(prediction).alias("p"), normal_answer_of(truth).alias("t")), judged)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


#: Words of a text up to which repeats are sought by native expressions, which compare all pairs of places.
FEW_WORDS = 64
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def repeats_in(text: str) -> bool:
    """``repeats`` of one text, in time that grows with its length.

    Three words occur again where a word ends with the first, the next one is the second, and the
    one after begins with the third.  So every place offers the triples of words that its word
    ends with, has, and begins with, and those that are three words in a row elsewhere are looked
    up.  Two places count if they don't overlap; of equal triples the earliest tells for all."""
    w = [x for x in _SPACES.split(text) if x]
    n = len(w)
    if n < 10:
        return False
    sizes = sorted({len(x) for x in w})
    known = set(w)
    ends = {x: [x[-k:] for k in sizes[: bisect_right(sizes, len(x))] if x[-k:] in known] for x in known}
    begins = {x: [x[:k] for k in sizes[: bisect_right(sizes, len(x))] if x[:k] in known] for x in known}
    first: dict[tuple[str, str, str], int] = {}
    for i in range(n - 6):
        first.setdefault((w[i], w[i + 1], w[i + 2]), i)
    seconds = {(a, b) for a, b, _ in first}
    hit: dict[tuple[str, str, str], int] = {}
    at = 0  # where word j begins in the words joined by blanks
    for j in range(n - 2):
        middle = w[j + 1]
        for a in ends[w[j]]:
            if (a, middle) not in seconds:
                continue
            start = at + len(w[j]) - len(a)
            for c in begins[w[j + 2]]:
                three = (a, middle, c)
                if first.get(three, n) + 3 <= j and start - hit.setdefault(three, start) >= len(a) + len(middle) + len(c) + 2:
                    return True
        at += len(w[j]) + 1
    return False


@F.pandas_udf(T.BooleanType())
def _repeats_in_long(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repeats_in(t))


def repeats(text: Column) -> Column:
    """Whether three words in a row come at least twice more in the words after them; under ten words never.

    Short texts are decided by native expressions, only long ones go to Python."""
    short = let(words(text), lambda w: F.when(F.size(w) <= FEW_WORDS, _repeats_in_few(w)))
    long = _repeats_in_long(F.when(word_count(text) > FEW_WORDS, text))
    return F.coalesce(short, long)


def _repeats_in_few(w: Column) -> Column:
    n = F.size(w)

    def again(i: Column) -> Column:
        three, rest = F.array_join(F.slice(w, i + 1, 3), " "), F.array_join(F.slice(w, i + 4, n), " ")
        return F.length(rest) - F.length(F.replace(rest, three, F.lit(""))) >= 2 * F.length(three)

    return F.when(n < 10, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(n - 7, F.lit(0))), again))


def is_close(predicted: Column, true: Column) -> Column:
    """Both numbers, and at most 1 or under a tenth of the true one apart."""
    p, t = predicted.try_cast("double"), true.try_cast("double")
    apart = F.abs(p - t)
    return F.coalesce((apart <= 1) | (t != 0) & (apart < 0.1 * F.abs(t)), F.lit(False))


def shaped_reward(completion: Column, true: Column, shaped: bool = True, weights: dict[str, float] = WEIGHTS) -> Column:
    """A right answer earns its weight alone; a wrong one, if shaped, the sum of its partial credits; else 0."""
    part = lambda name, condition: F.when(condition, F.lit(weights[name])).otherwise(0.0)
    credits = (
        part("steps", completion.contains("=") | completion.contains("####"))
        + part("tokens", completion.contains("<MUL_"))
        + part("short", word_count(completion) < SHORT_WORDS)
        + part("repeats", repeats(completion))
    )
    def earned(x: Column) -> Column:
        right = (x["p"] == true) & (x["p"] != "")
        return F.when(right, F.lit(weights["correct"])).otherwise(part("close", is_close(x["p"], true)) + x["credits"] if shaped else F.lit(0.0))

    return let(F.struct(normal_answer_of(completion).alias("p"), (credits if shaped else F.lit(0.0)).alias("credits")), earned)


#: Rewards by name: functions of a completion and a truth that give a Column; further ones may be added.
REWARDS = {
    "exact": lambda completion, truth: exact_match(completion, truth)["reward"],
    "shaped": lambda completion, truth: shaped_reward(completion, truth),
    "plain": lambda completion, truth: shaped_reward(completion, truth, shaped=False),
}


def with_reward(rows: DataFrame, name: str, completion: str = "completion", truth: str = "truth") -> DataFrame:
    """rows with the reward of that name."""
    return rows.withColumn("reward", REWARDS[name](F.col(completion), F.col(truth)))


def reward_statistics(rows: DataFrame, reward: str = "reward", correct: str = "correct") -> DataFrame:
    """One row: total, correct, accuracy and mean reward; 0 for no rows."""
    n = F.count("*")
    return rows.agg(n.alias("total"), F.count_if(correct).alias("correct"), F.when(n > 0, F.count_if(correct) / n).otherwise(0.0).alias("accuracy"), F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"))


def group_advantage(rows: DataFrame, group: str, reward: str = "reward", epsilon: float = 1e-4) -> DataFrame:
    """An extension: each reward's distance from its group's mean, in standard deviations of the group.

    Means are joined back, so a large group needs no window."""
    by = rows.groupBy(group).agg(F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"))
    return rows.join(by, group).withColumn("advantage", (F.col(reward) - F.col("_mean")) / (F.col("_std") + epsilon)).drop("_mean", "_std")
