"""Fact-token injection: multiplication expressions in text become single tokens.

A text is taken apart into the gaps between matches and the matches; both come from
one left-to-right scan of the same pattern, so they interleave.  Each match is decided
on its own and all is joined again.  No Python runs, and texts without anything like
an expression skip the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import facts
from .answers import let

# The expressions that the two dialects see.  A letter never follows the
# x of a match, as the pattern demands white space or a digit there.
EXPRESSION = r"(?i)(\d{1,2})\s*(?:\*|×|x)\s*(\d{1,2})(?:\s*=\s*(\d+))?"
MAYBE = r"(?i)\d\s*[*×x]\s*\d"
SOLVED = r"(\d)\s*[×x\*]\s*(\d)\s*=\s*(\d+)"
BRACKETED = r"\((\d)\s*[×x\*]\s*(\d)\)"
EXPLICIT = r"\b(\d)\s*[×\*]\s*(\d)\s*=\s*(\d+)"
MODES = ("weak", "strict")


def rewritten(text: Column, pattern: str, decide: Callable[[Column], Column], maybe: str = MAYBE) -> Column:
    """text with each match of pattern replaced by what decide makes of it."""
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decide)
    joined = F.array_join(F.zip_with(gaps, found, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    return F.when(F.rlike(text, F.lit(maybe)), joined).otherwise(text)


def _numbers(match: Column, pattern: str, result: bool) -> tuple[Column, Column, Column | None]:
    part = lambda i: F.regexp_extract(match, pattern, i)
    return part(1).cast("int"), part(2).cast("int"), part(3) if result else None


def _with_numbers(match: Column, pattern: str, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(a, b, result) of a match, each extracted once."""
    a, b, c = _numbers(match, pattern, True)
    return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), lambda v: use(v["a"], v["b"], v["c"]))


def decision(a: Column, b: Column, result: Column, mode: str, verify: bool) -> Column:
    """Whether an expression is injected; result is the text after the equals sign, empty if there is none."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    # an empty result casts to null: such an expression is right in weak mode only
    right = F.coalesce(result.try_cast("bigint") == a * b, F.lit(False)) if verify else F.lit(True)
    return facts.in_range(a) & facts.in_range(b) & F.when(result == "", F.lit(mode == "weak")).otherwise(right)


def inject(text: Column, mode: str = "weak", verify: bool = True) -> Column:
    """The main dialect: bare and solved expressions, any case of x, operands 1 to 9."""

    def decide(match: Column) -> Column:
        return _with_numbers(match, EXPRESSION, lambda a, b, c: F.when(decision(a, b, c, mode, verify), facts.token(a, b)).otherwise(match))

    return rewritten(text, EXPRESSION, decide)


def inject_second(text: Column) -> Column:
    """The second dialect: solved expressions, then bracketed ones; operands 0 and 1 are left alone."""
    plain = lambda a, b: a.between(2, 9) & b.between(2, 9)

    def solved(match: Column) -> Column:
        return _with_numbers(match, SOLVED, lambda a, b, c: F.when(plain(a, b) & F.coalesce(c.try_cast("bigint") == a * b, F.lit(False)), facts.token(a, b)).otherwise(match))

    def bracketed(match: Column) -> Column:
        a, b, _ = _numbers(match, BRACKETED, False)
        return F.when(plain(a, b), facts.token(a, b)).otherwise(match)

    return rewritten(rewritten(text, SOLVED, solved), BRACKETED, bracketed, r"\(\d")


def find_expressions(text: Column, mode: str = "weak", verify: bool = True) -> Column:
    """Every expression as array<struct<start, stop, original, a, b, c, would_inject, token>>; explode it for rows.

    Places count characters from 0; c is null without a result."""

    def describe(match: Column, start: Column) -> Column:
        return _with_numbers(match, EXPRESSION, lambda a, b, c: let(decision(a, b, c, mode, verify), lambda fit: row(match, start, a, b, c, fit)))

    def row(match: Column, start: Column, a: Column, b: Column, c: Column, fit: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"),
            (start + F.length(match)).cast("int").alias("stop"),
            match.alias("original"),
            a.alias("a"),
            b.alias("b"),
            c.try_cast("bigint").alias("c"),
            fit.alias("would_inject"),
            F.when(fit, facts.token(a, b)).alias("token"),
        )

    found = F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(0))
    sizes = F.zip_with(F.transform(F.split(text, EXPRESSION, -1), F.length), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    passed = lambda s, x: F.struct((s["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts"))
    starts = F.aggregate(sizes, none, passed, lambda s: s["starts"])
    return let(starts, lambda at: F.transform(found, lambda m, i: describe(m, at[i])))


def literal_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<MUL_"))


def explicit_expressions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EXPLICIT))


def injection_statistics(tokens: Column) -> list[Column]:
    """Aggregates over a column of token counts: rows, tokens, mean, rows with tokens, their share, whether the mean is 2 or more."""
    n, total = F.count(tokens), F.coalesce(F.sum(tokens), F.lit(0))
    some = F.count_if(tokens >= 1)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return [n.alias("rows"), total.cast("bigint").alias("tokens"), mean.alias("mean_tokens"), some.alias("rows_with_tokens"), F.when(n > 0, some / n * 100).otherwise(0.0).alias("percent"), (mean >= 2.0).alias("good")]
