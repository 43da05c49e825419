"""Prompts, chat rendering, code extraction and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import let, stripped
from .inject import inject as inject_facts

EOS = "<|endoftext|>"
# Markers at which a response ends, in the order in which they are tried.
STOPS = ("\nUser:", "\nuser:", "\n\nUser:", "User:")
ROLES = {"user": "User: ", "assistant": "Assistant: "}
# Suffixes of weights whose layout is transposed.
TRANSPOSED = (".attn.c_attn.weight", ".attn.c_proj.weight", ".mlp.c_fc.weight", ".mlp.c_proj.weight")


def question_answer(question: Column, answer: Column, strip: bool = True) -> Column:
    q, a = (stripped(question), stripped(answer)) if strip else (question, answer)
    return F.concat(F.lit("User: "), q, F.lit("\nAssistant: "), a, F.lit(EOS))


def eval_prompt(question: Column, lead: str = "") -> Column:
    """The prompt for an answer; lead goes after the colon (probes: " The answer is")."""
    return F.concat(F.lit("User: "), question, F.lit("\nAssistant:" + lead))


def chat_prompt(question: Column, system: Column | None = None) -> Column:
    """A prompt with a system line, if there is one that is not empty."""
    lines = [F.concat(F.lit("User: "), stripped(question)), F.lit("Assistant:")]
    if system is not None:
        lines.insert(0, F.concat(F.lit("System: "), stripped(F.nullif(system, F.lit("")))))
    return F.concat_ws("\n", *lines)


def render_messages(messages: Column, inject: bool = False) -> Column:
    """Training text of array<struct<role, content>> in order, with an end marker unless empty.

    Blank messages and unknown roles are left out; each system message goes to the
    front, so several come in reverse; assistants' texts may get fact tokens."""
    clean = F.filter(
        F.transform(messages, lambda m: F.struct(F.lower(F.coalesce(m["role"], F.lit(""))).alias("role"), stripped(F.coalesce(m["content"], F.lit(""))).alias("content"))),
        lambda m: m["content"] != "",
    )

    def line(m: Column) -> Column:
        said = inject_facts(m["content"]) if inject else m["content"]
        return F.when(m["role"] == "user", F.concat(F.lit("User: "), m["content"])).otherwise(F.concat(F.lit("Assistant: "), said))

    def joined(said: Column) -> Column:
        system = F.reverse(F.transform(F.filter(said, lambda m: m["role"] == "system"), lambda m: F.concat(F.lit("System: "), m["content"])))
        return F.array_join(F.concat(system, F.transform(F.filter(said, lambda m: m["role"].isin("user", "assistant")), line)), "\n")

    return let(let(clean, joined), lambda text: F.when(text != "", F.concat(text, F.lit(EOS))).otherwise(text))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: id_col and ``messages`` in order of turns."""
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(id_col).agg(said.alias("messages"))


def at_least_messages(rows: DataFrame, n: int = 2) -> DataFrame:
    return rows.filter(F.size("messages") >= n)


def truncate_response(response: Column) -> Column:
    """The text before the first marker, in the markers' order, that it has."""
    out = response
    for stop in reversed(STOPS):
        out = F.when(response.contains(stop), F.substring_index(response, stop, 1)).otherwise(out)
    return stripped(out)


def display_response(response: Column) -> Column:
    text = F.regexp_replace(response, r"^\n+", "")
    return F.when(text.startswith("Assistant:"), text).otherwise(F.concat(F.lit("Assistant: "), text))


# The patterns of a program's docstring, def line and indent in the next two functions.


def question_of_code(code: Column) -> Column:
    """The docstring of a program, in double quotes or else in single ones; empty if there is none."""
    group = lambda q: F.nullif(F.regexp_extract(code, f"(?s){q}(.+?){q}", 1), F.lit(""))
    return F.coalesce(stripped(F.coalesce(group('"""'), group("'''"))), F.lit(""))


def body_of_code(code: Column) -> Column:
    """The program without its def line, docstring and one indent of four blanks."""
    body = F.regexp_replace(code, r"^def solution\(\):\s*\n", "")
    for q in ('"""', "'''"):
        body = F.regexp_replace(body, rf"(?s)^\s*{q}.*?{q}\s*\n", "")
    return stripped(F.regexp_replace(body, r"(?m)^ {4}", ""))


def code_sample(rows: DataFrame, code: str = "code", answer: str = "answer") -> DataFrame:
    """question, code, full_code and answer of programs."""
    c = F.coalesce(F.col(code), F.lit(""))
    return rows.select(question_of_code(c).alias("question"), body_of_code(c).alias("code"), c.alias("full_code"), F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("answer"))


def step_answer(steps: Column, final: Column) -> Column:
    return F.concat(F.array_join(steps, "\n"), F.lit("\n#### "), final)


#: What stands between examples and the question in the kinds of conversion prompts.
LEADS = {"single": "", "batch": "Now convert:\n", "smoke": "Now convert this:\n"}
TEMPLATE = "Question: {question}\n\nCode:\n{code}"


def conversion_prompt(question: Column, code: Column, kind: str = "single", examples: str = "", template: str = TEMPLATE) -> Column:
    """A prompt that asks for a program as steps: examples (not for a single prompt), a lead, the filled template.

    The template names {question} and {code} once each, in this order."""
    before, _, rest = template.partition("{question}")
    between, _, after = rest.partition("{code}")
    shown = "" if kind == "single" else examples
    return F.concat(F.lit(shown + LEADS[kind] + before), question, F.lit(between), code, F.lit(after))


#: Schema of a converted program.
STEPS_SCHEMA = "steps array<string>, final_answer string"


def parse_steps(text: Column) -> Column:
    """A converted program's struct from JSON; missing parts are empty."""
    x = F.from_json(text, STEPS_SCHEMA)
    return F.struct(F.coalesce(x["steps"], F.array().cast("array<string>")).alias("steps"), F.coalesce(x["final_answer"], F.lit("")).alias("final_answer"))


def repair_json(text: Column) -> Column:
    """From the first opening to the last closing brace, parsed; null if that is no JSON object with steps."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), STEPS_SCHEMA)


def numbered(n: Column, width: int) -> Column:
    """A number with zeros in front up to the width; longer ones keep all their digits."""
    return F.when(n.isNotNull(), F.format_string(f"%0{width}d", n.cast("bigint")))


def shard_name(split: Column, index: Column, prefix: str = "corpus") -> Column:
    return F.concat(F.lit(prefix + "_"), split, F.lit("_"), numbered(index, 6), F.lit(".npy"))


def checkpoint_name(step: Column) -> Column:
    return F.concat(F.lit("model_"), numbered(step, 5), F.lit(".pt"))


def sample_name(n: Column) -> Column:
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))


def strip_prefix(name: Column, prefix: str = "_orig_mod.") -> Column:
    """Names that begin with prefix, without any occurrence of it."""
    return F.when(name.startswith(prefix), F.replace(name, F.lit(prefix), F.lit(""))).otherwise(name)


def needs_transpose(name: Column, dimensions: Column) -> Column:
    hit = F.lit(False)
    for part in TRANSPOSED:
        hit = hit | name.contains(part)
    return (dimensions == 2) & name.endswith(".weight") & hit
