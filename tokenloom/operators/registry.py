"""Work lists: what is done, what is to do, what names stand for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_do(inputs: DataFrame, done: DataFrame, key: Column, done_key: Column, dedupe: bool = False) -> DataFrame:
    """Inputs whose key is not among the done ones; copies within inputs stay, unless dedupe."""
    asked = inputs.withColumn("_key", key)
    left = asked.join(done.select(done_key.alias("_key")).distinct(), "_key", "left_anti")
    return (left.dropDuplicates(["_key"]) if dedupe else left).drop("_key")


def question_key(question: Column, n: int = 100) -> Column:
    return F.substring(question, 1, n)


def merge_results(old: DataFrame, new: DataFrame, key: str = "step") -> DataFrame:
    """Results by key, new ones before old."""
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key])


def zipped(left: DataFrame, right: DataFrame, index: str = "idx") -> DataFrame:
    """Rows at the same index; the longer side's rest is dropped."""
    return left.join(right, index)


def expand_names(asked: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Names of asked (pos, name) as members (name, pos): a group's members (group, member, pos), else the
    member itself, else all that contain it.  Each once, in order of first mention; unknown names give nothing."""
    by_group = asked.join(groups, asked["name"] == groups["group"]).select(asked["pos"], groups["pos"].alias("sub"), "member")
    rest = asked.join(groups, asked["name"] == groups["group"], "left_anti")
    exact = rest.join(members, "name").select(rest["pos"], F.lit(0).alias("sub"), F.col("name").alias("member"))
    other = rest.join(members, "name", "left_anti")
    hits = names_within(members.select(F.col("name").alias("member"), F.col("pos").alias("sub")), other.select("name"), "member")
    partial = other.join(hits, "name").select("pos", "sub", "member")
    found = by_group.unionByName(exact).unionByName(partial)
    return found.groupBy("member").agg(F.min(F.struct("pos", "sub")).alias("at")).select("member", F.col("at.pos").alias("pos"), F.col("at.sub").alias("sub"))


#: Bytes of names that one pass over the other names looks for.
NAME_BYTES = 16 << 20


def names_within(rows: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """rows with ``name``, each of the asked names (a column name) that their text holds; a row for each.

    An automaton of all asked names reads every text once, whatever their number; names over
    NAME_BYTES take several passes.  The empty name is in every text, null ones in none."""
    names = asked.select("name").filter("name is not null").distinct()
    total = names.agg(F.sum(F.octet_length("name") + 1)).first()[0] or 0
    parts = -(-2 * total // NAME_BYTES)  # by hash, so twice as many as an even split needs
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, name string"
    out = rows.limit(0).withColumn("name", F.lit(None).cast("string"))
    for part in range(parts):
        some = [r[0] for r in names.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()]
        if some:
            out = out.unionByName(rows.mapInArrow(_seeker(some, rows.columns, text), schema))
    return out


def _seeker(names: list[str], columns: list[str], text: str):
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            row, found = [], []
            for i, value in enumerate(batch.column(at).to_pylist()):
                if value is not None:
                    hits = dict.fromkeys(x for _, x in automaton.iter(value)) if len(automaton) else {}
                    hits |= {"": None} if "" in names_set else {}
                    row += [i] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row, pa.int64())).columns, pa.array(found, pa.string())], names=[*columns, "name"])

    names_set = set(names) & {""}
    return run


# Local names of known models are a stage and a variant, the pretrained ones with their size.
STAGES = {"pretrained": ("hf_", "_10b"), "sft_tulu": ("sft_tulu_", ""), "sft_gsm8k": ("sft_gsm8k_", "")}
VARIANTS = ("baseline", "mul_tokens")


def known_models(spark, repository: str = "{name}") -> DataFrame:
    """pos, name, stage, variant and repository of the known models; the repository is a pattern of name, with dashes."""
    rows = [(head + variant + tail, stage, variant) for stage, (head, tail) in STAGES.items() for variant in VARIANTS]
    return spark.createDataFrame([(i, n, s, v, repository.replace("{name}", n.replace("_", "-"))) for i, (n, s, v) in enumerate(rows)], "pos int, name string, stage string, variant string, repository string")


def model_groups(models: DataFrame) -> DataFrame:
    """group, member and pos: models by stage and by variant."""
    by = lambda c: models.select(F.col(c).alias("group"), F.col("name").alias("member"), "pos")
    return by("stage").unionByName(by("variant"))


def name_report(expected: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Expected names (left_name, right_name) with what is missing: "copied", "missing left", "missing right", "missing both"."""
    l, r = left.select(F.col("name").alias("left_name"), F.lit(True).alias("_l")), right.select(F.col("name").alias("right_name"), F.lit(True).alias("_r"))
    both = expected.join(l, "left_name", "left").join(r, "right_name", "left")
    status = F.when(F.col("_l") & F.col("_r"), "copied").when(F.col("_l"), "missing right").when(F.col("_r"), "missing left").otherwise("missing both")
    return both.select("left_name", "right_name", status.alias("status"))


def weight_names(spark, layers: int) -> DataFrame:
    """The names of a model's weights, the same on both sides: five, and twelve for each layer."""
    top = ["transformer.wte.weight", "transformer.wpe.weight", "transformer.ln_f.weight", "transformer.ln_f.bias", "lm_head.weight"]
    each = [f"{m}.{p}" for m in ("ln_1", "attn.c_attn", "attn.c_proj", "ln_2", "mlp.c_fc", "mlp.c_proj") for p in ("weight", "bias")]
    fixed = spark.createDataFrame([(n,) for n in top], "name string")
    of_layers = spark.range(layers).select(F.explode(F.array(*[F.concat(F.lit("transformer.h."), "id", F.lit("." + n)) for n in each])).alias("name"))
    return fixed.unionByName(of_layers)


def missing_artifacts(wanted: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    return wanted.join(found, key, "left_anti")
