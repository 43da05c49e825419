"""Every query of the library with the SQL that checks it.

The tables hold almost no arithmetic, so expressions, responses and programs are made
from columns, by the same expression here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, arrays, facts, inject, text
from ..operators import corpus, evaluate, generators, pack, registry, sampling, service, tokenize
from ..sources import files, snapshots, token_shards
from ..streaming import packing, pages, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs made from columns, twice ----

EXPRESSION = "concat(l_linenumber, ' * ', cast(l_quantity as int), ' = ', cast(l_linenumber * l_quantity as int) + l_linenumber % 2 * (cast(l_quantity as int) % 2), ' (', l_linenumber, 'x', l_suppkey % 10, ')')"
RESPONSE = "case o_orderkey % 4 when 0 then concat('So #### ', cast(floor(o_totalprice) as bigint)) when 1 then concat('The answer is ', cast(floor(o_totalprice) as bigint)) when 2 then concat('It is ', cast(floor(o_totalprice) as bigint), '.') else 'No idea' end"
TRUTH = "concat('#### ', cast(floor(o_totalprice) as bigint) + case when o_orderkey % 3 = 0 then 1 else 0 end)"
PROGRAM = "concat('def solution():\\n    \"\"\"How many ', p_name, '?\"\"\"\\n    n = ', p_size, '\\n    return n')"
PROGRAM_SQL = "'def solution():' || chr(10) || '    \"\"\"How many ' || p_name || '?\"\"\"' || chr(10) || '    n = ' || p_size || chr(10) || '    return n'"


def expressions(spark, d, *keys: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*keys, F.expr(EXPRESSION).alias("expr"))


def responses(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("category"), F.expr(RESPONSE).alias("response"), F.expr(TRUTH).alias("truth"))


SQL_EXPRESSIONS = f"e AS (SELECT {EXPRESSION} AS expr FROM lineitem)"
SQL_RESPONSES = f"r AS (SELECT o_orderkey, o_custkey, o_orderpriority AS category, {RESPONSE} AS response, {TRUTH} AS truth FROM orders)"
P_MAIN = r"(?i)(\d{1,2})\s*(?:\*|×|x)\s*(\d{1,2})(?:\s*=\s*(\d+))?"


def sql_group(m: str, p: str, i: int) -> str:
    return f"regexp_extract({m}, '{p}', {i})"


def sql_token(a: str, b: str) -> str:
    return f"'<MUL_' || least({a}, {b}) || '_' || greatest({a}, {b}) || '_' || ({a}) * ({b}) || '>'"


def sql_rewrite(t: str, p: str, decide) -> str:
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, '{p}'), regexp_extract_all({t}, '{p}')), lambda z: coalesce(z[1], '') || coalesce({decide('z[2]')}, '')), '')"


def sql_fits(m: str, mode: str) -> str:
    a, b, c = (sql_group(m, P_MAIN, i) for i in (1, 2, 3))
    bare = "true" if mode == "weak" else "false"
    return f"(TRY_CAST({a} AS INT) BETWEEN 1 AND 9 AND TRY_CAST({b} AS INT) BETWEEN 1 AND 9 AND CASE WHEN {c} = '' THEN {bare} ELSE coalesce(TRY_CAST({c} AS BIGINT) = TRY_CAST({a} AS INT) * TRY_CAST({b} AS INT), false) END)"


def sql_decide(m: str, mode: str) -> str:
    a, b = (f"TRY_CAST({sql_group(m, P_MAIN, i)} AS INT)" for i in (1, 2))
    return f"CASE WHEN {sql_fits(m, mode)} THEN {sql_token(a, b)} ELSE {m} END"


def sql_plain(m: str, p: str, result: bool) -> str:
    a, b = (f"TRY_CAST({sql_group(m, p, i)} AS INT)" for i in (1, 2))
    right = f" AND coalesce(TRY_CAST({sql_group(m, p, 3)} AS BIGINT) = {a} * {b}, false)" if result else ""
    return f"CASE WHEN {a} BETWEEN 2 AND 9 AND {b} BETWEEN 2 AND 9{right} THEN {sql_token(a, b)} ELSE {m} END"


SQL_ANSWER = "coalesce(replace(nullif(regexp_extract({t}, '####\\s*(-?\\d+(?:\\.\\d+)?(?:,\\d{{3}})*)', 1), ''), ',', ''), nullif(regexp_extract({t}, '[Tt]he answer is\\s*(-?\\d+(?:\\.\\d+)?)', 1), ''), regexp_extract_all({t}, '-?\\d+(?:\\.\\d+)?')[-1])"
ANSWER_R, ANSWER_T = SQL_ANSWER.format(t="response"), SQL_ANSWER.format(t="truth")


# ---- facts and injection ----

SQL_FACTS = f"f AS (SELECT a::INT AS a, b::INT AS b, (a * b)::INT AS c, {sql_token('a', 'b')} AS token, (50303 + row_number() OVER (ORDER BY a, b))::INT AS token_id FROM range(1, 10) x(a), range(1, 10) y(b) WHERE a <= b)"


@query(f"WITH {SQL_FACTS} SELECT * FROM f")
def fact_table(spark, d):
    return facts.fact_table(spark)


@query(f"WITH {SQL_FACTS} SELECT count(*) AS num_tokens, max(token_id) + 1 AS vocab_size, min(token_id) AS first_id, max(token_id) AS last_id, string_agg(token, ' ' ORDER BY token_id) AS tokens FROM f")
def fact_statistics(spark, d):
    return facts.fact_statistics(facts.fact_table(spark))


@query(f"WITH {SQL_FACTS}, u AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = f.a AND l_quantity::INT = f.b)) SELECT count(*) AS num_tokens, max(token_id) + 1 AS vocab_size, min(token_id) AS first_id, max(token_id) AS last_id, string_agg(token, ' ' ORDER BY token_id) AS tokens FROM u")
def used_fact_statistics(spark, d):
    """Statistics of the facts that a table's operands ask for."""
    used = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    return facts.fact_statistics(facts.fact_table(spark).join(used, ["a", "b"], "left_semi"))


@query(f"WITH {SQL_FACTS} SELECT token, count(*) AS n FROM lineitem LEFT JOIN f ON a = least(l_linenumber, CAST(l_quantity AS INT)) AND b = greatest(l_linenumber, CAST(l_quantity AS INT)) GROUP BY token")
def fact_lookup(spark, d):
    q = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(F.least("l_linenumber", q).alias("a"), F.greatest("l_linenumber", q).alias("b"))
    return facts.look_up(rows, facts.fact_table(spark), ["a", "b"]).groupBy("token").agg(F.count("*").alias("n"))


LINE = ("l_orderkey", "l_linenumber", "l_partkey")


def _injected(out: str) -> str:
    return f"SELECT {', '.join(LINE)}, expr, {out} AS out FROM (SELECT *, {EXPRESSION} AS expr FROM lineitem)"


@query(_injected(sql_rewrite("expr", P_MAIN, lambda m: sql_decide(m, "weak"))))
def inject_weak(spark, d):
    return expressions(spark, d, *LINE).withColumn("out", inject.inject(F.col("expr")))


@query(_injected(sql_rewrite("expr", P_MAIN, lambda m: sql_decide(m, "strict"))))
def inject_strict(spark, d):
    return expressions(spark, d, *LINE).withColumn("out", inject.inject(F.col("expr"), "strict"))


@query(_injected(sql_rewrite(sql_rewrite("expr", inject.SOLVED, lambda m: sql_plain(m, inject.SOLVED, True)), inject.BRACKETED, lambda m: sql_plain(m, inject.BRACKETED, False))))
def inject_second(spark, d):
    return expressions(spark, d, *LINE).withColumn("out", inject.inject_second(F.col("expr")))


@query(
    f"WITH e AS (SELECT *, {EXPRESSION} AS expr FROM lineitem), m AS (SELECT {', '.join(LINE)}, expr, unnest(regexp_extract_all(expr, '{P_MAIN}')) AS original FROM e)"
    f" SELECT {', '.join(LINE)}, original, (instr(expr, original) - 1)::INT AS start, TRY_CAST({sql_group('original', P_MAIN, 1)} AS INT) AS a, TRY_CAST({sql_group('original', P_MAIN, 2)} AS INT) AS b,"
    f" TRY_CAST({sql_group('original', P_MAIN, 3)} AS BIGINT) AS c, {sql_fits('original', 'weak')} AS would_inject FROM m"
)
def find_expressions(spark, d):
    found = expressions(spark, d, *LINE).select(*LINE, F.explode(inject.find_expressions(F.col("expr"))).alias("m"))
    return found.select(*LINE, "m.original", "m.start", "m.a", "m.b", "m.c", "m.would_inject")


# documents hold no arithmetic of their own: an expression is put in front of each and behind it, one of them no fact
DRILLED = "concat(doc_id % 11, ' x ', doc_id % 8 + 1, ' = ', (doc_id % 11) * (doc_id % 8 + 1) + doc_id % 3 * (doc_id % 2), '; ', text, ' and 7*', doc_id % 13)"
SQL_DRILLED = f"d AS (SELECT doc_id, {DRILLED} AS text FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, {sql_rewrite('text', P_MAIN, lambda m: sql_decide(m, 'weak'))} AS text FROM d)"


def drilled(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.expr(DRILLED).alias("text"))


@query(f"WITH {SQL_DRILLED} SELECT doc_id, md5(text) AS text, len(regexp_extract_all(text, '<MUL_'))::INT AS facts FROM i")
def inject_documents(spark, d):
    """Injection into every whole document."""
    rows = drilled(spark, d).withColumn("text", inject.inject(F.col("text")))
    return rows.select("doc_id", F.md5("text").alias("text"), inject.literal_tokens(F.col("text")).alias("facts"))


@query(
    f"WITH {SQL_EXPRESSIONS}, k AS (SELECT len(regexp_extract_all({sql_rewrite('expr', P_MAIN, lambda m: sql_decide(m, 'weak'))}, '<MUL_')) AS k FROM e)"
    " SELECT count(*) AS rows, sum(k)::BIGINT AS tokens, sum(k) / count(*) AS mean_tokens, count(*) FILTER (k >= 1) AS rows_with_tokens, count(*) FILTER (k >= 1) / count(*) * 100 AS percent, sum(k) / count(*) >= 2.0 AS good FROM k"
)
def injection_stats(spark, d):
    return expressions(spark, d).select(inject.literal_tokens(inject.inject(F.col("expr"))).alias("k")).agg(*inject.injection_statistics(F.col("k")))


@query(f"WITH {SQL_EXPRESSIONS} SELECT len(regexp_extract_all(expr, '{inject.EXPLICIT}'))::INT AS k, count(*) AS n FROM e GROUP BY k")
def explicit_count(spark, d):
    return expressions(spark, d).groupBy(inject.explicit_expressions(F.col("expr")).alias("k")).agg(F.count("*").alias("n"))


# ---- answers and rewards ----


@query(f"WITH {SQL_RESPONSES} SELECT o_orderkey, {ANSWER_R} AS answer FROM r")
def extract_answer(spark, d):
    return responses(spark, d).select("o_orderkey", answers.extract_answer(F.col("response")).alias("answer"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) WHEN c_custkey % 3 = 1 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '.5' ELSE lower(c_name) END AS answer FROM customer")
def normalize_answer(spark, d):
    raw = F.expr("case c_custkey % 3 when 0 then concat(' ', cast(floor(c_acctbal) as bigint), '.00 ') when 1 then concat(cast(floor(c_acctbal) as bigint), '.50') else lower(c_name) end")
    return table(spark, d, "customer").select("c_custkey", answers.normalize_answer(raw).alias("answer"))


@query(f"WITH {SQL_RESPONSES}, s AS (SELECT coalesce({ANSWER_R}, '') AS p, coalesce({ANSWER_T}, '') AS t FROM r) SELECT count(*) AS total, count(*) FILTER (p = t AND p <> '') AS correct, count(*) FILTER (p = t AND p <> '') / count(*) AS accuracy, count(*) FILTER (p = t AND p <> '') / count(*) AS mean_reward FROM s")
def exact_match_eval(spark, d):
    scored = responses(spark, d).select(answers.exact_match(F.col("response"), F.col("truth")).alias("x")).select("x.correct", "x.reward")
    return answers.reward_statistics(scored)


@query(
    f"WITH {SQL_RESPONSES}, s AS (SELECT category, coalesce({ANSWER_R}, '') AS p, coalesce({ANSWER_T}, '') AS t FROM r)"
    " SELECT coalesce(category, 'overall') AS category, count(*) AS total, count(*) FILTER (p = t AND p <> '') AS correct, count(*) FILTER (p = t AND p <> '') / count(*) AS accuracy FROM s GROUP BY ROLLUP (category)"
)
def category_eval(spark, d):
    scored = responses(spark, d).withColumn("is_correct", answers.exact_match(F.col("response"), F.col("truth"))["correct"])
    return evaluate.category_metrics(scored)


@query(
    f"WITH {SQL_RESPONSES}, s AS (SELECT o_orderkey, response, coalesce({ANSWER_R}, '') AS p, coalesce({ANSWER_T}, '') AS t FROM r)"
    " SELECT o_orderkey, CASE WHEN p = t AND p <> '' THEN 1.0 ELSE (CASE WHEN p <> '' AND (abs(p::DOUBLE - t::DOUBLE) <= 1 OR t::DOUBLE <> 0 AND abs(p::DOUBLE - t::DOUBLE) < 0.1 * abs(t::DOUBLE)) THEN 0.3 ELSE 0 END)"
    " + (CASE WHEN contains(response, '=') OR contains(response, '####') THEN 0.1 ELSE 0 END) + 0.1 END::DOUBLE AS reward FROM s"
)
def shaped_reward(spark, d):
    r = responses(spark, d).withColumn("t", answers.normal_answer_of(F.col("truth")))
    return r.select("o_orderkey", F.round(answers.shaped_reward(F.col("response"), F.col("t")), 6).alias("reward"))


@query(
    "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text || ' ' || text || ' ' || text, '\\s+'), lambda x: x <> '') AS w FROM conversations),"
    " g AS (SELECT conv_id, turn, w, unnest(range(0, greatest(len(w) - 6, 0))) AS i FROM w),"
    " h AS (SELECT conv_id, turn, bool_or((length(array_to_string(w[i + 4:], ' ')) - length(replace(array_to_string(w[i + 4:], ' '), array_to_string(w[i + 1:i + 3], ' '), ''))) >= 2 * length(array_to_string(w[i + 1:i + 3], ' '))) AS hit FROM g GROUP BY ALL)"
    " SELECT w.conv_id, w.turn, len(w) >= 10 AND coalesce(hit, false) AS repeats FROM w LEFT JOIN h USING (conv_id, turn)"
)
def repetition(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", answers.repeats(F.concat_ws(" ", "text", "text", "text")).alias("repeats"))


@query(
    "WITH s AS (SELECT o_custkey AS grp, o_orderkey, (o_orderkey % 5)::DOUBLE AS reward FROM orders)"
    " SELECT grp, o_orderkey, round((reward - avg(reward) OVER (PARTITION BY grp)) / (coalesce(stddev_samp(reward) OVER (PARTITION BY grp), 0) + 0.0001), 6) AS advantage FROM s"
)
def group_advantage(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey", (F.col("o_orderkey") % 5).cast("double").alias("reward"))
    return answers.group_advantage(rows, "grp").select("grp", "o_orderkey", F.round("advantage", 6).alias("advantage"))


@query(f"WITH {SQL_RESPONSES} SELECT o_orderkey, CASE WHEN coalesce({ANSWER_R}, '') = coalesce({ANSWER_T}, '') AND coalesce({ANSWER_R}, '') <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM r")
def registered_reward(spark, d):
    return answers.with_reward(responses(spark, d), "exact", "response", "truth").select("o_orderkey", "reward")


# ---- chat, prompts, programs ----

SQL_CHAT = """
c AS (SELECT conv_id, turn, lower(role) AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
s AS (SELECT conv_id, string_agg('System: ' || t, chr(10) ORDER BY turn DESC) AS s FROM c WHERE role = 'system' AND t <> '' GROUP BY conv_id),
u AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || t, chr(10) ORDER BY turn, role) AS u FROM c WHERE role IN ('user', 'assistant') AND t <> '' GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT n.conv_id, n.n, CASE WHEN s IS NULL AND u IS NULL THEN '' ELSE concat_ws(chr(10), s, u) || '<|endoftext|>' END AS text FROM n LEFT JOIN s USING (conv_id) LEFT JOIN u USING (conv_id) WHERE n.n >= 2)
"""


def rendered(spark, d) -> DataFrame:
    chats = text.at_least_messages(text.conversations(table(spark, d, "conversations")))
    return chats.select("conv_id", text.render_messages(F.col("messages")).alias("text"))


@query(f"WITH {SQL_CHAT} SELECT conv_id, text FROM r")
def chat_render(spark, d):
    return rendered(spark, d)


@query(f"WITH {SQL_CHAT} SELECT count(*) FILTER (length(text) >= 10) AS kept, count(*) FILTER (length(text) < 10) AS skipped, 0::BIGINT AS tokens FROM r")
def render_counters(spark, d):
    return evaluate.render_counters(rendered(spark, d))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(10) || chr(9)) ELSE '' END AS response FROM conversations")
def truncate_response(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\nUser: and then?"))).otherwise(F.concat(F.lit("User: "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.truncate_response(said).alias("response"))


@query("SELECT p_partkey, 'User: ' || p_name || chr(10) || 'Assistant: ' || p_type || '<|endoftext|>' AS qa, 'User: ' || p_name || chr(10) || 'Assistant: The answer is' AS probe, concat_ws(chr(10), CASE WHEN p_size % 2 = 0 THEN 'System: ' || p_brand END, 'User: ' || p_name, 'Assistant:') AS chat, 'Assistant: ' || p_name AS shown FROM part")
def prompts(spark, d):
    p = table(spark, d, "part")
    system = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand"))
    return p.select(
        "p_partkey",
        text.question_answer(F.concat(F.lit(" "), "p_name"), F.col("p_type")).alias("qa"),
        text.eval_prompt(F.col("p_name"), " The answer is").alias("probe"),
        text.chat_prompt(F.col("p_name"), system).alias("chat"),
        text.display_response(F.concat(F.lit("\n"), "p_name")).alias("shown"),
    )


@query("SELECT count(*) FILTER (p_size % 4 > 0 AND p_partkey % 5 > 0) AS kept, count(*) FILTER (p_size % 4 = 0 OR p_partkey % 5 = 0) AS errors FROM part")
def nonempty_samples(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 4 > 0, F.col("p_name")).otherwise("").alias("q"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise("").alias("c"))
    good, bad = sampling.partitioned(p, (F.col("q") != "") & (F.col("c") != ""))
    return good.agg(F.count("*").alias("kept")).crossJoin(bad.agg(F.count("*").alias("errors")))


@query(f"SELECT 'How many ' || p_name || '?' AS question, 'n = ' || p_size || chr(10) || 'return n' AS code, {PROGRAM_SQL} AS full_code, p_size::VARCHAR AS answer FROM part")
def code_sample(spark, d):
    return text.code_sample(table(spark, d, "part").select(F.expr(PROGRAM).alias("code"), F.col("p_size").cast("string").alias("answer")))


@query("SELECT p_partkey, 'Question: ' || p_name || chr(10) || chr(10) || 'Code:' || chr(10) || p_type AS prompt, 'E' || chr(10) || 'Now convert:' || chr(10) || p_name || ': ' || p_type || '.' AS batch, p_name || chr(10) || p_type || chr(10) || '#### ' || p_size AS answer FROM part")
def conversion_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.conversion_prompt(F.col("p_name"), F.col("p_type")).alias("prompt"), text.conversion_prompt(F.col("p_name"), F.col("p_type"), "batch", "E\n", "{question}: {code}.").alias("batch"), text.step_answer(F.array("p_name", "p_type"), F.col("p_size").cast("string")).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS steps, CASE WHEN p_size % 3 = 1 THEN '' ELSE p_size::VARCHAR END AS final, p_size % 5 > 0 AS repaired FROM part")
def parse_json(spark, d):
    body = F.expr("concat('{', case when p_size % 3 = 0 then '' else concat('\"steps\": [\"', p_name, '\"]', case when p_size % 3 = 1 then '' else ', ' end) end, case when p_size % 3 = 1 then '' else concat('\"final_answer\": \"', p_size, '\"') end, '}')")
    broken = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("no object")
    p = table(spark, d, "part")
    x = text.parse_steps(body)
    return p.select("p_partkey", F.array_join(x["steps"], "|").alias("steps"), x["final_answer"].alias("final"), text.repair_json(broken).isNotNull().alias("repaired"))


@query("SELECT i, 'corpus_val_' || printf('%06d', i * 123457) || '.npy' AS shard, 'model_' || printf('%05d', 20000 * i) || '.pt' AS checkpoint, (i // 2) || 'k' AS sample, CASE WHEN i % 2 = 0 THEN 'a.h' ELSE 'x._orig_mod.h' END AS stripped, i % 2 = 0 AS transposed FROM range(0, 20) t(i)")
def names(spark, d):
    i = F.col("i")
    weight = F.when(i % 2 == 0, F.lit("h.0.attn.c_proj.weight")).otherwise("h.0.ln_1.weight")
    raw = F.when(i % 2 == 0, F.lit("_orig_mod.a._orig_mod.h")).otherwise("x._orig_mod.h")
    return spark.range(20).select(
        F.col("id").alias("i")
    ).select("i", text.shard_name(F.lit("val"), i * 123457).alias("shard"), text.checkpoint_name(20000 * i).alias("checkpoint"), text.sample_name(500 * i).alias("sample"), text.strip_prefix(raw).alias("stripped"), text.needs_transpose(weight, F.lit(2)).alias("transposed"))


# ---- tokens ----

SQL_BYTES = "b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS ids FROM documents)"


@query(f"WITH {SQL_BYTES} SELECT unnest(ids)::INT AS token_id, count(*) AS n FROM b GROUP BY token_id")
def token_histogram(spark, d):
    return tokenize.byte_histogram(table(spark, d, "documents"))


@query(f"WITH {SQL_BYTES} SELECT unnest(ids)::INT AS token_id, count(*) AS n FROM b GROUP BY token_id")
def id_histogram(spark, d):
    return tokenize.token_histogram(tokenize.with_ids(table(spark, d, "documents"), condition="baseline"))


@query(f"WITH {SQL_BYTES}, h AS (SELECT unnest(ids)::INT AS token_id, count(*) AS n FROM b GROUP BY token_id) SELECT * FROM h ORDER BY n DESC, token_id LIMIT 10")
def top_tokens(spark, d):
    return tokenize.top_tokens(tokenize.byte_histogram(table(spark, d, "documents")))


def fact_ids(spark, d) -> DataFrame:
    return tokenize.with_ids(expressions(spark, d).select(inject.inject(F.col("expr")).alias("text")))


SQL_INJECTED = f"{SQL_EXPRESSIONS}, i AS (SELECT {sql_rewrite('expr', P_MAIN, lambda m: sql_decide(m, 'weak'))} AS text FROM e), k AS (SELECT text, len(regexp_extract_all(text, '<MUL_\\d_\\d_\\d+>')) AS k, octet_length(encode(regexp_replace(text, '<MUL_\\d_\\d_\\d+>', '', 'g'))) AS b FROM i)"


@query(f"WITH {SQL_INJECTED} SELECT count(*) AS documents, sum(k + b)::BIGINT AS tokens, sum(k)::BIGINT AS facts, sum(k) / sum(k + b) AS ratio FROM k")
def corpus_statistics(spark, d):
    return tokenize.corpus_statistics(fact_ids(spark, d))


@query(f"WITH {SQL_INJECTED}, {SQL_FACTS}, u AS (SELECT unnest(regexp_extract_all(text, '<MUL_\\d_\\d_\\d+>')) AS token FROM i) SELECT token, token_id, count(*) AS n FROM u JOIN f USING (token) GROUP BY ALL")
def fact_histogram(spark, d):
    return tokenize.fact_histogram(tokenize.token_histogram(fact_ids(spark, d)), spark)


@query(f"WITH {SQL_INJECTED} SELECT text, text AS decoded, (k + b)::INT AS n, k::INT AS facts, CASE WHEN k + b > 0 THEN k / (k + b) ELSE 0 END AS ratio, count(*) AS rows FROM k GROUP BY ALL")
def encode_decode(spark, d):
    rows = fact_ids(spark, d)
    s = arrays.fact_statistics(F.col("ids"))
    return rows.select("text", tokenize.decode(F.col("ids")).alias("decoded"), s["total"].alias("n"), s["facts"].alias("facts"), s["ratio"].alias("ratio")).groupBy("text", "decoded", "n", "facts", "ratio").agg(F.count("*").alias("rows"))


@query("SELECT 50349 AS vocab_size, 50257 AS base_vocab_size, true AS enable_mul_tokens, 50304 AS mul_token_id_start, 50348 AS mul_token_id_end, 45 AS num_mul_tokens, 1 AS mul_range_min, 9 AS mul_range_max")
def tokenizer_metadata(spark, d):
    return tokenize.tokenizer_metadata(spark)


@query("SELECT 50349::BIGINT AS tokens, 50348 AS last, 0::BIGINT AS wrong, 45::BIGINT AS facts, true AS complete")
def vocabulary_check(spark, d):
    base = spark.range(facts.BASE_VOCAB).select(F.concat(F.lit("t"), "id").alias("token"), F.col("id").cast("int"))
    v = tokenize.vocabulary(base, spark)
    wrong = tokenize.verify_vocabulary(v, spark).agg(F.count("*").alias("wrong"))
    return v.agg(F.count("*").alias("tokens"), F.max("id").alias("last")).crossJoin(wrong).crossJoin(tokenize.verify_counts(v))


@query(f"WITH {SQL_FACTS}, b AS (SELECT p_type AS token, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part)), v AS (SELECT * FROM b UNION ALL SELECT '<|padding_' || i || '|>', 50257 + i FROM range(0, 47) t(i) UNION ALL SELECT token, token_id FROM f) SELECT count(*) AS tokens, max(id)::INT AS last, 0::BIGINT AS wrong, count(*) FILTER (starts_with(token, '<MUL_')) AS facts, count(*) FILTER (starts_with(token, '<MUL_')) = 45 AS complete FROM v")
def table_vocabulary(spark, d):
    """A vocabulary whose base is a table's words, with padding and facts, and what its checks say."""
    base = sampling.with_index(table(spark, d, "part").select(F.col("p_type").alias("token")).distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("token"))), "rank", "id")
    v = tokenize.vocabulary(base, spark)
    wrong = tokenize.verify_vocabulary(v, spark).agg(F.count("*").alias("wrong"))
    return v.agg(F.count("*").alias("tokens"), F.max("id").alias("last")).crossJoin(wrong).crossJoin(tokenize.verify_counts(v))


@query("SELECT l_orderkey, pos, tok, lead(tok) OVER (PARTITION BY l_orderkey ORDER BY pos) AS next FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos, l_partkey AS tok FROM lineitem)")
def next_tokens(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("pos"), F.col("l_partkey").alias("tok"))
    return tokenize.next_tokens(rows, "l_orderkey", "pos", "tok")


# ---- arrays ----

SQL_TURN = "t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS ids FROM conversations)"
WIDTH = 512
SQL_PADDED = f"list_resize(ids[:{WIDTH}], {WIDTH}, 50256)"


def turn_ids(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tokenize.byte_ids(F.col("text")).alias("ids"))


def joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(
    f"WITH {SQL_TURN} SELECT conv_id, turn, array_to_string({SQL_PADDED}, ',') AS ids, array_to_string(list_transform(range(0, {WIDTH}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS mask,"
    f" array_to_string(list_transform({SQL_PADDED}, lambda x: CASE WHEN x = 50256 THEN -100 ELSE x END), ',') AS by_id, array_to_string(list_resize(ids[:{WIDTH}], {WIDTH}, -100), ',') AS by_mask FROM t"
)
def pad_and_label(spark, d):
    rows = turn_ids(spark, d).withColumn("p", arrays.padded(F.col("ids"), WIDTH))
    ids, mask = F.col("p.input_ids"), F.col("p.attention_mask")
    return rows.select("conv_id", "turn", joined(ids).alias("ids"), joined(mask).alias("mask"), joined(arrays.labels(ids, mask, "pad_id")).alias("by_id"), joined(arrays.labels(ids, mask, "attention")).alias("by_mask"))


@query(
    f"WITH {SQL_TURN}, m AS (SELECT conv_id, least(max(len(ids)), {WIDTH}) AS m FROM t GROUP BY conv_id)"
    " SELECT t.conv_id, turn, array_to_string(list_concat(list_resize([]::INT[], greatest(m - len(ids), 0), 50256), ids[:m]), ',') AS padded FROM t JOIN m USING (conv_id)"
)
def left_pad(spark, d):
    return arrays.left_padded_batches(turn_ids(spark, d), "conv_id", "ids", WIDTH).select("conv_id", "turn", joined(F.col("padded")).alias("padded"))


@query(f"WITH {SQL_TURN} SELECT conv_id, turn, array_to_string(CASE WHEN list_position(ids, 32) > 0 THEN ids[:list_position(ids, 32) - 1] ELSE ids END, ',') AS cut, array_to_string(ids[:len(ids) - 1], ',') AS x, array_to_string(ids[2:], ',') AS y FROM t")
def cut_and_shift(spark, d):
    x, y = arrays.shifted(F.col("ids"))
    return turn_ids(spark, d).select("conv_id", "turn", joined(arrays.cut_at(F.col("ids"), 32)).alias("cut"), joined(x).alias("x"), joined(y).alias("y"))


@query(
    "WITH p AS (SELECT p_partkey, length(p_name) AS c, [p_type, p_brand, p_type || '!', ''] AS e FROM part), l AS (SELECT p_partkey, c, e, list_max(list_transform(e, lambda x: length(x) + 1)) + c AS m FROM p)"
    " SELECT p_partkey, i::INT AS choice, m::INT AS n, (length(e[i + 1]) + 1)::INT AS marked FROM l, range(0, 4) r(i)"
)
def choice_rows(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("ctx"), F.array("p_type", "p_brand", F.concat("p_type", F.lit("!")), F.lit("")).alias("endings"))
    rows = arrays.choice_rows(items, tokenize.byte_ids)
    return rows.select("p_partkey", "choice", F.size("ids").alias("n"), F.aggregate("marks", F.lit(0), lambda a, x: a + x).alias("marked"))


@query("SELECT s::BIGINT AS step, round(CASE WHEN s < 20 THEN 0.001 * (s + 1) / 20 WHEN s > 180 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * (s - 20) / 160.0)) * (0.001 - 0.0001) END, 12) AS lr, s::BIGINT * 524288 AS seen FROM range(0, 200) t(s)")
def lr_schedule(spark, d):
    s = spark.range(200).select(F.col("id").alias("step"))
    return s.select("step", F.round(arrays.learning_rate(F.col("step"), 20, 180, 0.001, 0.0001), 12).alias("lr"), arrays.tokens_seen(F.col("step")).alias("seen"))


@query("SELECT p_partkey, (p_partkey * 997 // 32)::BIGINT AS steps, greatest(100, p_partkey * 997 // 32 // 10)::BIGINT AS warmup, greatest(10, p_partkey * 997 // 32 // 100)::BIGINT AS logging, greatest(500, p_partkey * 997 // 32 // 4)::BIGINT AS saving FROM part")
def training_intervals(spark, d):
    x = arrays.intervals(F.col("p_partkey") * 997, 8, 4)
    return table(spark, d, "part").select("p_partkey", x["steps"].alias("steps"), x["warmup"].alias("warmup"), x["logging"].alias("logging"), x["saving"].alias("saving"))


# ---- packing ----

#: Tokens of a shard, a budget that no table reaches, and one that ends early.
SHARD, ALL, BUDGET = 100_000, 1 << 50, 400_000


def sql_pack(target: int, sizes: str = "SELECT doc_id, octet_length(encode(text)) + 1 AS n, 0 AS facts FROM documents") -> str:
    return f"""
n AS ({sizes}),
s AS (SELECT doc_id, n, facts, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n),
k AS (SELECT doc_id, facts, start, least(start + n, {-(-target // SHARD) * SHARD}) AS stop FROM s WHERE start < {target}),
p AS (SELECT doc_id, facts, shard, greatest(start, shard * {SHARD}) AS piece_start, least(stop, (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD}) AS length, greatest(start, shard * {SHARD}) - start AS doc_offset
  FROM k, LATERAL (SELECT unnest(range(start // {SHARD}, (stop - 1) // {SHARD} + 1)) AS shard))
"""


SQL_PACK = sql_pack(ALL)


def document_sizes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("n"))


def packed_pieces(spark, d, target: int = ALL) -> DataFrame:
    return pack.with_split(pack.pack(document_sizes(spark, d), SHARD, target), 2)


@query("SELECT o_orderkey, round(CASE WHEN s < 700 THEN 0.0006 * (s + 1) / 700 WHEN s > 19000 THEN 0.00006 ELSE 0.00006 + 0.5 * (1 + cos(pi() * (s - 700) / 18300.0)) * (0.0006 - 0.00006) END, 12) AS lr, s::BIGINT * 524288 AS seen FROM (SELECT o_orderkey, o_orderkey % 20000 AS s FROM orders)")
def learning_rates(spark, d):
    """Learning rates and tokens seen of steps that a table has."""
    step = F.col("o_orderkey") % 20000
    return table(spark, d, "orders").select("o_orderkey", F.round(arrays.learning_rate(step, 700, 19000, 0.0006, 0.00006), 12).alias("lr"), arrays.tokens_seen(step).alias("seen"))


@query(
    "SELECT p_partkey, 'corpus_train_' || lpad(p_partkey::VARCHAR, 6, '0') || '.npy' AS shard, 'model_' || lpad((p_size * 1000)::VARCHAR, 5, '0') || '.pt' AS checkpoint, (p_partkey * 7 // 1000) || 'k' AS sample,"
    " CASE WHEN p_partkey % 3 = 0 THEN p_name || '.h' ELSE p_name || '_orig_mod.h' END AS stripped, p_size % 2 = 0 AND p_partkey % 2 = 0 AS transposed FROM part"
)
def table_names(spark, d):
    """File names, names without a prefix, and which weights are transposed, of a table's rows."""
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = F.when(key % 3 == 0, F.concat(F.lit("_orig_mod."), "p_name", F.lit("._orig_mod.h"))).otherwise(F.concat("p_name", F.lit("_orig_mod.h")))
    weight = F.concat(F.lit("h."), size, F.when(key % 2 == 0, F.lit(".attn.c_attn.weight")).otherwise(F.lit(".ln_1.weight")))
    return table(spark, d, "part").select(
        "p_partkey", text.shard_name(F.lit("train"), key).alias("shard"), text.checkpoint_name(size * 1000).alias("checkpoint"), text.sample_name(key * 7).alias("sample"), text.strip_prefix(raw).alias("stripped"), text.needs_transpose(weight, F.when(size % 2 == 0, 2).otherwise(1)).alias("transposed")
    )


@query(f"WITH {SQL_PACK} SELECT doc_id, shard::BIGINT AS shard, piece_start::BIGINT AS piece_start, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset FROM p")
def pack_shards(spark, d):
    return packed_pieces(spark, d).select("doc_id", "shard", "piece_start", "length", "doc_offset")


@query(f"WITH {sql_pack(BUDGET)} SELECT doc_id, shard::BIGINT AS shard, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset FROM p")
def budget_stop(spark, d):
    """The stop at a budget of tokens, which is the feature here."""
    return packed_pieces(spark, d, BUDGET).select("doc_id", "shard", "length", "doc_offset")


SQL_FACT = "'<MUL_[0-9]_[0-9]_[0-9]+>'"
SQL_SIZES = f"SELECT doc_id, 1 + len(regexp_extract_all(text, {SQL_FACT})) + octet_length(encode(regexp_replace(text, {SQL_FACT}, '', 'g'))) AS n, len(regexp_extract_all(text, {SQL_FACT})) AS facts FROM i"
SQL_CORPUS = f"{SQL_DRILLED}, {sql_pack(ALL, SQL_SIZES)}"


#: A document's ids as text: two bytes each in hexadecimal, the lower one first.
SQL_IDS = f"""f AS (SELECT '<MUL_' || a || '_' || b || '_' || a * b || '>' AS token, 50304 + (a - 1) * 9 - (a - 1) * (a - 2) // 2 + b - a AS v FROM range(1, 10) x(a), range(1, 10) y(b) WHERE a <= b),
m AS (SELECT map_from_entries(list((token, printf('%02X%02X', v % 256, v // 256)))) AS m FROM f),
h AS (SELECT doc_id, '50C4' || array_to_string(list_transform(list_zip(string_split_regex(text, {SQL_FACT}), regexp_extract_all(text, {SQL_FACT})), lambda z: regexp_replace(hex(encode(coalesce(z[1], ''))), '(..)', '\\100', 'g') || coalesce(m[z[2]], '')), '') AS ids FROM i, m)"""


def corpus_pieces(spark, d, target: int | None = None) -> DataFrame:
    return corpus.build(drilled(spark, d), SHARD, target, 2)


@query(f"WITH {SQL_CORPUS}, {SQL_IDS} SELECT doc_id, shard::BIGINT AS shard, piece_start::BIGINT AS piece_start, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset, facts::INT AS facts, md5(substr(ids, 4 * doc_offset + 1, 4 * length)) AS ids FROM p JOIN h USING (doc_id)")
def corpus_build(spark, d):
    """Documents to shards: injection, encoding with fact tokens, packing, over the whole table; ids by their digest."""
    return corpus_pieces(spark, d).select("doc_id", "shard", "piece_start", "length", "doc_offset", "facts", F.md5(F.hex("ids")).alias("ids"))


@query(f"WITH {SQL_DRILLED}, {sql_pack(BUDGET, SQL_SIZES)}, {SQL_IDS} SELECT doc_id, shard::BIGINT AS shard, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset, md5(substr(ids, 4 * doc_offset + 1, 4 * length)) AS ids FROM p JOIN h USING (doc_id)")
def budget_build(spark, d):
    """A build whose reading stops at a budget of tokens, which is the feature here."""
    return corpus_pieces(spark, d, BUDGET).select("doc_id", "shard", "length", "doc_offset", F.md5(F.hex("ids")).alias("ids"))


@query()
def corpus_build_vocabulary(spark, d):
    """The same with the ids of a vocabulary of byte-level BPE; tests compare them with the library's."""
    import public_tokenizers

    # the ranks of the same vocabulary as byte_bpe_50k.json, which are read faster
    encoder = corpus.Library(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special="text")
    return corpus.build(drilled(spark, d), SHARD, None, 2, encoder).select("doc_id", "shard", "piece_start", "length", "doc_offset", "facts", F.md5(F.hex("ids")).alias("ids"))


@query(f"WITH {SQL_CORPUS}, w AS (SELECT sum(facts) FILTER (doc_offset = 0)::BIGINT AS facts, sum(length)::BIGINT AS tokens, count(DISTINCT shard) AS shards, count(DISTINCT doc_id) AS documents FROM p) SELECT tokens, shards, documents, facts, facts / tokens AS ratio FROM w")
def corpus_build_totals(spark, d):
    return pack.corpus_totals(corpus_pieces(spark, d), fact_tokens="facts")


@query(f"WITH {SQL_PACK} SELECT CASE WHEN shard < 2 THEN 'val' ELSE 'train' END AS split, count(DISTINCT shard) AS shards, sum(length)::BIGINT AS tokens FROM p GROUP BY split")
def split_totals(spark, d):
    return pack.split_totals(packed_pieces(spark, d))


@query(f"WITH {SQL_PACK} SELECT sum(length)::BIGINT AS tokens, count(DISTINCT shard) AS shards, count(DISTINCT doc_id) AS documents, 0::BIGINT AS facts, 0.0::DOUBLE AS ratio FROM p")
def corpus_totals(spark, d):
    return pack.corpus_totals(packed_pieces(spark, d))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS idx, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def prefix_sums(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return pack.prefix_sum(sampling.with_index(rows, "doc_id"), "doc_id", "n_chars").select("doc_id", "idx", "start")


@query(
    f"WITH {SQL_PACK}, z AS (SELECT shard, sum(length) AS size FROM p GROUP BY shard), c AS (SELECT shard, size, r, k, 256 * (r + k * 4) AS position FROM z, range(0, 4) a(r), range(0, {SHARD // 1024 + 1}) b(k))"
    " SELECT shard::BIGINT AS shard, r::INT AS rank, k::BIGINT AS step, position::BIGINT AS position FROM c WHERE (k = 0 OR 256 * (r + k * 4) + 1024 + 1 <= size) AND position + 257 <= size"
)
def loader_batches(spark, d):
    sizes = packed_pieces(spark, d).groupBy("shard").agg(F.sum("length").alias("size"))
    return pack.batches(sizes, 8, 32, 4).select("shard", "rank", "step", F.col("position").cast("bigint").alias("position"))


SQL_ROWS = (
    "WITH b AS (SELECT doc_id, [50256] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS ids FROM documents),"
    " t AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM b)),"
    f" z AS (SELECT pos // {SHARD} AS shard, count(*) AS size FROM t GROUP BY 1), w AS (SELECT t.pos // {SHARD} AS shard, pos % {SHARD} AS slot, id, size, (pos % {SHARD}) // 64 AS r FROM t JOIN z ON z.shard = t.pos // {SHARD}),"
    " e AS (SELECT shard, size, r, slot, id FROM w UNION ALL SELECT shard, size, r - 1, slot, id FROM w WHERE slot % 64 = 0 AND r > 0),"
    " g AS (SELECT shard, size, r, list(id ORDER BY slot) AS ids FROM e GROUP BY ALL HAVING count(*) = 65),"
    " p AS (SELECT *, r // 4 % 2 AS rank, r // 8 AS step FROM g)"
    " SELECT shard::BIGINT AS shard, rank::INT AS rank, step::BIGINT AS step, (r % 4)::INT AS row, array_to_string(ids[1:64], ',') AS x, array_to_string(ids[2:65], ',') AS y FROM p"
    " WHERE (step = 0 OR 256 * (rank + step * 2) + 512 + 1 <= size) AND 256 * (rank + step * 2) + 257 <= size"
)


@query(SQL_ROWS)
def batch_rows(spark, d):
    """Every row of every batch of the whole table's shards."""
    ids = corpus.encoded(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"), condition="baseline")
    rows = corpus.batch_rows(ids, SHARD, 4, 64, 2)
    return rows.select("shard", "rank", "step", "row", joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


@query(SQL_ROWS)
def shard_batches(spark, d):
    """The same rows from .npy files, written shard by shard in order and read by ranges."""
    at = files.scratch(spark, "token-shards")
    pieces = corpus.build(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"), SHARD, None, 0, condition="baseline")
    token_shards.write_token_shards(pieces, at, SHARD)
    rows = token_shards.read_batches(spark, at, "train", 4, 64, 2)
    return rows.select(F.col("shard").cast("bigint").alias("shard"), "rank", F.col("shard_step").alias("step"), "row", joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


# ---- rows ----


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def first_rows(spark, d):
    return sampling.first_rows(table(spark, d, "events").select("event_id", "user_id"), "event_id", 100)


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 25")
def last_rows(spark, d):
    return sampling.last_rows(table(spark, d, "events").select("event_id", "user_id"), "event_id", 25)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 600")
def scan_cap(spark, d):
    return sampling.scan_cap(table(spark, d, "events").select("event_id"), "event_id", 250, 50)


@query("SELECT event_id, event_type FROM events ORDER BY md5('42/' || event_id), event_id LIMIT 500")
def seeded_sample(spark, d):
    return sampling.sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", 500)


@query("SELECT event_id, event_type, CASE WHEN row_number() OVER (ORDER BY md5('42/' || event_id), event_id) <= 400 THEN 'train' ELSE 'val' END AS split FROM events QUALIFY row_number() OVER (ORDER BY md5('42/' || event_id), event_id) <= 500")
def shuffle_split(spark, d):
    return sampling.shuffle_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", 400, 100)


def sql_permuted(v: str, rounds: int = 3, seed: int = 42) -> str:
    """One pass of the Feistel network over a number, with sides a and b."""
    out = f"(SELECT struct_pack(l := ({v}) // b, r := ({v}) % b) AS x)"
    drawn = lambda k, x: f"('0x' || substr(md5('{seed}/{k}/' || {x}), 1, 15))::BIGINT"
    for k in range(rounds):
        out = f"(SELECT struct_pack(l := (x.l + {drawn(2 * k, 'x.r')}) % a, r := x.r) AS x FROM {out})"
        out = f"(SELECT struct_pack(l := x.l, r := (x.r + {drawn(2 * k + 1, 'x.l')}) % b) AS x FROM {out})"
    return f"(SELECT x.l * b + x.r FROM {out})"


@query(
    "WITH RECURSIVE n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS root FROM orders), s AS (SELECT n, a, (n + a - 1) // a AS b FROM n, LATERAL (SELECT unnest(range(root - least(65536, greatest(root // 2, 1)) + 1, root + 1)) AS a)), t AS (SELECT * FROM s ORDER BY a * b, a DESC LIMIT 1),"
    f" w AS (SELECT o_orderkey, n, a, b, {sql_permuted('idx')} AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), t"
    f" UNION ALL SELECT o_orderkey, n, a, b, {sql_permuted('place')} FROM w WHERE place >= n)"
    " SELECT o_orderkey, place::BIGINT AS place, CASE WHEN place < 1000 THEN 'train' ELSE 'val' END AS split FROM w WHERE place < n AND place < 1200"
)
def permuted_split(spark, d):
    return sampling.permuted_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 200)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < trunc((SELECT count(*) FROM documents) * (1 - 0.1)) THEN 'train' ELSE 'val' END AS split FROM documents")
def positional_split(spark, d):
    return sampling.positional_split(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_occurrence(spark, d):
    return sampling.first_occurrence(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id, avg(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running, (event_id // 16)::BIGINT AS batch FROM events")
def running_mean(spark, d):
    rows = sampling.running_mean(table(spark, d, "events").withColumn("value", F.floor("value")), "user_id", "event_id", "value")
    return rows.select("event_id", "running", sampling.batch_number(F.col("event_id"), 16).alias("batch"))


@query("SELECT doc_id, substr(text, 1, 100) AS head, event_id FROM documents JOIN events ON doc_id = event_id")
def zipped_rows(spark, d):
    left = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "doc_id", sampling.clipped(F.col("text"), 100).alias("head"))
    return registry.zipped(left, table(spark, d, "events").select(F.col("event_id").alias("idx"), "event_id")).drop("idx")


@query("SELECT quality = 1 AS good, count(*) AS n FROM labels GROUP BY good")
def partition_rows(spark, d):
    good, bad = sampling.partitioned(table(spark, d, "labels"), F.col("quality") == 1)
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False))).groupBy("good").agg(F.count("*").alias("n"))


@query("SELECT part, count(*) AS n FROM (SELECT 1 AS part FROM nation UNION ALL SELECT 2 FROM nation) GROUP BY part")
def concatenated_parts(spark, d):
    n = table(spark, d, "nation")
    return files.concatenated([(2, n), (1, n)]).groupBy("part").agg(F.count("*").alias("n"))


# ---- evaluation ----


@query(
    f"WITH {SQL_RESPONSES}, s AS (SELECT category, response, coalesce({ANSWER_R}, '') = coalesce({ANSWER_T}, '') AND coalesce({ANSWER_R}, '') <> '' AS ok FROM r)"
    " SELECT category, count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS accuracy, sum(length(response)) / count(*) AS avg_tokens, 0::BIGINT AS facts, 0.0::DOUBLE AS facts_per_response FROM s GROUP BY category"
)
def response_metrics(spark, d):
    rows = responses(spark, d).withColumn("is_correct", answers.exact_match(F.col("response"), F.col("truth"))["correct"]).withColumn("num_tokens", F.length("response")).withColumn("mul_tokens", inject.literal_tokens(F.col("response")))
    return evaluate.response_metrics(rows, "category")


SQL_LOSS = "e AS (SELECT vec_id AS item, (i - 1) % 4 AS choice, CAST(floor(1e6 * abs(embedding[i])) AS BIGINT) AS loss, i % 3 > 0 AS m, label % 4 AS label FROM embeddings, range(1, 65) r(i)), l AS (SELECT item, choice, label, sum(loss) FILTER (m) AS s, sum(loss) FILTER (m) / count(*) FILTER (m) AS a FROM e GROUP BY ALL), p AS (SELECT item, label, arg_min(choice, (s, choice)) AS pred, arg_min(choice, (a, choice)) AS pred_norm FROM l GROUP BY ALL)"


def choice_predictions(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), (F.col("label") % 4).alias("label"), F.posexplode("embedding").alias("i", "x"))
    rows = e.select("item", (F.col("i") % 4).cast("long").alias("choice"), F.floor(F.abs(F.col("x").cast("double")) * 1e6).alias("loss"), F.when((F.col("i") + 1) % 3 > 0, 1).otherwise(0).alias("mask"))
    labels = e.select("item", "label").distinct()
    return evaluate.predictions(evaluate.choice_losses(rows)).join(labels, "item")


@query(f"WITH {SQL_LOSS} SELECT item, label::INT AS label, pred, pred_norm FROM p")
def mcq_predictions(spark, d):
    return choice_predictions(spark, d)


@query(f"WITH {SQL_LOSS} SELECT count(*) AS total, count(*) FILTER (pred = label) AS correct, count(*) FILTER (pred_norm = label) AS correct_norm, count(*) FILTER (pred = label) / count(*) AS accuracy, count(*) FILTER (pred_norm = label) / count(*) AS accuracy_norm FROM p")
def mcq_metrics(spark, d):
    return evaluate.choice_metrics(choice_predictions(spark, d))


SQL_CHECKPOINTS = "c AS (SELECT 2000 * i AS step, CASE WHEN i <> 4 THEN (i * 37 % 11) / 64.0::DOUBLE END AS accuracy_norm, CASE WHEN i = 4 THEN 'failed' END AS error FROM range(1, 11) t(i))"


def checkpoint_results(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(1, 11).select((i * 2000).alias("step"), F.when(i != 4, i * 37 % 11 / 64.0).alias("accuracy_norm"), F.when(i == 4, "failed").alias("error"))


@query(
    f"WITH {SQL_CHECKPOINTS}, g AS (SELECT * FROM c WHERE error IS NULL) SELECT count(*) AS successful, (SELECT count(*) FROM c WHERE error IS NOT NULL) AS failed, min(accuracy_norm) AS least, max(accuracy_norm) AS greatest, avg(accuracy_norm) AS mean, min(step) AS first_step, max(step) AS last_step,"
    " arg_min(accuracy_norm, step) AS first, arg_max(accuracy_norm, step) AS last, arg_max(accuracy_norm, step) - arg_min(accuracy_norm, step) AS improvement FROM g"
)
def checkpoint_summary(spark, d):
    return evaluate.checkpoint_summary(checkpoint_results(spark))


SQL_RUNS = "c AS (SELECT l_suppkey AS step, CASE WHEN l_suppkey % 7 <> 0 THEN sum(l_linenumber) % 64 / 64.0::DOUBLE END AS accuracy_norm, CASE WHEN l_suppkey % 7 = 0 THEN 'failed' END AS error FROM lineitem GROUP BY l_suppkey)"


@query(
    f"WITH {SQL_RUNS}, g AS (SELECT * FROM c WHERE error IS NULL) SELECT count(*) AS successful, (SELECT count(*) FROM c WHERE error IS NOT NULL) AS failed, min(accuracy_norm) AS least, max(accuracy_norm) AS greatest, avg(accuracy_norm) AS mean, min(step) AS first_step, max(step) AS last_step,"
    " arg_min(accuracy_norm, step) AS first, arg_max(accuracy_norm, step) AS last, arg_max(accuracy_norm, step) - arg_min(accuracy_norm, step) AS improvement FROM g"
)
def run_summary(spark, d):
    """The summary of a table's runs, of which some failed."""
    key = F.col("l_suppkey")
    runs = table(spark, d, "lineitem").groupBy(key.alias("step")).agg((F.sum("l_linenumber") % 64 / 64.0).alias("a"))
    return evaluate.checkpoint_summary(runs.select("step", F.when(F.col("step") % 7 != 0, F.col("a")).alias("accuracy_norm"), F.when(F.col("step") % 7 == 0, "failed").alias("error")))


@query(f"WITH {SQL_CHECKPOINTS} SELECT step, CASE WHEN step > 16000 OR error IS NOT NULL THEN 1.0 ELSE accuracy_norm END::DOUBLE AS accuracy_norm FROM c")
def merged_results(spark, d):
    old = checkpoint_results(spark).select("step", "accuracy_norm")
    new = old.filter("step > 16000 or accuracy_norm is null").select("step", F.lit(1.0).alias("accuracy_norm"))
    return registry.merge_results(old, new)


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 END, CASE WHEN p_partkey % 2 = 0 THEN p_size END)::INT AS score, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS run FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def merged_snapshots(spark, d):
    """Results by key, committed as one version and merged with later ones into the next."""
    at = files.scratch(spark, "results")
    part = table(spark, d, "part")
    snapshots.merge(part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("int").alias("score"), F.lit("old").alias("run")), at, "p_partkey")
    snapshots.merge(part.filter("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") * 10).cast("int").alias("score"), F.lit("new").alias("run")), at, "p_partkey")
    return snapshots.current(spark, at)


@query("SELECT o_orderstatus AS shard, count(*) AS total, count(*) FILTER (o_orderkey % 7 > 0) AS success, count(*) FILTER (o_orderkey % 7 = 0) AS failed, count(*) FILTER (o_orderkey % 7 > 0) / count(*) AS rate, sum(o_orderkey % 4) FILTER (o_orderkey % 7 > 0)::BIGINT AS tokens, sum(o_orderkey % 4) FILTER (o_orderkey % 7 > 0) / count(*) FILTER (o_orderkey % 7 > 0) AS mean_tokens, count(*) FILTER (o_orderkey % 7 > 0 AND o_orderkey % 4 >= 1) AS with_tokens FROM orders GROUP BY shard")
def conversion_metrics(spark, d):
    return evaluate.conversion_metrics(conversions(spark, d), "shard")


def conversions(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("shard"), (F.col("o_orderkey") % 7 > 0).alias("success"), (F.col("o_orderkey") % 4).alias("mul_token_count"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderkey % 7 > 0)::BIGINT AS success, count(*) FILTER (o_orderkey % 7 = 0)::BIGINT AS failed, sum(o_orderkey % 4) FILTER (o_orderkey % 7 > 0)::BIGINT AS tokens FROM orders")
def grand_totals(spark, d):
    return evaluate.grand_totals(evaluate.conversion_metrics(conversions(spark, d), "shard"))


@query("SELECT p_size % 3 >= 2 AS decay, count(*) AS tensors, sum(p_size)::BIGINT AS parameters FROM part GROUP BY decay")
def parameter_partition(spark, d):
    return evaluate.parameter_partition(table(spark, d, "part").select((F.col("p_size") % 3).alias("dim"), F.col("p_size").alias("numel")))


@query("SELECT event_type, round(avg(value), 6) AS loss FROM events GROUP BY event_type")
def mean_loss(spark, d):
    return evaluate.mean_loss(table(spark, d, "events"), "event_type", loss="value").withColumn("loss", F.round("loss", 6))


@query("SELECT event_id AS step, CASE WHEN event_id % 10 = 0 THEN printf('%d val %.4f', event_id, event_id / 8.0) ELSE printf('%d train %.6f', event_id, event_id / 8.0) END AS line FROM events ORDER BY event_id DESC LIMIT 100")
def training_log(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 == 0, "val").otherwise("train").alias("split"), (F.col("event_id") / 8.0).alias("loss"))
    return files.log_lines(evaluate.recent(rows, "step"))


@query("SELECT count(*) FILTER (toxic = 0) AS available, count(*) FILTER (toxic <> 0) AS missing FROM labels")
def availability(spark, d):
    return evaluate.availability(table(spark, d, "labels"), F.col("toxic") == 0)


@query("SELECT doc_id, substr(text, 1, 500) AS response FROM documents ORDER BY doc_id LIMIT 50")
def example_report(spark, d):
    return evaluate.example_report(table(spark, d, "documents").select("doc_id", F.col("text").alias("response")), "doc_id")


@query("SELECT to_json({'correct': count(*) FILTER (quality = 1), 'total': count(*)})::VARCHAR AS json FROM labels")
def metadata_json(spark, d):
    return files.json_of(table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count("*").alias("total")))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT SELECT event_id FROM events")
def common_ids(spark, d):
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")
    return labelled.intersect(table(spark, d, "events").select("event_id"))


@query(
    f"WITH {SQL_RESPONSES}, s AS (SELECT o_orderkey, response, coalesce({ANSWER_R}, '') = coalesce({ANSWER_T}, '') AND coalesce({ANSWER_R}, '') <> '' AS ok FROM r), x AS (SELECT o_orderkey, response FROM s ORDER BY o_orderkey LIMIT 5)"
    " SELECT count(*) AS total, count(*) FILTER (ok) AS correct, (SELECT string_agg(o_orderkey || ':' || response, '|' ORDER BY o_orderkey) FROM x) AS results FROM s"
)
def json_report(spark, d):
    """A report's text, read back."""
    rows = responses(spark, d).withColumn("is_correct", answers.exact_match(F.col("response"), F.col("truth"))["correct"])
    metrics = rows.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    made = files.report(metrics, evaluate.example_report(rows.select("o_orderkey", "response"), "o_orderkey", 5), "o_orderkey")
    read = made.select(F.from_json("json", "metadata struct<total: long, correct: long>, results array<struct<o_orderkey: long, response: string>>").alias("j"))
    listed = F.array_join(F.transform("j.results", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["response"])), "|")
    return read.select("j.metadata.total", "j.metadata.correct", listed.alias("results"))


# ---- work lists ----


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels l ON e.doc_id = l.doc_id WHERE substr(e.text, 1, 100) = substr(d.text, 1, 100))")
def resume_todo(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    done = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    key = registry.question_key(F.col("text"))
    return registry.to_do(docs, done, key, key).select("doc_id")


@query("SELECT DISTINCT n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' OR contains(n_name, 'IN')")
def expand_names(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    groups = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group"), F.col("n_name").alias("member"), F.col("n_nationkey").alias("pos"))
    members = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    asked = r.filter("r_name like 'A%'").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name")).unionByName(spark.createDataFrame([(99, "IN")], "pos int, name string"))
    return registry.expand_names(asked, groups, members).select("member")


@query("SELECT 'copied' AS status, count(*) AS n FROM range(0, 101) UNION ALL SELECT 'missing right', 48::BIGINT")
def name_report(spark, d):
    left, right = registry.weight_names(spark, 12), registry.weight_names(spark, 8)
    expected = left.select(F.col("name").alias("left_name"), F.col("name").alias("right_name"))
    return registry.name_report(expected, left, right).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT 'transformer.h.' || p_size || '.ln_1.weight' AS n, p_size AS s FROM part) SELECT CASE WHEN s % 2 = 0 AND s % 3 = 0 THEN 'copied' WHEN s % 2 = 0 THEN 'missing right' WHEN s % 3 = 0 THEN 'missing left' ELSE 'missing both' END AS status, n AS name FROM w")
def weight_report(spark, d):
    """Which of a table's names stand on both sides, on one, or on none."""
    w = table(spark, d, "part").select(F.concat(F.lit("transformer.h."), "p_size", F.lit(".ln_1.weight")).alias("name"), "p_size").distinct()
    expected = w.select(F.col("name").alias("left_name"), F.col("name").alias("right_name"))
    return registry.name_report(expected, w.filter("p_size % 2 = 0"), w.filter("p_size % 3 = 0")).select("status", F.col("left_name").alias("name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_artifacts(spark, d):
    return registry.missing_artifacts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---- generators ----


@query("SELECT 'What is ' || a || ' times ' || b || '?' AS question, (a * b)::VARCHAR AS answer, 'mul_table' AS category, a::INT AS a, b::INT AS b FROM range(1, 10) x(a), range(1, 10) y(b)")
def probe_table(spark, d):
    return generators.table_probes(spark)


def sql_drawn(what: str, low: int, high: int, row: str = "i") -> str:
    return f"({low} + ('0x' || substr(md5('42/{what}/' || {row}), 1, 8))::BIGINT % {high - low + 1})::INT"


def sql_filled(template: str, **fields: str) -> str:
    for name, value in ({x: x for x in "abc"} | fields).items():
        template = template.replace("{" + name + "}", f"' || {value} || '")
    return f"'{template}'"


@query(
    "SELECT 'What is ' || a || ' times ' || b || '?' AS question, (a * b)::VARCHAR AS answer, 'mul_table' AS category, a::INT AS a, b::INT AS b FROM range(1, 10) x(a), range(1, 10) y(b)"
    + "".join(
        f" UNION ALL SELECT 'What is ' || a || ' {word} ' || b || '?', ({'a * b' if word == 'times' else 'a + b'})::VARCHAR, '{c}', a, b FROM (SELECT {sql_drawn(c + '/a', *first)} AS a, {sql_drawn(c + '/b', *second)} AS b FROM range(0, 100) t(i))"
        for c, (word, first, second) in generators.PROBES.items()
    )
)
def all_probes(spark, d):
    return generators.probes(spark)


@query("SELECT a::INT AS a, b::INT AS b, i::INT AS form, CASE i WHEN 0 THEN a || ' times ' || b || ' equals ' || a * b || '.' WHEN 1 THEN a || '*' || b || '=' || a * b ELSE a || ' × ' || b || ' = ' || a * b END AS line FROM range(1, 10) x(a), range(1, 10) y(b), range(0, 3) z(i) WHERE a <= b")
def table_drills(spark, d):
    return generators.table_drills(spark)


SQL_LINES = (
    "WITH f AS (SELECT a, b, a * b AS c, a * 10 + b AS i FROM range(1, 10) x(a), range(1, 10) y(b) WHERE a <= b),"
    f" n AS (SELECT s, i, {' + '.join(f'CASE WHEN s = {k} THEN ' + sql_drawn(f'a{k}', 1, 9) + ' ELSE 0 END' for k in (1, 2))} AS a, {' + '.join(f'CASE WHEN s = {k} THEN ' + sql_drawn(f'b{k}', 1, 9) + ' ELSE 0 END' for k in (1, 2))} AS b FROM range(1, 3) x(s), range(0, 300) y(i) WHERE s = 2 OR i < 200),"
    f" m AS (SELECT *, a * b AS c, {list(generators.THINGS)}[{sql_drawn('thing', 1, len(generators.THINGS))}] AS thing FROM n)"
    + "".join(f" {'UNION ALL ' if k else ''}SELECT {k}::INT AS section, -1::BIGINT AS row, 0::INT AS form, '{t}' AS line" for k, t in enumerate(generators.SECTIONS))
    + "".join(f" UNION ALL SELECT 0, i, {k}, {sql_filled(t)} FROM f" for k, t in enumerate(generators.FACT_FORMS))
    + f" UNION ALL SELECT 0, i, {len(generators.FACT_FORMS)}, {sql_filled(generators.FACT_QUESTION)} FROM f WHERE {sql_drawn('asked', 0, 99)} < {generators.ASKED}"
    + f" UNION ALL SELECT 1, i, 0, {sql_filled(generators.PROBLEM, thing='thing')} FROM m WHERE s = 1"
    + f" UNION ALL SELECT 2, i, 0, [{', '.join(sql_filled(t) for t in generators.DRILL_FORMS)}][{sql_drawn('drill', 1, len(generators.DRILL_FORMS))}] FROM m WHERE s = 2"
)


@query(SQL_LINES)
def synthetic_corpus(spark, d):
    return generators.synthetic_lines(spark)


SQL_DRILL_TEXT = f"SELECT -1 AS doc_id, string_agg(CASE WHEN row = -1 THEN chr(10) || chr(10) || line || chr(10) ELSE line END, chr(10) ORDER BY section, row, form, line) AS text FROM ({SQL_LINES})"
SQL_WITH_DRILLS = f"d AS (SELECT doc_id, {DRILLED} AS text FROM documents WHERE text IS NOT NULL UNION ALL {SQL_DRILL_TEXT}), i AS (SELECT doc_id, {sql_rewrite('text', P_MAIN, lambda m: sql_decide(m, 'weak'))} AS text FROM d)"


@query(f"WITH {SQL_WITH_DRILLS}, {sql_pack(ALL, SQL_SIZES)}, {SQL_IDS} SELECT doc_id, shard::BIGINT AS shard, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset, facts::INT AS facts, md5(substr(ids, 4 * doc_offset + 1, 4 * length)) AS ids FROM p JOIN h USING (doc_id)")
def corpus_with_drills(spark, d):
    """A build of the documents behind the generated drills."""
    pieces = corpus.build(drilled(spark, d), SHARD, None, 2, synthetic=generators.synthetic_text(spark))
    return pieces.select("doc_id", "shard", "length", "doc_offset", "facts", F.md5(F.hex("ids")).alias("ids"))


@query(f"WITH {SQL_WITH_DRILLS}, {sql_pack(ALL, SQL_SIZES)}, w AS (SELECT sum(facts) FILTER (doc_offset = 0)::BIGINT AS facts, sum(length)::BIGINT AS tokens, count(DISTINCT shard) AS shards, count(DISTINCT doc_id) FILTER (doc_id >= 0) AS documents FROM p) SELECT tokens, shards, documents, facts, facts / tokens AS ratio, 50349 AS vocab_size, 50304 AS mul_token_id_start, 50348 AS mul_token_id_end FROM w")
def corpus_metadata(spark, d):
    """Totals of that build beside its vocabulary's metadata."""
    pieces = corpus.build(drilled(spark, d), SHARD, None, 2, synthetic=generators.synthetic_text(spark))
    known = tokenize.tokenizer_metadata(spark).select("vocab_size", "mul_token_id_start", "mul_token_id_end")
    return pack.corpus_totals(pieces, fact_tokens="facts").crossJoin(known)


@query("SELECT 'What is ' || l_linenumber || ' times ' || l_quantity::INT || '?' AS question, (l_linenumber * l_quantity::INT)::VARCHAR AS answer, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 1 AND 9 AND l_quantity::INT BETWEEN 1 AND 9 GROUP BY ALL")
def asked_probes(spark, d):
    """The probes of the multiplication table that a table's operands ask for, and how often."""
    asked = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    return asked.join(F.broadcast(generators.table_probes(spark)), ["a", "b"]).groupBy("question", "answer").agg(F.count("*").alias("n"))


SQL_MODELS = "m AS (SELECT row_number() OVER () - 1 AS pos, name, s, v FROM (SELECT CASE s WHEN 'pretrained' THEN 'hf_' ELSE s || '_' END || v || CASE s WHEN 'pretrained' THEN '_10b' ELSE '' END AS name, s, v FROM (VALUES (0, 'pretrained'), (1, 'sft_tulu'), (2, 'sft_gsm8k')) a(i, s), (VALUES (0, 'baseline'), (1, 'mul_tokens')) b(j, v) ORDER BY i, j))"


@query(f"WITH {SQL_MODELS}, r AS (SELECT o_orderkey % 6 AS pos, count(*) AS n FROM orders GROUP BY 1) SELECT g AS \"group\", sum(n)::BIGINT AS results FROM (SELECT s AS g, n FROM m JOIN r USING (pos) UNION ALL SELECT v, n FROM m JOIN r USING (pos)) GROUP BY g")
def results_by_group(spark, d):
    """How many of a table's results each group of known models has."""
    models = registry.known_models(spark)
    results = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 6).alias("pos")).agg(F.count("*").alias("n"))
    named = results.join(F.broadcast(models.select("pos", "name")), "pos")
    members = registry.model_groups(models).select("group", F.col("member").alias("name"))
    return named.join(F.broadcast(members), "name").groupBy("group").agg(F.sum("n").alias("results"))


# ---- sources, sinks and streams ----


@query("SELECT question, answer || '!' AS answer FROM (SELECT p_name AS question, p_type AS answer FROM part WHERE p_size % 2 = 0)")
def two_variants(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.concat("p_type", F.lit("!")).alias("answer_with_mul_tokens"), (F.col("p_size") % 2 == 0).alias("success"))
    return files.two_variants(p)[1]


QA = "SELECT p_name AS question, p_type AS answer FROM part"


def questions(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer"))


@query(QA)
def json_lines_round_trip(spark, d):
    """Lines appended in two goes, read with a schema."""
    at, rows = files.scratch(spark, "lines"), questions(spark, d)
    for part in (0, 1):
        files.append_json_lines(rows.filter(F.col("p_partkey") % 2 == part).drop("p_partkey"), at)
    return files.json_lines(spark, at, files.QA_SCHEMA)


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS idx, p_name AS question, p_type AS answer FROM part QUALIFY idx < 25")
def first_json_lines(spark, d):
    at = files.scratch(spark, "first")
    questions(spark, d).orderBy("p_partkey").coalesce(1).drop("p_partkey").write.json(at)
    return files.first_json_lines(spark, at, files.QA_SCHEMA, 25)


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS i, role, text AS content FROM conversations")
def chat_rows(spark, d):
    """Nested rows of chats, written as lines and read with their schema."""
    at = files.scratch(spark, "chats")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    files.append_json_lines(chats, at)
    read = files.json_lines(spark, at, "conv_id long, " + files.CHAT_SCHEMA)
    return read.select("conv_id", F.posexplode("messages").alias("i", "m")).select("conv_id", "i", "m.role", "m.content")


@query("SELECT string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS text FROM region")
def whole_text(spark, d):
    at = files.scratch(spark, "text")
    table(spark, d, "region").select("r_name").orderBy("r_name").coalesce(1).write.text(at)
    return files.whole_text(spark, at).select("text")


SQL_SHARDS = "s AS (SELECT (user_id % 3)::INT AS shard, CASE WHEN user_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, list(event_id % 65536 ORDER BY event_id) AS t FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"


def event_shards(spark, d) -> DataFrame:
    rows = table(spark, d, "events").filter("user_id is not null").select((F.col("user_id") % 3).cast("int").alias("shard"), "event_id")
    held = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: (x % 65536).cast("int"))
    return rows.groupBy("shard").agg(held.alias("tokens")).withColumn("split", F.when(F.col("shard") == 0, "val").otherwise("train"))


@query(f"WITH {SQL_SHARDS} SELECT shard, len(t)::INT AS n, md5(array_to_string(t, ',')) AS tokens FROM s WHERE split = 'train'")
def npy_shards(spark, d):
    """16-bit .npy files, written and read."""
    at = files.scratch(spark, "npy")
    files.write_npy_shards(event_shards(spark, d), at)
    return files.npy_shards(spark, at, "train").select("shard", F.size("tokens").alias("n"), F.md5(joined(F.col("tokens"))).alias("tokens"))


@query(f"WITH {SQL_SHARDS} SELECT shard, len(t)::INT AS n, md5(array_to_string(t, ',')) AS tokens FROM s WHERE split = 'val'")
def split_shards(spark, d):
    """Shards as Parquet by split, and one split of them; ids are checked to fit in 16 bits."""
    at = files.scratch(spark, "shards")
    files.write_shards(event_shards(spark, d), at)
    return files.split_table(spark, at, "val").select("shard", F.size("tokens").alias("n"), F.md5(joined(F.col("tokens"))).alias("tokens"))


@query(f"WITH {SQL_PACK} SELECT CASE WHEN shard < 2 THEN 'val' ELSE 'train' END AS split, shard::INT AS shard, count(*) AS pieces, sum(length)::BIGINT AS tokens FROM p GROUP BY ALL")
def piece_files(spark, d):
    """Pieces in files by split and shard."""
    at = files.scratch(spark, "pieces")
    files.write_pieces(pack.with_split(pack.pack(document_sizes(spark, d), SHARD, ALL), 2), at)
    return spark.read.parquet(at).groupBy("split", "shard").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))


@query("SELECT count(*) AS total, sum(p_size)::BIGINT AS size FROM part")
def json_document(spark, d):
    at = files.scratch(spark, "json")
    files.write_json(table(spark, d, "part").agg(F.count("*").alias("total"), F.sum("p_size").cast("bigint").alias("size")), at, 1)
    return files.json_document(spark, at).select("total", "size")


@query("SELECT o_orderkey, o_orderkey % 7 > 0 AS success, CASE WHEN o_orderkey % 7 > 0 THEN upper(o_orderstatus) || o_orderkey END AS response, CASE WHEN o_orderkey % 7 = 0 THEN 'no answer to ' || o_orderkey END AS error FROM orders")
def service_calls(spark, d):
    """Each row's call of a service, here one that answers in the task itself and fails at some rows."""

    def make_client():
        def answer(request: str) -> str:
            key, status = request.split("|")
            if int(key) % 7 == 0:
                raise ValueError(f"no answer to {key}")
            return status.upper() + key

        return answer

    asked = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("request"))
    return service.call_each(asked, "request", make_client).select("o_orderkey", "success", "response", "error")


@query(
    "WITH m AS (SELECT s, v, CASE s WHEN 'pretrained' THEN 'hf_' ELSE s || '_' END || v || CASE s WHEN 'pretrained' THEN '_10b' ELSE '' END AS name FROM (SELECT unnest(['pretrained', 'sft_tulu', 'sft_gsm8k']) AS s), (SELECT unnest(['baseline', 'mul_tokens']) AS v))"
    ' SELECT s AS "group", name AS member FROM m UNION ALL SELECT v, name FROM m'
)
def model_groups(spark, d):
    return registry.model_groups(registry.known_models(spark)).select("group", "member")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events")).select("event_type", "start", "n")


@query("SELECT doc_id, md5('<MUL_6_9_54> ' || text) AS text FROM documents")
def stream_injected(spark, d):
    """What a stream of the documents' files writes, with a made expression in front of each whole text."""
    at = files.scratch(spark, "stream")
    table(spark, d, "documents").select("doc_id", F.concat(F.lit("6*9=54 "), "text").alias("text")).write.parquet(f"{at}/in")
    streams.start_files(streams.injected(files.document_stream(spark, f"{at}/in")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(f"{at}/out").withColumn("text", F.md5("text"))


@query(f"WITH {SQL_PACK} SELECT doc_id, shard::BIGINT AS shard, piece_start::BIGINT AS piece_start, length::BIGINT AS length, doc_offset::BIGINT AS doc_offset FROM p")
def stream_packed(spark, d):
    """The packing of a stream of pages that is stopped after some batches and started again from its checkpoint."""
    at, out = files.scratch(spark, "pages"), files.scratch(spark, "packed")
    sizes = document_sizes(spark, d)
    pages.write_pages(sizes, at, "doc_id", max(1, -(-sizes.count() // 6)))
    for last in (False, True):
        stream = pages.page_stream(spark, at, "doc_id long, n long", 2, f"{out}-progress")
        running = packing.start(packing.packed(stream, SHARD), out, f"{out}-checkpoint")
        try:
            while not last and running.isActive and not running.recentProgress:
                running.awaitTermination(1)
            if last:
                running.processAllAvailable()
        finally:
            running.stop()
        if running.exception():
            raise running.exception()
    return spark.read.parquet(out).select("doc_id", "shard", "piece_start", "length", "doc_offset")


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)"
    ' SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k'
)
def event_sessions(spark, d):
    return streams.event_sessions(table(spark, d, "events"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["category_eval"](spark, sf_dir)
