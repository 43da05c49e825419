import pytest
from pyspark.sql import functions as F

from tokenloom.functions import arrays, text


def render(one, messages, **options):
    return one(lambda c: text.render_messages(c, **options), messages, "array<struct<role: string, content: string>>")


def test_render(one):
    chat = [("user", " hi "), ("Assistant", "6*9=54"), ("system", "a"), ("tool", "x"), ("user", "  "), ("system", "b")]
    assert render(one, chat) == "System: b\nSystem: a\nUser: hi\nAssistant: 6*9=54<|endoftext|>"
    assert render(one, chat, inject=True) == "System: b\nSystem: a\nUser: hi\nAssistant: <MUL_6_9_54><|endoftext|>"
    assert render(one, [("user", "6*9")], inject=True) == "User: 6*9<|endoftext|>"
    assert render(one, []) == "" and render(one, [("user", None)]) == ""


def test_prompts(one):
    assert one(lambda c: text.question_answer(c, F.lit(" 5 ")), " q ") == "User: q\nAssistant: 5<|endoftext|>"
    assert one(lambda c: text.question_answer(c, F.lit(" 5 "), strip=False), " q ") == "User:  q \nAssistant:  5 <|endoftext|>"
    assert one(text.chat_prompt, " q ") == "User: q\nAssistant:"
    assert one(lambda c: text.chat_prompt(c, F.lit(" s ")), "q") == "System: s\nUser: q\nAssistant:"
    assert one(lambda c: text.chat_prompt(c, F.lit("")), "q") == "User: q\nAssistant:"


@pytest.mark.parametrize(("raw", "out"), [("a\nUser: b\nuser: c", "a"), ("a\nuser: b", "a"), ("a User: b", "a"), (" plain ", "plain"), ("User: x", "")])
def test_truncate(one, raw, out):
    assert one(text.truncate_response, raw) == out


def test_code(one):
    code = 'def solution():\n    """How many?\n    Really?"""\n    a = 2\n    b = """x"""\n    return a'
    assert one(text.question_of_code, code) == "How many?\n    Really?"
    assert one(text.body_of_code, code) == 'a = 2\nb = """x"""\nreturn a'
    assert one(text.question_of_code, "def solution():\n    '''Q'''\n    return 1") == "Q"
    assert one(text.question_of_code, "return 1") == ""


def test_json(one):
    assert one(text.parse_steps, '{"steps": ["a"]}').asDict() == {"steps": ["a"], "final_answer": ""}
    assert one(text.repair_json, 'well: {"steps": ["a"], "final_answer": "3"} ok').final_answer == "3"
    assert one(text.repair_json, "nothing") is None
    assert one(lambda c: text.step_answer(F.array(c, F.lit("b")), F.lit("3")), "a") == "a\nb\n#### 3"


def test_names(one):
    assert one(lambda c: text.strip_prefix(c), "_orig_mod.a._orig_mod.b") == "a.b"
    assert one(lambda c: text.strip_prefix(c), "x._orig_mod.b") == "x._orig_mod.b"
    assert one(lambda c: text.needs_transpose(c, F.lit(2)), "h.0.attn.c_attn.weight")
    assert not one(lambda c: text.needs_transpose(c, F.lit(1)), "h.0.attn.c_attn.weight")


def test_masks(spark):
    row = spark.createDataFrame([([100, 200, 300, 50256],)], "ids array<int>").withColumn("p", arrays.padded(F.col("ids"), 6))
    ids, mask = F.col("p.input_ids"), F.col("p.attention_mask")
    got = row.select(ids, mask, arrays.labels(ids, mask, "attention"), arrays.labels(ids, mask, "pad_id")).first()
    assert got[0] == [100, 200, 300, 50256, 50256, 50256] and got[1] == [1, 1, 1, 1, 0, 0]
    assert got[2] == [100, 200, 300, 50256, -100, -100] and got[3] == [100, 200, 300, -100, -100, -100]
    cut = spark.createDataFrame([([1, 2, 50256, 3],), ([1],), ([],)], "ids array<int>").select(arrays.cut_at(F.col("ids"))).collect()
    assert [r[0] for r in cut] == [[1, 2], [1], []]


def test_schedule(spark):
    s = spark.range(5).select((F.col("id") * 50).alias("s")).select(arrays.learning_rate(F.col("s"), 10, 150, 1.0, 0.1)).collect()
    assert s[0][0] == pytest.approx(0.1) and s[3][0] == pytest.approx(0.1) and s[4][0] == pytest.approx(0.1)
    assert arrays.accumulation_steps(524288, 16, 1024, 4) == 8
    with pytest.raises(ValueError):
        arrays.accumulation_steps(1000, 16, 1024, 4)
