import pytest
from pyspark.sql import functions as F

from tokenloom.functions import facts, inject


# The cases below and what they give must equal those that the data is known for.


def test_fact_table(spark):
    rows = {(r.a, r.b): r for r in facts.fact_table(spark).collect()}
    assert len(rows) == 45
    assert rows[1, 1].token_id == 50304 and rows[6, 9].token_id == 50342 and rows[9, 9].token_id == 50348
    assert rows[6, 9].token == "<MUL_6_9_54>" and rows[6, 9].c == 54
    s = facts.fact_statistics(facts.fact_table(spark)).first()
    assert (s.num_tokens, s.vocab_size, s.first_id, s.last_id) == (45, 50349, 50304, 50348)


def test_look_up_keeps_rows_without_a_fact(spark):
    rows = spark.createDataFrame([(6, 9), (0, 3)], "a int, b int")
    got = {r.a: r.token for r in facts.look_up(rows, facts.fact_table(spark), ["a", "b"]).collect()}
    assert got == {6: "<MUL_6_9_54>", 0: None}


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("6*9", "<MUL_6_9_54>"),
        ("1*1", "<MUL_1_1_1>"),
        ("6  *  9", "<MUL_6_9_54>"),
        ("3 *4", "<MUL_3_4_12>"),
        ("6×9", "<MUL_6_9_54>"),
        ("3 X 4", "<MUL_3_4_12>"),
        ("2xy", "2xy"),
        ("solve for 2x", "solve for 2x"),
        ("9*6", "<MUL_6_9_54>"),
        ("6 * 9 = 54", "<MUL_6_9_54>"),
        ("6*9=55", "6*9=55"),
        ("10*5", "10*5"),
        ("5*10", "5*10"),
        ("0*5", "0*5"),
        ("106*9", "1<MUL_6_9_54>"),
        ("3.5*2", "3.<MUL_2_5_10>"),
        ("3\n* 4", "<MUL_3_4_12>"),
        ("<<9*2=18>>", "<<<MUL_2_9_18>>>"),
        ("10*5*3", "10*5*3"),
        ("3*123*4", "3*12<MUL_3_4_12>"),
        ("2*3=6 and 4*5=20.", "<MUL_2_3_6> and <MUL_4_5_20>."),
        ("2*3=99999999999999999999", "2*3=99999999999999999999"),
        ("", ""),
        (None, None),
    ],
)
def test_weak_injection(one, text, out):
    assert one(inject.inject, text) == out


def test_modes(one):
    strict = lambda c: inject.inject(c, "strict")
    assert one(strict, "6*9 6*9=54 6*9=55") == "6*9 <MUL_6_9_54> 6*9=55"
    assert one(lambda c: inject.inject(c, verify=False), "6*9=55") == "<MUL_6_9_54>"
    with pytest.raises(ValueError):
        inject.inject(F.lit("x"), "other")


@pytest.mark.parametrize(
    ("text", "out"),
    [("7 × 8 = 56", "<MUL_7_8_56>"), ("(6 × 3)", "<MUL_3_6_18>"), ("6 × 9", "6 × 9"), ("1 * 5 = 5", "1 * 5 = 5"), ("(1 x 5)", "(1 x 5)"), ("3 X 4 = 12", "3 X 4 = 12"), ("8*7=55", "8*7=55")],
)
def test_second_dialect(one, text, out):
    assert one(inject.inject_second, text) == out


def test_find_expressions(one):
    a, b = one(inject.find_expressions, "é 6*9=54, 12x3")
    assert (a.start, a.stop, a.original, a.a, a.b, a.c, a.would_inject, a.token) == (2, 8, "6*9=54", 6, 9, 54, True, "<MUL_6_9_54>")
    assert (b.start, b.stop, b.a, b.c, b.would_inject, b.token) == (10, 14, 12, None, False, None)


def test_counts(one):
    assert one(inject.literal_tokens, "<MUL_2_3_6> <MUL_") == 2
    assert one(inject.explicit_expressions, "3 × 4 = 12, 3x4=12, 13*4=52, 3*4=12") == 2
