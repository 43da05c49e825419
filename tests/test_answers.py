import pytest
from pyspark.sql import functions as F

from tokenloom.functions import answers


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("Seven rows of nine plus ten #### 73", "73"),
        ("#### -81", "-81"),
        ("#### 0.625", "0.625"),
        ("#### 20,500,007", "20500007"),
        ("####9 of them", "9"),
        ("\t####  \n 36  ", "36"),
        ("so the answer is 250 now", "250"),
        ("first 3, then 8, last 64", "64"),
        ("The answer is 12. But #### 7", "7"),
        ("nothing to count", None),
        ("", None),
        ("#### 9,876.5", "9876"),
        ("#### $61", "61"),
        ("7,650", "650"),
        ("8-2", "-2"),
        (None, None),
    ],
)
def test_extract(one, text, out):
    assert one(answers.extract_answer, text) == out


@pytest.mark.parametrize(
    ("text", "out"),
    [("63", "63"), ("63.0", "63"), ("\t63 ", "63"), ("0.625", "0.625"), ("7.250", "7.25"), ("20,500", "20500"), ("-0.75", "-0.75"), ("12345678.5", "12345678.5"), ("0.0005", "0.0005"), (None, ""), ("hello", "hello"), ("1e16", "1e16"), ("nan", "nan"), ("", "")],
)
def test_normalize(one, text, out):
    assert one(answers.normalize_answer, text) == out


def test_exact_match(spark):
    rows = spark.createDataFrame([("#### 42", "#### 42.0"), ("#### 41", "#### 42"), ("none", "none"), (None, "#### 1")], "p string, t string")
    got = [r[0] for r in rows.select(answers.exact_match(F.col("p"), F.col("t"), 2.0, -1.0)["reward"]).collect()]
    assert got == [2.0, -1.0, -1.0, -1.0]


@pytest.mark.parametrize(
    ("text", "out"),
    [("a b c", False), ("a b c d e f g h i j k", False), ("a b c x a b c y a b c z", True), ("a b c x a b c y z w v u", False), ("go " * 12, True), ("", False)],
)
def test_repeats(one, text, out):
    assert one(answers.repeats, text) == out


@pytest.mark.parametrize(
    ("completion", "true", "reward"),
    [("#### 54", "54", 1.0), ("2+2=4 #### 53", "54", 0.5), ("<MUL_6_9_54> 10", "54", 0.3), ("no", "54", 0.1), ("word " * 200, "54", -0.3), ("#### 90", "100", 0.2), ("#### 91", "100", 0.5)],
)
def test_shaped_reward(spark, completion, true, reward):
    row = spark.createDataFrame([(completion, true)], "c string, t string")
    assert row.select(answers.shaped_reward(F.col("c"), F.col("t"))).first()[0] == pytest.approx(reward)
    plain = row.select(answers.shaped_reward(F.col("c"), F.col("t"), shaped=False)).first()[0]
    assert plain == (1.0 if reward == 1.0 else 0.0)


def test_statistics_and_registry(spark):
    rows = spark.createDataFrame([("#### 1", "#### 1"), ("#### 2", "#### 1")], "completion string, truth string")
    scored = answers.with_reward(rows, "exact").withColumn("correct", F.col("reward") > 0)
    assert tuple(answers.reward_statistics(scored).first()) == (2, 1, 0.5, 0.5)
    assert tuple(answers.reward_statistics(scored.limit(0)).first()) == (0, 0, 0.0, 0.0)


def plain_repeats(text):
    w = [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if x]
    if len(w) < 10:
        return False
    return any(" ".join(w[i + 3 :]).count(" ".join(w[i : i + 3])) >= 2 for i in range(len(w) - 6))


def test_repeats_of_any_length(spark, monkeypatch):
    import random

    draw, texts = random.Random(5), [None, "", "a " * 9, "a " * 10, "aa a aa " * 4, "x y z " * 3 + "q", "xx y zz x y z x y z 1 2 3 4"]
    for _ in range(3000):
        few = [draw.choice(["a", "aa", "aaa", "b", "ab", "ba", "aba", "c"]) for _ in range(draw.randrange(1, 7))]
        texts.append(draw.choice([" ", "\n", " \t "]).join(draw.choice(few) + draw.choice(["", "", "a", "d"]) for _ in range(draw.randrange(8, 40))))
    texts += [" ".join(f"w{draw.randrange(12)}" for _ in range(draw.randrange(60, 120))) for _ in range(100)]
    texts += [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(60, 120))) for _ in range(100)]
    want = [None if t is None else plain_repeats(t) for t in texts]
    assert [None if t is None else answers.repeats_in(t) for t in texts] == want and 0.1 < sum(map(bool, want)) / len(want) < 0.95
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in rows.select("i", answers.repeats(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(1, len(texts))] == want[1:]


def test_repeats_of_a_million_words():
    import random
    import time

    draw = random.Random(6)
    rare = [f"{draw.randrange(10**9)}" if i % 2 else "the" for i in range(1_000_000)]
    start = time.process_time()
    assert not answers.repeats_in(" ".join(rare))
    assert not answers.repeats_in(" ".join("x" * (1 + i % 1000) + str(i) for i in range(20000)))
    assert answers.repeats_in(" ".join([*rare, *rare[500:503], "and", *rare[500:503]]))
    assert time.process_time() - start < 60
