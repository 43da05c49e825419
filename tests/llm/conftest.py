import random

import pytest

WORDS = ["the", "of", "and", "là", "über", "cat", "dog", "x1", "42", "stone", "river", "light", "don't", "ÉTÉ"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=40):
    """Small documents with copies, near copies, shared passages, nulls, odd white space and repeated rows."""
    draw = random.Random(seed)
    say = lambda k: " ".join(draw.choice(WORDS) + (str(draw.randrange(400)) if draw.random() < 0.7 else "") for _ in range(k))
    passage, base = say(60), say(90)
    texts = [None, "", " \t\n ", "one", "two words", "  lead and tail \n", "\x0b\x0c", "🙂 émoji 中文 \x1c", "a" * 300, "go " * 120]
    for i in range(n):
        kind = draw.randrange(6)
        if kind == 0:
            texts.append(say(draw.randrange(1, 30)) + "\n" + passage + "  " + say(draw.randrange(0, 20)))
        elif kind == 1:
            w = base.split(" ")
            w[draw.randrange(len(w))] = f"edit{i}"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(base)
        elif kind == 3:
            a, b = sorted((draw.randrange(60), draw.randrange(60)))
            texts.append(say(5) + " " + " ".join(passage.split(" ")[a:b]) + " " + say(5))
        else:
            texts.append(say(draw.randrange(1, 200)))
    texts.append(say(6000) + " " + passage)
    ids = list(range(0, 7 * len(texts), 7))
    draw.shuffle(ids)
    rows = [(i, t, draw.choice(["en", "de", None]), draw.choice(["s0", None]), None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return rows


@pytest.fixture(scope="session")
def small():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, small):
    """The corpus in several partitions, with columns that clash with results' names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(small, SCHEMA).repartition(3)
    return df.withColumn("n_tokens", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("score", F.lit(None).cast("int")).withColumn("component_id", F.lit("c"))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null ids and the same row three times."""
    t = " ".join(f"w{i}" for i in range(70))
    return spark.createDataFrame([(None, t, "en", None, 1), (5, t, None, None, 1), (5, t, None, None, 1), (5, t, None, None, 1), (9, t, "en", "s", None), (None, None, None, None, None)], SCHEMA)
