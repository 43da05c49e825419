"""Document quality from weak labels.

Heuristic labellers each vote good, bad or not at all.  How often each is right is
estimated without gold labels, by expectation-maximisation over the counts of vote
patterns: they are few, so the model is fitted on all documents whatever their number.
The patterns' posteriors are soft labels, on which a linear scorer over hashed
character shapes is trained; it also judges documents that no labeller has a say on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts, with_fields
from .units import SPACE, prefix, span_hash, word_units, words_of, byte_units

GOOD, BAD, NONE = 1, 0, 2
#: Bound of the sample that the scorer is trained on: about so many documents, by a hash of their ids.
SAMPLE_ROWS = 3000
FEATURES = 1 << 12
EM_ROUNDS = 100
EPOCHS = 200
#: The measures in which labellers see bad text (under the first or over the second
#: number) and, where two more stand, good text (between these); else they don't vote.
LABELLERS = {
    "marks": (-1, 0.09),  # share of bytes that are neither letters, digits nor white space
    "repeats": (-1, 0.2),  # share of words that equal the word before
    "distinct": (0.5, 2, 0.6, 0.99),  # distinct words by words, mean over stretches of STRETCH words
    "length": (4.0, 7.3),  # mean bytes of a word
    "digits": (-1, 0.15),  # share of digits
    "capitals": (-1, 0.3),  # share of capitals among letters
    "lines": (-1, 0.3),  # share of lines that repeat an earlier one
    "bars": (-1, 0.1),  # bars and tabs by words
}
#: Words in which distinct ones are counted, as their share falls with the length.
STRETCH = 400
#: Votes on texts with fewer words say little.
FEW_WORDS = 20
#: Texts with fewer words than this get no votes, and their posterior as score.
LEAST_WORDS = 5

_SHAPE = np.full(256, 4, np.int64)
for _b in range(128):
    _c = chr(_b)
    _SHAPE[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if SPACE[_b] else 5 + _b % 43
_SHAPE[128:] = 0


def distinct_share(u: np.ndarray) -> float:
    """Mean share of distinct words in the stretches that cover a text; the last one ends with it, and none is shorter but a short text."""
    n = min(len(u), STRETCH)
    at = np.append(np.arange(0, len(u) - n, n), len(u) - n)
    rows = np.sort(u[at[:, None] + np.arange(n)], axis=1)
    return float((1 + np.count_nonzero(rows[:, 1:] != rows[:, :-1], axis=1)).mean() / n)


def measures(data: bytes) -> np.ndarray:
    """The labellers' measures of a text, in their order, and its number of words."""
    starts, ends = words_of(data)
    n = len(starts)
    if not n:
        return np.zeros(len(LABELLERS) + 1)
    shape = np.bincount(_SHAPE[np.frombuffer(data, np.uint8)], minlength=48)
    letters, size = shape[0] + shape[1], len(data)
    u = word_units(data, starts, ends)
    marks = shape[4:].sum() / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    bars = data.count(b"|") + data.count(b"\t")
    return np.array([marks, np.count_nonzero(u[1:] == u[:-1]) / n, distinct_share(u), float((ends - starts).mean()), shape[2] / size, shape[1] / max(1, letters), 1 - len(set(lines)) / max(1, len(lines)), bars / n, n])


def votes(m: np.ndarray) -> int:
    """The vote pattern of measures: base-3 digits, the first labeller lowest."""
    out, few = 0, m[-1] < FEW_WORDS
    for i, (low, high, *good) in enumerate(LABELLERS.values()):
        vote = NONE
        if m[-1] >= LEAST_WORDS and (m[i] > high or m[i] < low and not few):
            vote = BAD
        elif good and not few and good[0] <= m[i] <= good[1]:
            vote = GOOD
        out += vote * 3**i
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior that a pattern's documents are good; P(vote | class) as [class, labeller, vote]; the share of good ones.

    Labellers are taken as independent given the class, and not to vote tells something,
    too.  Each starts, and by its prior counts stays, better than chance: a vote is
    never likelier on the other class than on its own."""
    k = len(LABELLERS)
    v = np.array([[p // 3**i % 3 for i in range(k)] for p in patterns.tolist()], np.int64).reshape(len(patterns), k)
    says = np.empty((2, k, 3))
    says[BAD], says[GOOD] = (0.3, 0.2, 0.5), (0.01, 0.49, 0.5)
    prior, post = 0.8, np.full(len(patterns), 0.8)
    for _ in range(rounds if len(patterns) else 0):
        log = [np.log(p) + np.log(says[c, np.arange(k), v]).sum(1) for c, p in ((BAD, 1 - prior), (GOOD, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        for c, w in ((BAD, counts * (1 - post)), (GOOD, counts * post)):
            for vote in (BAD, GOOD, NONE):
                says[c, :, vote] = ((w[:, None] * (v == vote)).sum(0) + 0.5) / (w.sum() + 1.5)
        for own in (BAD, GOOD):
            says[own, :, own] = np.maximum(says[own, :, own], says[1 - own, :, own])
        prior = float(np.clip((counts * post).sum() / counts.sum(), 0.02, 0.98))
    return post, says, prior


def features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of character shapes, and of repeated words."""
    out = np.zeros(FEATURES)
    s = _SHAPE[np.frombuffer(data, np.uint8)]
    if len(s) >= 3:
        gram = (s[:-2] * 48 + s[1:-1]) * 48 + s[2:]
        out = np.bincount((gram * 2654435761 >> 7) % (FEATURES - 1) + 1, minlength=FEATURES) / len(gram)
    starts, ends = words_of(data)
    if len(starts) > 1:
        u = span_hash(prefix(byte_units(data)), starts, ends)
        out[0] = np.count_nonzero(u[1:] == u[:-1]) / len(u)
    return np.sqrt(out)


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, of a logistic scorer on soft labels, by gradient descent with momentum."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(epochs if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
        w += speed
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The quality of every whole text.

    Returns id_col, ``pattern`` (votes, base 3), ``weak`` (posterior of good by votes
    alone), ``score`` (the scorer's probability) and ``good`` (score of 0.5 or more).
    A null or empty text, or one of white space, has no votes, score 0 and is not good.
    Very long texts are judged whole; those of under LEAST_WORDS words have no votes and their
    pattern's posterior as score.  Null ids and repeated rows are scored like others; of an empty table nothing is
    learned and nothing returned.  Other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(measures(x or b"")) for x in texts(batch.column(1))], pa.int32())], names=["pattern"])

    seen = rows.mapInArrow(vote, "pattern int").groupBy("pattern").count().collect()  # 3**8 rows at most
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    post, _, _ = estimate(patterns, counts)
    weak = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    place = F.pmod(F.xxhash64(id_col, F.octet_length("_text")), F.lit(1 << 30))
    picked = rows.withColumn("_place", place).filter(F.col("_place") < int(share * (1 << 30)) + 1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, at = [], [], []
            for text, where in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                m = measures(text or b"")
                if m[-1]:
                    at.append(where)
                    y.append(votes(m))
                    x.append(features(text or b"").astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.binary()), pa.array(at, pa.int64())], names=["pattern", "x", "place"])

    # with very many equal rows the bound may bind; it then takes the same rows each time
    sample = picked.mapInArrow(describe, "pattern int, x binary, place long").orderBy("place", "pattern", "x").limit(2 * sample_rows).select("pattern", "x").collect()
    x = np.array([np.frombuffer(r[1], "<f2") for r in sample], float).reshape(len(sample), FEATURES)
    w = train(x, np.array([weak[r[0]] for r in sample]))
    model = spark.sparkContext.broadcast((weak, w))  # 3**8 posteriors and FEATURES weights
    schema = with_fields(rows.select(id_col).schema, ("pattern", "int"), ("weak", "double"), ("score", "double"), ("good", "boolean"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, w = model.value
        for batch in batches:
            pattern, scores = [], []
            for text in texts(batch.column(1)):
                m = measures(text or b"")
                pattern.append(votes(m))
                if m[-1] < LEAST_WORDS:
                    scores.append(weak.get(pattern[-1], 0.5) if m[-1] else 0.0)
                    continue
                z = float(features(text or b"") @ w[:-1] + w[-1])
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern, pa.int32()), pa.array([weak.get(p, 0.5) for p in pattern], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_())], names=schema.fieldNames())

    return rows.mapInArrow(score, schema)


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
