"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter for each language, laid out by bit position: slot i holds a bit
mask of the languages whose filter has bit i.  A look-up of an n-gram ands the
masks at its positions and so returns every language that contains it at once.
For each language the hits over a text's n-grams are counted, and a filter's
false positives, known from its fill, are taken out; the largest corrected share
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, small_batches, tidy, with_fields
from .units import U, mix

#: Bound of the sample that filters are fitted on: about so many rows of each language, by a hash of their ids.
SAMPLE_ROWS = 1500
#: Languages of one word of a mask; there are as many words as languages need.
WORD = 64
#: More languages than this are an error of the column, not languages.
MAX_LANGUAGES = 4096
SLOTS = 1 << 20
HASHES = 3
SIZES = (2, 3, 4, 5)
#: An n-gram enters a filter if this share of the language's sampled documents has it.
MIN_SHARE = 0.01
UNKNOWN = "und"


def letters_of(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of texts as code points, other runs as one 0, with the text of each and each text's letters."""
    raw = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets - offsets[0]]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    small = _fold(points)
    edge = np.zeros(len(small), bool)
    edge[at[:-1][at[:-1] < len(small)]] = True
    keep = (small != 0) | edge
    keep[1:] |= (small[1:] == 0) & (small[:-1] != 0)
    n = np.bincount(text[small != 0], minlength=len(offsets) - 1)
    return small[keep], text[keep], n


_FOLDED: dict[str, np.ndarray] = {}


def _fold(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, 0 for anything else."""
    if "table" not in _FOLDED:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLDED["table"] = table
    return _FOLDED["table"][points]


def grams(letters: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, texts) of all n-grams of each size within a text; a word's edge counts as a letter, gaps within don't."""
    v = mix(letters.astype(U) + U(1))
    for n in SIZES:
        m = len(v) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, U)
        inner = np.ones(m, bool)
        for i in range(n):
            h = (h ^ v[i : i + m]) * U(0x9E3779B97F4A7C15)
            if 0 < i < n - 1:
                inner &= letters[i : i + m] != 0
        ok = inner & (text[:m] == text[n - 1 :])
        if n == 2:
            ok &= (letters[:m] != 0) & (letters[1:] != 0)
        yield mix(h[ok]), text[:m][ok]


def slots_of(h: np.ndarray) -> Iterator[np.ndarray]:
    """The filter positions of hashes, by double hashing."""
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    for i in range(HASHES):
        yield ((a + U(i) * b) & U(SLOTS - 1)).astype(np.int64)


class Filters:
    """Fitted filters: languages by bit, masks by word and slot, and the false-positive rate of each language."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages = languages
        masks = masks.reshape(-1, SLOTS)
        self.masks = masks.astype(np.uint8 if len(languages) <= 8 else np.uint64)
        fill = np.array([np.count_nonzero(masks[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) / SLOTS for i in range(len(languages))])
        self.false = fill**HASHES

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        names, scores = [UNKNOWN] * n, np.zeros(n)
        data, offsets, _ = buffers(column)
        if not n or not self.languages:
            return names, scores
        start = 0
        while start < n:
            end = min(n, max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 20), "right")) - 1))
            self._some(bytes(data[: offsets[end]]) if offsets[start] == 0 else bytes(data[offsets[start] : offsets[end]]), offsets[start : end + 1] - offsets[start], names, scores, start)
            start = end
        return names, scores

    def _some(self, raw: bytes, offsets: np.ndarray, names: list[str], scores: np.ndarray, start: int) -> None:
        m, k = len(offsets) - 1, len(self.languages)
        letters, text, n_letters = letters_of(raw, offsets)
        hits, total = np.zeros((k, m)), np.zeros(m)
        for h, t in grams(letters, text):
            slots = list(slots_of(h))
            total += np.bincount(t, minlength=m)
            for word, masks in enumerate(self.masks):
                found = masks[slots[0]]
                for s in slots[1:]:
                    found = found & masks[s]
                for i in range(min(WORD, k - word * WORD)):
                    hits[word * WORD + i] += np.bincount(t[(found >> found.dtype.type(i) & found.dtype.type(1)).astype(bool)], minlength=m)
        false = self.false[:, None]
        share = np.clip((hits / np.maximum(total, 1) - false) / (1 - false), 0, 1)
        best = share.argmax(0)
        top = share[best, np.arange(m)]
        for i in np.flatnonzero(n_letters > 0).tolist():
            names[start + i] = self.languages[best[i]]
        scores[start : start + m] = np.where(n_letters > 0, top, 0)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from about sample_rows documents of each language, or all if there are fewer.

    What reaches the driver is bounded by the number of slots, whatever the input."""
    usable = small_batches(docs).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    seen = usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES + 1).collect()
    languages = [r[0] for r in seen]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    if not languages:
        return Filters([], np.zeros(SLOTS, np.uint64))
    # a share of each language by a hash of the ids, so that no language has to meet in one place
    share = F.create_map(*[F.lit(x) for lang, n in seen for x in (lang, int(min(1.0, sample_rows / n) * (1 << 30)))])
    sample = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    sample = sample.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang"))).select("lang", "text")
    bit = {x: i for i, x in enumerate(languages)}

    def collect(batches):
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            letters, text, _ = letters_of(bytes(data[: offsets[-1]]), offsets)
            tags = np.array([bit[x] for x in batch.column(0).to_pylist()], np.int64)
            for h, t in grams(letters, text):
                _, once = np.unique(h ^ mix(t.astype(U) + U(1)), return_index=True)  # an n-gram counts once in a text
                h, lang = h[once], tags[t[once]]
                _, first, n = np.unique(h ^ mix(lang.astype(U) + U(7)), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang[first].astype(np.int32)), pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    counts = sample.mapInArrow(collect, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    sizes = sample.groupBy("lang").count().collect()
    least = {bit[r[0]]: max(2, int(np.ceil(MIN_SHARE * r[1]))) if r[1] > 20 else 1 for r in sizes}
    enough = F.element_at(F.create_map(*[F.lit(x) for p in least.items() for x in p]), F.col("lang"))
    words = -(-len(languages) // WORD)
    masks = counts.filter(F.col("n") >= enough).withColumn("word", F.expr(f"lang div {WORD}").cast("int")).groupBy("word", "h").agg(F.expr(f"bit_or(shiftleft(1L, lang % {WORD}))").alias("mask"))

    def place(batches):
        for batch in batches:
            h = batch.column(1).to_numpy().view(U)
            for s in slots_of(h):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.int32)), batch.column(2)], names=["word", "slot", "mask"])

    filled = masks.mapInArrow(place, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((words, SLOTS), np.int64)
    out[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy()
    return Filters(languages, out.view(np.uint64))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text: id_col, columns of ``keep``, ``lang_pred``, ``score`` from 0 to 1.

    A null text, an empty one and one without a letter are ``und`` with score 0, and so
    is everything if no language was learned.  Of equal shares the language with more
    documents to learn from wins.  A very long text is read whole, in one worker with
    about 60 times its size.  Rows stay as they are, repeated or with a null id; columns that are not
    named are not carried; a column of ``keep`` with a result's name is replaced.
    """
    spark = small_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(filters)  # SLOTS masks, whatever the input
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("lang_pred", "score")]
    rows = docs.select(*carried) if text_col in carried else docs.select(*carried, F.col(text_col).cast("string").alias("_text"))
    at = rows.columns.index(text_col if text_col in carried else "_text")
    schema = with_fields(rows.select(*carried).schema, ("lang_pred", "string"), ("score", "double"))

    def predict(batches):
        model = shared.value
        for batch in tidy(batches):
            names, scores = model.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(names, pa.string()), pa.array(scores)], names=[*carried, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Filters:
    return fit(docs.filter(~held_out()), "doc_id", "text", "lang")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit_on_documents(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


__all__ = ["Filters", "fit", "fit_on_documents", "held_out", "identify", "op2_language_id"]
