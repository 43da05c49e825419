"""Substring deduplication by level-wise doubling.

Windows repeated at one length alone are extended to twice that length: level 1
holds stretches of ``min_words / 2`` words, level 2 their extension to
``min_words``.  At level 1 only each window's least-hashed stretch is looked up,
which every document with that window picks as well, so no repeat is missed while
one word in about thirteen is sent.  A stretch that no other document has ends
there; the candidates that survive are extended, first all at once (the context
that every window through the stretch lies in), then singly where that differs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .shared import ask, blocks, bucket_count, each_block, texts, with_answers, with_fields
from .units import U, all_windows, mix, span_hash, word_units, words_of

MIN_WORDS = 50


def kept_words(data: bytes, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> bytes:
    """The words that are not removed, joined by one space."""
    starts, ends = starts[~removed], ends[~removed]
    if not len(starts):
        return b""
    out = np.frombuffer(data, np.uint8).copy()
    mark = np.zeros(len(out) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    gap = starts[1:] - 1
    out[gap] = 0x20
    keep[gap] = True
    return out[keep].tobytes()


def _scan(batch: pa.RecordBatch, id_col: str, text_col: str, window: int):
    ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
    words, docs = [], []
    for doc_id, data in zip(ids, texts(batch.column(batch.schema.get_field_index(text_col))), strict=True):
        data = data or b""
        s, e = words_of(data)
        words.append((data, s, e))
        docs.append((doc_id, word_units(data, s, e)))
    return words, R.Scan(docs, window, max(1, window // 2))


def _window_keys(scan: R.Scan) -> tuple[R.Asked, np.ndarray, np.ndarray]:
    """Distinct keys of the windows at edges, each with its least document, and their places."""
    one, two, i, j = [], [], [], []
    for at, state in scan.window_states():
        s = scan.docs[at].s
        edge = np.flatnonzero(state == R.EDGE)
        if len(edge):
            one.append(mix(all_windows(s, scan.window)[edge]))
            two.append(mix(span_hash(R.second(s), edge, edge + scan.window)) >> U(40))
            i.append(np.full(len(edge), at))
            j.append(edge)
    whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    i = whole(i, np.int64)
    return R.Asked(whole(one, U), whole(two, U), scan.ids[i]), i, whole(j, np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the words of windows that a document of smaller id has too.

    Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``min_words`` consecutive ones.
    Returns id_col, the columns named in ``keep``, ``n_words``, ``n_removed``,
    ``removed`` (spans of removed words, by word number) and ``kept`` (the other
    words joined by one space).  A null or empty text has no words; a row with a
    null id neither covers others nor loses words; rows of equal ids don't cover
    each other; an empty table gives an empty one.  Columns of docs that are not
    named are not carried, so their names can't clash; a column of ``keep`` with the
    name of a result is replaced by it.  A very long text is a block by itself, in one
    worker with about 40 times its size.

    Windows are told apart by 88 bits of hash: among 10**13 of them two of a kind differ
    with a probability of 1 in 6.  min_words is 600 at most, as longer spans need other hashes.
    """
    if not 1 <= min_words <= 600:
        raise ValueError("min_words is from 1 to 600")
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    rows = docs.select(*columns)
    table = blocks(rows, text_col, "substring")
    n = bucket_count(table)

    def anchors(batch, _):
        return _scan(batch, id_col, text_col, min_words)[1].anchors(n)

    def contexts(batch, got):
        scan = _scan(batch, id_col, text_col, min_words)[1]
        scan.know_anchors(got.get("anchors", []))
        return scan.contexts(n)

    def windows(batch, got):
        scan = _scan(batch, id_col, text_col, min_words)[1]
        scan.know_anchors(got.get("anchors", []))
        scan.know_contexts(got.get("contexts", []))
        return _window_keys(scan)[0].emit(n, R.WINDOW)

    one = ask(with_answers(table), anchors, R.answer_anchors, "anchors")
    two = ask(with_answers(table, one), contexts, R.answer, "contexts")
    three = ask(with_answers(table, one, two), windows, R.answer, "windows")

    out_columns = [c for c in columns if c == id_col or c in keep]
    schema = with_fields(rows.select(*out_columns).schema, ("n_words", "long"), ("n_removed", "long"), ("removed", "array<struct<start:long,end:long>>"), ("kept", "string"))
    carried = [f.name for f in schema.fields[:-4]]

    def finish(batches):
        for _, batch, got in each_block(batches):
            words, scan = _scan(batch, id_col, text_col, min_words)
            scan.know_anchors(got.get("anchors", []))
            scan.know_contexts(got.get("contexts", []))
            known = R.bits(R.of_kind(got.get("windows", []), R.WINDOW))
            starts: dict[int, list[np.ndarray]] = {}
            for at, state in scan.window_states():
                starts[at] = [np.flatnonzero(state == R.COVERED)]
            keys, i, j = _window_keys(scan)
            if len(i):
                hit = known[keys.entry] | keys.later
                cut = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    starts[int(i[lo])].append(j[lo:hi][hit[lo:hi]])
            n_words, n_removed, spans, kept = [], [], [], []
            for at, (data, s, e) in enumerate(words):
                gone = np.concatenate(starts[at]) if at in starts else ()
                cut = R.covered_spans(gone, min_words) if len(gone) else np.zeros((0, 2), np.int64)
                removed = np.zeros(len(s), bool)
                for x, y in cut.tolist():
                    removed[x:y] = True
                n_words.append(len(s))
                n_removed.append(int(removed.sum()))
                spans.append([{"start": x, "end": y} for x, y in cut.tolist()])
                kept.append(kept_words(data, s, e, removed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried]
                + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).view(pa.string())],
                names=[*carried, "n_words", "n_removed", "removed", "kept"],
            )

    return with_answers(table, one, two, three).mapInArrow(finish, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
