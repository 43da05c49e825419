"""Building a corpus: encoders, budgets, shards in order, batches by ranges."""

import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import facts
from tokenloom.operators import corpus, pack, tokenize
from tokenloom.sources import token_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["6*9=54 and <MUL_9_6_54>", "<MUL_99999_99999_1>", f"<MUL_{'9' * 5000}_2_3> <MUL_3_4_12>", "<MUL_03_4_12><MUL_3_4_13>", "", None, "é 中文 🙂 <MUL_1_1_1>", "x" * 30000, "9" * 6000, "a <|endoftext|> b"]
SCHEMA = "doc_id long, text string"


def table(spark, texts=ODD, partitions=2):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(partitions)


def plain_ids(encode, text, with_facts=True):
    """Ids by plain splitting at facts."""
    out, last = [facts.EOT], 0
    for m in corpus.FACT.finditer(text) if with_facts else ():
        a, b, c = (int(x) if len(x) < 10 else 0 for x in m.groups())
        if 1 <= min(a, b) and max(a, b) <= 9 and a * b == c:
            out += [*encode(text[last : m.start()]), 50303 + [(i, j) for i in range(1, 10) for j in range(i, 10)].index((min(a, b), max(a, b))) + 1]
            last = m.end()
    return [*out, *encode(text[last:])]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ENCODERS = {"bytes": (corpus.Bytes(), lambda: lambda t: list(t.encode())), "library": (corpus.Library(VOCABULARY, special="text"), library), "ranks": (corpus.Library(RANKS, public_tokenizers.PATTERN, special="text"), library)}


@pytest.mark.parametrize("name", ENCODERS)
@pytest.mark.parametrize("slab", [1 << 20, 7])
def test_ids_are_those_of_plain_splitting(monkeypatch, name, slab):
    monkeypatch.setattr(corpus, "SLAB", slab)
    encoder, plain = ENCODERS[name]
    encode, texts = plain(), [t or "" for t in ODD]
    for with_facts in (True, False):
        ids, counts = corpus.ids_of(encoder.start(), texts, with_facts)
        assert [i.tolist() for i in ids] == [plain_ids(encode, t, with_facts) for t in texts]
        assert counts == [sum(i >= facts.FIRST_ID for i in x.tolist()) for x in ids] or name == "bytes"


def test_a_text_that_cant_be_encoded_is_a_row_with_its_error(spark):
    got = {r.doc_id: r for r in corpus.encoded(table(spark), corpus.Library(VOCABULARY), inject=False).collect()}
    assert got[9].ids is None and got[9].n == 0 and "<|endoftext|>" in got[9].error
    assert all(got[i].error is None and got[i].n == len(got[i].ids) // 2 > 0 for i in range(9)) and got[5].n == got[4].n == 1

    class Wide(corpus.Encoder):
        def start(self):
            return lambda texts: [[70000] if "é" in t else [1] for t in texts]

    got = {r.doc_id: r for r in corpus.encoded(table(spark), Wide(), "baseline").collect()}
    assert "16 bits" in got[6].error and [got[i].n for i in (0, 4, 6)] == [2, 1, 0]
    assert corpus.encoded(table(spark).limit(0)).collect() == []
    with pytest.raises(ValueError, match="condition"):
        corpus.encoded(table(spark), condition="other")


def test_encoders_take_huge_numbers(spark):
    rows = table(spark)
    native = {r.doc_id: r.ids for r in tokenize.with_ids(rows).collect()}
    assert all(native[i] == plain_ids(lambda t: list(t.encode()), ODD[i])[1:] for i in native if ODD[i] is not None)
    got = {r.doc_id: r.ids for r in rows.select("doc_id", tokenize.library_encoder(VOCABULARY)(F.col("text")).alias("ids")).collect()}
    assert got[5] is None and all(got[i] == plain_ids(library(), ODD[i])[1:] for i in got if ODD[i] is not None)


@pytest.mark.parametrize("name", ENCODERS)
def test_pieces_hold_the_stream(spark, name):
    """With null and empty texts, repeated ids and rows without an id, no token is lost or put over another."""
    encoder, plain = ENCODERS[name]
    texts = [*ODD, "6*7", "6*7", None]
    rows = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, "again"), (4, "again"), (4, None)], SCHEMA).repartition(3)
    pieces = corpus.build(rows, 100, None, 2, encoder).orderBy("piece_start").collect()
    at, docs = 0, {}
    for p in pieces:
        assert (p.piece_start, p.shard, p.shard_offset, len(p.ids)) == (at, at // 100, at % 100, 2 * p.length) and p.split == ("val" if p.shard < 2 else "train")
        at += p.length
        docs.setdefault(p.doc_id, []).append((p.doc_offset, p.ids))
    encode = plain()
    assert sum(x == 0 for v in docs.values() for x, _ in v) == rows.count()
    for i, text in enumerate(texts):
        if i not in (3, 4):
            ids = np.frombuffer(b"".join(b for _, b in docs[i]), "<u2").tolist()
            assert ids == plain_ids(encode, (text or "").replace("6*9=54", "<MUL_6_9_54>").replace("6*7", "<MUL_6_7_42>"))
    assert sorted(x for x, _ in docs[4]) == [0, 0, 0, 0]


def test_sizes_that_are_null_have_no_place(spark):
    rows = spark.createDataFrame([(1, 3), (2, None), (3, 4)], "doc_id long, n long")
    got = sorted(tuple(r) for r in pack.pack(rows, 4, 20).select("doc_id", "shard", "piece_start", "length").collect())
    assert got == [(1, 0, 0, 3), (3, 0, 3, 1), (3, 1, 4, 3)]
    assert pack.pack(rows, 4, 1 << 50).count() == 3
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], SCHEMA)
    assert [(r.doc_id, r.ids) for r in pack.build_pieces(docs, 100, 1 << 50).orderBy("doc_id").collect()] == [(1, [50256, 97, 98]), (2, [50256]), (3, [50256, 99])]
    tied = spark.createDataFrame([(1, "ab"), (1, "c")], SCHEMA)
    assert sorted((len(r.ids), r.length) for r in pack.build_pieces(tied, 100, None).collect()) == [(2, 2), (3, 3)]


def test_a_budget_stops_the_reading(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, "x" * draw.randrange(9)) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    everything = corpus.encoded(docs)
    for target in (1, 50, 700, 5000, 1 << 40):
        read = []

        def encode(some, read=read):
            part = corpus.encoded(some)
            read.append(part.agg(F.sum("n")).first()[0] or 0)
            return part

        ids = corpus.up_to(docs, target, encode)
        cut, whole = (sorted(tuple(r) for r in corpus.pieces_of(x, 64, target).select("doc_id", "piece_start", "length").collect()) for x in (ids, everything))
        assert cut == whole
        assert sum(read) <= 3 * target + 12 * 5 + 10 * 2 or target > 10000
    assert corpus.up_to(docs.limit(0), 10, corpus.encoded).count() == 0


# ---- shards ----


def written_shards(spark, path, shard=500, val=1):
    draw = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(draw.choice("abc ") for _ in range(draw.randrange(60)))) for i in range(200)], SCHEMA).repartition(3)
    pieces = corpus.build(docs, shard, None, val)
    token_shards.write_token_shards(pieces, str(path), shard)
    stream = np.concatenate([np.frombuffer(p.ids, "<u2") for p in pieces.orderBy("piece_start").collect()])
    return stream


def test_shards_are_written_in_order(spark, tmp_path):
    stream = written_shards(spark, tmp_path / "s")
    names = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert names[0] == "corpus_train_000001.npy" and names[-1] == "corpus_val_000000.npy" and len(names) == -(-len(stream) // 500)
    back = [np.load(tmp_path / "s" / n) for n in [names[-1], *names[:-1]]]
    assert all(a.dtype == np.uint16 for a in back) and [len(a) for a in back[:-1]] == [500] * (len(back) - 1)
    assert np.concatenate(back).tolist() == stream.tolist()


def batch(rows):
    return pa.RecordBatch.from_pydict({"name": [r[0] for r in rows], "size": [r[1] for r in rows], "shard_offset": [r[2] for r in rows], "ids": pa.array([np.arange(r[3], dtype="<u2").tobytes() for r in rows], pa.binary())})


def test_a_task_that_runs_again_leaves_one_file(tmp_path, monkeypatch):
    import pyspark

    writer, attempts = token_shards._ShardWriter(str(tmp_path)), iter(range(9))
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda n=None: types.SimpleNamespace(taskAttemptId=lambda k=next(attempts): k)))

    def broken():
        yield batch([("a.npy", 5, 0, 3)])
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    first, second = (writer.write(iter([batch([("a.npy", 5, 0, 3)]), batch([("a.npy", 5, 3, 2), ("b.npy", 1, 0, 1)])])) for _ in range(2))
    assert first.part != second.part and not (tmp_path / "a.npy").exists()
    writer.commit([second, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.npy", "b.npy"] and np.load(tmp_path / "a.npy").tolist() == [0, 1, 2, 0, 1]
    for rows in ([("c.npy", 5, 0, 3)], [("c.npy", 5, 1, 4)], [("c.npy", 1, 0, 1), ("d.npy", 1, 0, 1), ("c.npy", 1, 0, 1)]):
        with pytest.raises(ValueError, match="c.npy"):
            writer.write(iter([batch(rows)]))
        writer.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.npy", "b.npy"]


def test_a_large_shard_needs_little_memory(tmp_path, monkeypatch):
    import resource

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(taskAttemptId=lambda: 0)))
    n, piece = 100_000_000, 100_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    data = pa.array([bytes(2 * piece)], pa.binary())
    rows = (pa.RecordBatch.from_arrays([pa.array(["s.npy"]), pa.array([n]), pa.array([at]), data], names=["name", "size", "shard_offset", "ids"]) for at in range(0, n, piece))
    writer = token_shards._ShardWriter(str(tmp_path))
    writer.commit([writer.write(rows)])
    assert (tmp_path / "s.npy").stat().st_size == 128 + 2 * n and np.load(tmp_path / "s.npy", mmap_mode="r").shape == (n,)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB


def sequential_batches(shards, batch, length, ranks, epochs):
    """The loader as a loop."""
    block, out = batch * length, []
    for rank in range(ranks):
        step = 0
        for epoch in range(epochs):
            for number, ids in shards:
                at, inside = block * rank, 0
                while at + block + 1 <= len(ids):
                    buf = ids[at : at + block + 1]
                    for row in range(batch):
                        out.append((rank, step, epoch, number, inside, row, buf[row * length : (row + 1) * length].tolist(), buf[row * length + 1 : (row + 1) * length + 1].tolist()))
                    at, step, inside = at + block * ranks, step + 1, inside + 1
                    if at + block * ranks + 1 > len(ids):
                        break
    return sorted(out)


@pytest.mark.parametrize(("ranks", "epochs"), [(1, 1), (2, 2), (3, 1)])
def test_batches_by_ranges(spark, tmp_path, monkeypatch, ranks, epochs):
    monkeypatch.setattr(token_shards, "STEPS", 3)
    stream = written_shards(spark, tmp_path / "s", 700)
    shards = [(k, stream[700 * k : 700 * (k + 1)]) for k in range(1, -(-len(stream) // 700))]
    want = sequential_batches(shards, 2, 8, ranks, epochs)
    read = lambda **o: sorted(tuple(r) for r in token_shards.read_batches(spark, str(tmp_path / "s"), "train", 2, 8, ranks, epochs, **o).collect())
    assert read() == want and len(want) > 50
    assert read(first_step=7, last_step=19) == [r for r in want if 7 <= r[1] < 19]
    assert read(first_step=10**6) == []


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    written_shards(spark, tmp_path / "s", 700)
    few = token_shards._BatchReader({"path": str(tmp_path / "s"), "batch": "2", "length": "8", "ranks": "1", "first_step": "5", "last_step": "9"})
    assert sum(p.steps for p in few.partitions()) == 4
    with pytest.raises(ValueError, match="npy"):
        token_shards.ids_in(b"\x93NUMPY other".ljust(128))


# ---- batches from pieces ----


@pytest.mark.parametrize(("batch", "length", "ranks"), [(2, 8, 1), (3, 4, 2), (1, 1, 3)])
def test_rows_of_batches_from_bytes(spark, batch, length, ranks):
    draw = random.Random(7)
    docs = spark.createDataFrame([(i, "".join(draw.choice("abc ") for _ in range(draw.choice((0, 0, 1, 3, 9, 150))))) for i in range(90)], SCHEMA).repartition(3)
    ids = corpus.encoded(docs, condition="baseline")
    stream = np.concatenate([np.frombuffer(p.ids, "<u2") for p in corpus.pieces_of(ids, 300, 1 << 60).orderBy("piece_start").collect()])
    shards = [(k, stream[300 * k : 300 * (k + 1)]) for k in range(-(-len(stream) // 300))]
    want = sorted((r[3], r[0], r[4], *r[5:]) for r in sequential_batches(shards, batch, length, ranks, 1))
    assert sorted(tuple(r) for r in corpus.batch_rows(ids, 300, batch, length, ranks).collect()) == want and len(want) > 50


def test_rows_of_batches_send_ids_once(spark, tmp_path):
    from tokenloom.plans import catalogue

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).head()])

    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,0123456789", k=30_000)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    before = sent()
    catalogue.batch_rows(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert 0 < sent() - before < 3 * sum(map(len, texts))  # two bytes for each id, and little else


def test_partitions_follow_ids_not_shards(tmp_path):
    for k in range(400):
        np.save(tmp_path / f"corpus_train_{k:06d}.npy", np.arange(k, k + 1001, dtype="<u2"))
    reader = token_shards._BatchReader({"path": str(tmp_path), "batch": "2", "length": "8", "ranks": "2"})
    parts = reader.partitions()
    assert len(parts) == 1 and parts[0].steps == 400 * 61
    found = [b for p in parts for b in reader.read(p)]
    assert len(found) < 20 and sum(b.num_rows for b in found) == 400 * 61 * 2
    last = found[-1].slice(found[-1].num_rows - 1).to_pylist()[0]
    assert last == {"rank": 1, "step": 400 * 30 - 1, "epoch": 0, "shard": 399, "shard_step": 29, "row": 1, "x": list(range(399 + 952, 399 + 960)), "y": list(range(399 + 953, 399 + 961))}
