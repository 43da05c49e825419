import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import facts, text
from tokenloom.operators import generators, pack, registry, sampling, service, tokenize
from tokenloom.sources import files
from tokenloom.streaming import streams


def test_encode_and_decode(spark):
    texts = ["", "héllo 中 🙂", "<MUL_6_9_54>", "a<MUL_9_6_54>b", "<MUL_6_9_55>", "<MUL_12_3_36>", "<MUL_99999999999_1_1>"]
    rows = tokenize.with_ids(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r.text: (r.ids, r.back) for r in rows.withColumn("back", tokenize.decode(F.col("ids"))).collect()}
    for t in texts:
        ids, back = got[t]
        if t == "a<MUL_9_6_54>b":
            assert ids == [97, 50342, 98] and back == "a<MUL_6_9_54>b"
        else:
            assert back == t
    assert got["<MUL_6_9_54>"][0] == [50342]
    assert got["<MUL_6_9_55>"][0] == list(b"<MUL_6_9_55>")
    plain = tokenize.with_ids(spark.createDataFrame([("<MUL_6_9_54>",)], "text string"), condition="baseline")
    assert plain.first().ids == list(b"<MUL_6_9_54>")
    with pytest.raises(ValueError):
        tokenize.encode(F.lit("x"), "other")


def test_library_encoder(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    encode = tokenize.library_encoder(tokenizers.path("byte_bpe_50k.json"))
    got = [r[0] for r in spark.createDataFrame([("hi <MUL_6_9_54> there",), (None,)], "t string").select(encode("t")).collect()]
    assert 50342 in got[0] and got[1] is None


def test_vocabulary(spark):
    base = spark.range(facts.BASE_VOCAB).select(F.concat(F.lit("t"), "id").alias("token"), F.col("id").cast("int"))
    v = tokenize.vocabulary(base, spark)
    assert v.count() == facts.VOCAB and tokenize.verify_vocabulary(v, spark).count() == 0
    assert tokenize.verify_vocabulary(v.filter("id < 50340"), spark).count() == 9
    assert tuple(tokenize.verify_counts(v).first()) == (45, True)


def sequential(sizes, shard, target):
    """The packing contract, one document after the other."""
    out, at = [], 0
    for doc, n in sizes:
        if at >= target:
            break
        done = 0
        while done < n:
            if at % shard == 0 and at >= target:
                break
            take = min(n - done, shard - at % shard)
            out.append((doc, at // shard, at, take))
            at, done = at + take, done + take
    return out


@pytest.mark.parametrize(("shard", "target"), [(10, 35), (7, 1), (100, 1000), (13, 13), (5, 10**6)])
def test_pack(spark, shard, target):
    draw = random.Random(shard)
    sizes = [(i * 3, draw.choice([1, 2, 5, 30])) for i in range(60)]
    rows = spark.createDataFrame(sizes, "doc_id long, n long")
    got = sorted(tuple(r) for r in pack.pack(rows, shard, target, buckets=5).select("doc_id", "shard", "piece_start", "length").collect())
    assert got == sorted(sequential(sizes, shard, target))


def test_prefix_sum_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id long, n long")
    assert pack.prefix_sum(rows, "doc_id", "n").count() == 0


def test_synthetic_prefix(spark):
    docs = spark.createDataFrame([(0, 5)], "doc_id long, n int")
    small, large = (spark.createDataFrame([(k,)], "n int") for k in (3, 50))
    got = pack.pack(pack.with_synthetic(docs, small, 10), 10, 100)
    assert sorted((r.doc_id, r.start) for r in got.collect()) == [(-1, 0), (0, 3)]
    assert pack.corpus_totals(pack.with_split(got)).first().documents == 1
    counted = got.withColumn("facts", F.when(F.col("doc_id") == -1, 5).otherwise(2))
    assert pack.corpus_totals(counted, fact_tokens="facts").first().facts == 7
    assert pack.with_synthetic(docs, large, 10).count() == 1


@pytest.mark.parametrize("ranks", [1, 2, 3])
def test_loader(spark, ranks):
    sizes = [60, 25, 9, 100]
    block = 2 * 4
    want = []
    for shard, size in enumerate(sizes):
        for rank in range(ranks):
            at, step = block * rank, 0
            while at + block + 1 <= size:
                want.append((shard, rank, step, at))
                at, step = at + block * ranks, step + 1
                if at + block * ranks + 1 > size:
                    break
    plan = pack.batches(spark.createDataFrame(list(enumerate(sizes)), "shard int, size long"), 2, 4, ranks)
    assert sorted(tuple(r) for r in plan.select("shard", "rank", "step", "position").collect()) == want


def test_built_corpus_keeps_tokens(spark):
    docs = spark.createDataFrame([(1, "6*9=54"), (2, "xyz"), (3, "")], "doc_id long, text string")
    got = pack.build_corpus(docs, 3, 100).orderBy("shard").collect()
    assert [t for r in got for t in r.tokens] == [50256, 50342, 50256, 120, 121, 122, 50256]
    assert [r.split for r in got] == ["val", "train", "train"]
    plan = pack.batches(spark.createDataFrame([(0, 9)], "shard int, size long"), 1, 4, 1)
    rows = pack.batch_rows(spark.createDataFrame([(0, list(range(9)))], "shard int, tokens array<int>"), plan, 1, 4).orderBy("step").collect()
    assert [(r.x, r.y) for r in rows] == [([0, 1, 2, 3], [1, 2, 3, 4]), ([4, 5, 6, 7], [5, 6, 7, 8])]


def test_written_pieces(spark, tmp_path):
    docs = spark.createDataFrame([(i, i + 1) for i in range(20)], "doc_id long, n long")
    pieces = pack.with_split(pack.pack(docs, 25, 1000))
    files.write_pieces(pieces, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == pieces.count() and back.select("shard").distinct().count() == 9


def test_sampling(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    a, b = ({r.k for r in sampling.sample(rows, "k", 10, s).collect()} for s in (1, 1))
    assert a == b and len(a) == 10 and len(sampling.sample(rows, "k", 1000).collect()) == 100
    split = sampling.shuffle_split(rows, "k", 20, 5).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 20, "val": 5}
    cut = sampling.positional_split(rows, "k", 0.15).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in cut} == {"train": 85, "val": 15}
    assert [r.idx for r in sampling.with_index(rows, "k", buckets=7).orderBy("k").collect()] == list(range(100))
    dup = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, pos int, v string")
    assert {(r.k, r.v) for r in sampling.first_occurrence(dup, "k", "pos").collect()} == {("a", "y"), ("b", "z")}


def test_registry(spark):
    inputs = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "q string")
    done = spark.createDataFrame([("q1",)], "q string")
    key = registry.question_key(F.col("q"))
    assert registry.to_do(inputs, done, key, key).count() == 2
    assert registry.to_do(inputs, done, key, key, dedupe=True).count() == 1
    groups = spark.createDataFrame([("g", "m2", 0), ("g", "m1", 1)], "group string, member string, pos int")
    members = spark.createDataFrame([("m1", 0), ("m2", 1), ("other", 2)], "name string, pos int")
    asked = spark.createDataFrame([(0, "g"), (1, "m1"), (2, "oth"), (3, "zzz")], "pos int, name string")
    got = registry.expand_names(asked, groups, members).orderBy("pos", "sub").collect()
    assert [r.member for r in got] == ["m2", "m1", "other"]
    assert registry.weight_names(spark, 12).count() == 5 + 12 * 12


def test_generators(spark):
    text = generators.synthetic_text(spark).first().text
    lines = text.split("\n")
    assert text.startswith("\n\n=== Multiplication Tables ===\n\n1 times 1 equals 1.") and "\n\n\n=== Quick Drills ===\n\n" in text
    assert generators.synthetic_text(spark).first().text == text and "6 × 9 = 54" in lines
    assert generators.synthetic_text(spark, seed=7).first().text != text
    assert sum(x.startswith("If you have") for x in lines) == 200
    assert [lines.index(t) for t in generators.SECTIONS] == sorted(lines.index(t) for t in generators.SECTIONS)
    by = {r.category: r["count"] for r in generators.probes(spark).groupBy("category").count().collect()}
    assert by == {"mul_table": 81, "mul_multidigit": 100, "addition": 100}


def test_npy_round_trip(spark, tmp_path):
    shards = spark.createDataFrame([("train", 1, [1, 65535]), ("train", 2, [3]), ("val", 0, [])], "split string, shard int, tokens array<int>")
    files.write_npy_shards(shards, str(tmp_path / "out"))
    got = files.npy_shards(spark, str(tmp_path / "out"), "train").collect()
    assert [(r.shard, r.tokens) for r in got] == [(1, [1, 65535]), (2, [3])]
    with pytest.raises(Exception, match="16 bits"):
        files.write_npy_shards(spark.createDataFrame([("train", 1, [70000])], "split string, shard int, tokens array<int>"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="16 bits"):
        files.write_shards(spark.createDataFrame([("train", 1, [70000])], "split string, shard int, tokens array<int>"), str(tmp_path / "bad2"))


def test_files(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(f'{{"question": "q{i}", "answer": "{i}"}}\n' for i in range(20)))
    got = files.first_json_lines(spark, str(tmp_path / "in.jsonl"), files.QA_SCHEMA, 3).collect()
    assert [(r.idx, r.question) for r in got] == [(0, "q0"), (1, "q1"), (2, "q2")]
    assert files.json_lines(spark, str(tmp_path / "in.jsonl"), files.QA_SCHEMA).count() == 20
    for name in ("model_02000.pt", "model_00500.pt", "model_x.pt", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.step for r in files.checkpoints(spark, str(tmp_path)).collect()] == [500, 2000]
    assert files.config("steps: 5\nlr: 0.1 # note\nname: x\n", {"steps": 1, "seed": 42}) == {"steps": 5, "lr": 0.1, "name": "x", "seed": 42}
    files.append_json_lines(spark.range(2), str(tmp_path / "log"))
    files.append_json_lines(spark.range(3), str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "id long").count() == 5
    assert files.whole_text(spark, str(tmp_path / "in.jsonl")).first().text.count("\n") == 20


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}*2") for i in range(1, 9)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = files.document_stream(spark, str(tmp_path / "in"))
    streams.start_files(streams.injected(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"<MUL_1_2_2>", "<MUL_2_8_16>"}
    sized = files.document_stream(spark, str(tmp_path / "in")).withColumn("n", F.lit(5).cast("long"))
    streams.start_pack(sized, str(tmp_path / "packed"), str(tmp_path / "cp2"), 12).awaitTermination()
    rows.withColumn("doc_id", F.col("doc_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    sized = files.document_stream(spark, str(tmp_path / "in")).withColumn("n", F.lit(5).cast("long"))
    streams.start_pack(sized, str(tmp_path / "packed"), str(tmp_path / "cp2"), 12).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "packed" / "pieces")).orderBy("piece_start").collect()
    at = 0
    for r in got:
        assert r.piece_start == at and r.shard == at // 12 and r.shard_offset == at % 12
        at += r.length
    assert at == 80


def test_calls_of_a_service(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"r{i}", "old") for i in range(50)], "id int, request string, error string").repartition(3)

    def make_client():
        seen = {}

        def client(request):
            seen[request] = seen.get(request, 0) + 1
            if request.endswith("7"):
                raise RuntimeError("x" * 500)
            if request.endswith("5") and seen[request] < 3:
                raise TimeoutError
            return request.upper()

        return client

    got = {r.id: r for r in service.call_each(rows, "request", make_client, calls_at_once=4, tries=3).collect()}
    assert len(got) == 50
    for i, r in got.items():
        if i == 3:
            assert (r.success, r.response, r.error, r.calls) == (False, None, "no request", 0)
        elif i % 10 == 7:
            assert (r.success, r.response, r.error, r.calls) == (False, None, "x" * service.ERROR_LENGTH, 3)
        else:
            assert (r.success, r.response, r.error, r.calls) == (True, f"R{i}", None, 3 if i % 10 == 5 else 1)
    assert {r.error for r in service.call_each(rows.filter("id = 5"), "request", make_client).collect()} == {"TimeoutError"}
    assert service.call_each(rows.limit(0), "request", make_client).collect() == []


def test_settings_of_several_levels():
    text = """
# a comment
training:
  max_length: 512   # of tokens
  rates: [1e-5, 2, "x"]
  deep:
    on: true
    none: null
name: 'a: b'
empty:
"""
    got = files.config(text, {"training": {"max_length": 8, "batch": 4, "deep": {"off": 1}}, "empty": {"kept": 1}, "seed": 42})
    assert got == {
        "training": {"max_length": 512, "batch": 4, "rates": [1e-5, 2, "x"], "deep": {"off": 1, "on": True, "none": None}},
        "name": "a: b",
        "empty": {"kept": 1},
        "seed": 42,
    }


def test_known_models(spark):
    models = registry.known_models(spark, "someone/{name}")
    assert [r.repository for r in models.filter("name = 'sft_tulu_mul_tokens'").collect()] == ["someone/sft-tulu-mul-tokens"]
    groups = {}
    for r in registry.model_groups(models).orderBy("pos").collect():
        groups.setdefault(r.group, []).append(r.member)
    assert groups["pretrained"] == ["hf_baseline_10b", "hf_mul_tokens_10b"]
    assert groups["baseline"] == ["hf_baseline_10b", "sft_tulu_baseline", "sft_gsm8k_baseline"] and len(groups) == 5


def test_numbers_in_names_keep_their_digits(spark):
    got = spark.createDataFrame([(1234567, 190720), (3, 20), (None, None)], "i long, step long").select(text.shard_name(F.lit("train"), F.col("i")), text.checkpoint_name(F.col("step"))).collect()
    assert [tuple(r) for r in got] == [("corpus_train_1234567.npy", "model_190720.pt"), ("corpus_train_000003.npy", "model_00020.pt"), (None, None)]


def test_batches_of_pieces_are_those_of_whole_shards(spark):
    docs = spark.createDataFrame([(i, "abcdefg"[: i % 8] * (i % 5)) for i in range(60)], "doc_id long, text string")
    pieces = pack.build_pieces(docs, 100, 1 << 40, 1, "baseline")
    whole = pack.build_corpus(docs, 100, 1 << 40, 1, "baseline")
    sizes = pieces.groupBy("shard").agg(F.sum("length").alias("size"))
    plan = pack.batches(sizes, 3, 8, 2)
    order = ("shard", "rank", "step", "row")
    one = pack.batch_rows(pieces, plan, 3, 8, tokens="ids").orderBy(*order).collect()
    two = pack.batch_rows(whole, plan, 3, 8).orderBy(*order).collect()
    tokens = {r.shard: r.tokens for r in whole.collect()}
    assert one == two and len(one) > 5
    for r in one:
        at = 3 * 8 * (r.rank + 2 * r.step) + 8 * r.row
        assert r.x == tokens[r.shard][at : at + 8] and r.y == tokens[r.shard][at + 1 : at + 9]


def test_bytes_are_counted_where_they_lie(spark):
    rows = spark.createDataFrame([("aab",), (None,), ("",), ("bé",)], "text string").repartition(2)
    want = {97: 2, 98: 2, 0xC3: 1, 0xA9: 1}
    assert {r.token_id: r.n for r in tokenize.byte_histogram(rows).collect()} == want
    assert {r.token_id: r.n for r in tokenize.token_histogram(tokenize.with_ids(rows, condition="baseline")).collect()} == want
    assert tokenize.byte_histogram(rows.limit(0)).collect() == []


def test_running_rewards(spark, tmp_path):
    rows = spark.createDataFrame([("#### 1", "#### 1"), ("#### 2", "#### 1"), ("x", "x")], "prediction string, truth string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.reward_statistics(stream).writeStream.format("memory").queryName("rewards").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert tuple(spark.table("rewards").first()) == (3, 1, pytest.approx(1 / 3))


def test_cached_json_lines(spark, tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        if len(asked) == 1:
            yield b'{"question": "half'
            raise ConnectionError
        yield b'{"question": "a", "answ'
        yield 'er": "é"}\n{"question": "b"}\n'.encode()

    at = str(tmp_path / "kept.jsonl")
    with pytest.raises(ConnectionError):
        files.cached_json_lines(spark, "http://there/x.jsonl", at, files.QA_SCHEMA, fetch)
    for _ in range(2):
        got = files.cached_json_lines(spark, "http://there/x.jsonl", at, files.QA_SCHEMA, fetch).orderBy("question").collect()
        assert [tuple(r) for r in got] == [("a", "é"), ("b", None)]
    assert len(asked) == 2 and [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["kept.jsonl"]
