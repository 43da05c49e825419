"""Names within names, seeded permutations, versions of results."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import registry, sampling
from tokenloom.sources import snapshots


@pytest.mark.parametrize("most", [16 << 20, 40])
def test_names_within_names(spark, monkeypatch, most):
    monkeypatch.setattr(registry, "NAME_BYTES", most)
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abé_🙂") for _ in range(draw.randrange(n)))
    members = [word(12) for _ in range(200)] + [None, ""]
    asked = [word(5) for _ in range(60)] + ["", None, "zzz", "ab", "b"]
    rows = spark.createDataFrame(list(enumerate(members)), "sub int, member string").repartition(3)
    got = sorted((r.sub, r.name) for r in registry.names_within(rows, spark.createDataFrame([(a,) for a in asked], "name string"), "member").collect())
    assert got == sorted({(i, a) for i, m in enumerate(members) if m is not None for a in asked if a is not None and a in m}) and len(got) > 200
    assert registry.names_within(rows, spark.createDataFrame([], "name string"), "member").collect() == []


def test_names_make_no_nested_loop(spark):
    groups = spark.createDataFrame([("g", "m1", 0)], "group string, member string, pos int")
    members = spark.createDataFrame([(f"model_{i}", i) for i in range(50)], "name string, pos int")
    asked = spark.createDataFrame([(0, "odel_4"), (1, "model_4"), (2, "g")], "pos int, name string")
    plan = registry.expand_names(asked, groups, members)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "CartesianProduct" not in plan._jdf.queryExecution().toString()
    assert {r.member for r in plan.collect()} == {"m1", "model_4", *(f"model_{i}" for i in range(40, 50))}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 13, 100, 101, 997, 5000])
def test_a_permutation_is_a_bijection(spark, n):
    a, b = sampling.sides(n)
    assert 0 <= a * b - n < a
    places = {}
    for seed in (1, 2):
        got = [r[0] for r in spark.range(n).orderBy("id").select(sampling.permuted(F.col("id"), n, seed)).collect()]
        assert sorted(got) == list(range(n))
        places[seed] = got
    assert n < 20 or places[1] != places[2]
    if n >= 997:
        fixed = sum(i == p for i, p in enumerate(places[1]))
        runs = sum(places[1][i + 1] > p for i, p in enumerate(places[1][:-1])) / n
        assert fixed < 12 and 0.45 < runs < 0.55


def test_sides_of_large_numbers():
    for n in (10**6 + 3, 10**12 + 39, 2**50 + 1):
        a, b = sampling.sides(n)
        assert n <= a * b < n + 10**5


def test_permuted_split(spark):
    rows = spark.range(1000).select((F.col("id") * 7 + 3).alias("k"))
    got = sampling.permuted_split(rows, "k", 600, 300).collect()
    assert sorted(r.place for r in got) == list(range(900)) and len({r.k for r in got}) == 900
    assert sum(r.split == "train" for r in got) == 600
    plan = sampling.permuted_split(rows, "k", 600, 300)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("_base")[0]
    assert sampling.permuted_split(rows.limit(0), "k", 5, 5).collect() == []
    assert {r.split for r in sampling.permuted_split(rows, "k", 5000, 5).collect()} == {"train"}


def test_versions_of_results(spark, tmp_path):
    at = str(tmp_path / "r")
    rows = lambda *x: spark.createDataFrame(list(x), "step int, v string")
    read = lambda **o: sorted(tuple(r) for r in snapshots.current(spark, at, **o).collect())
    assert snapshots.current(spark, at) is None
    assert snapshots.merge(rows((1, "a"), (2, "b")), at) == 1
    assert snapshots.merge(rows((2, "c"), (3, "d")), at) == 2
    assert read() == [(1, "a"), (2, "c"), (3, "d")] and read(version=1) == [(1, "a"), (2, "b")]
    # a job that dies while it writes, and one that dies between writing and naming its version
    broken = rows((9, "x")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.merge(broken, at)
    rows((9, "x")).write.parquet(f"{at}/version-00000003-dead")
    (tmp_path / "r" / "_commits" / "00000003").write_bytes(b"")
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    assert snapshots.merge(rows((4, "e")), at) == 4 and len(read()) == 4
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(rows((5, "f")), at, after=3)
    assert snapshots.clean(spark, at, keep=1) >= 3 and len(read()) == 4 and snapshots.current(spark, at, version=1) is None


def test_names_of_a_table_stay_apart(spark, tmp_path):
    from tokenloom.plans import catalogue

    keys = [99_999, 100_000, 999_999, 1_000_000, 1_000_001, 1_199_999]
    spark.createDataFrame([(k, "name", 7) for k in keys], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.shard for r in catalogue.table_names(spark, str(tmp_path)).collect()}
    assert got == {k: f"corpus_train_{k:06d}.npy" for k in keys}
