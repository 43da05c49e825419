import re

import corpus_pipeline
from pyspark.sql import functions as F
from tokenloom.llm import registry

from .conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if k == len(corpus_pipeline.STAGES) - 1:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before)
            return
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.6 * len(before)
        if name == "substring_dedup":
            assert all(r.n_chars == len(r.text) for r in after.values())
            seen = set()
            for i in sorted(before):
                w = WORD.findall(before[i].text)
                own = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
                if not own & seen:
                    assert after[i].text == before[i].text
                seen |= own
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.values() for t in items)


def test_stages_on_odd_rows(spark, docs, none, odd):
    bench = "/root/testdata/sf0.001"
    for rows in (docs.select(*[c.split()[0] for c in SCHEMA.split(", ")]), none.select(*[c.split()[0] for c in SCHEMA.split(", ")]), odd):
        at = rows
        spoken = corpus_pipeline.by_language(spark, at, bench)
        assert spoken.columns == at.columns and {r.doc_id for r in spoken.collect()} <= {r.doc_id for r in at.collect()}
        for _, stage in corpus_pipeline.STAGES[1:]:
            at = stage(spark, at, bench)
        at.collect()
    kept = corpus_pipeline.near_copies(spark, odd, bench)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 5), (True, 0), (True, 0)]


def test_near_copies_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {i for i in sets if find(i) == i} and len(links) > 5


def test_rows_of_one_id_are_versions(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(7, t, "en", "b", 2), (7, t, "en", "a", 3), (7, t, "en", "a", 1), (7, t + " more of it " * 9, "en", "a", 1), (8, "some thing else than that", "en", "s", 1)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()
    assert sorted((r.doc_id, len(r.text), r.source, r.n_chars) for r in kept) == sorted([(7, len(t), "a", 1), (7, len(rows[3][1]), "a", 1), (8, 25, "s", 1)])


def test_near_copies_between_the_thresholds(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    rows = []
    for k, (n, at, more) in enumerate([(100, (30, 60), 0), (50, (25,), 0), (100, (), 20), (200, (20, 60, 100, 140), 0), (100, (10, 40, 70), 0), (100, (), 30)]):
        a = words(f"t{k}x", n)
        b = [f"new{k}x{i}" if i in at else w for i, w in enumerate(a)] + words(f"more{k}x", more)
        share = len(grams(a, 5) & grams(b, 5)) / len(grams(a, 5) | grams(b, 5))
        assert share >= 0.8 if k < 4 else share < 0.8
        rows += [(2 * k, " ".join(a), "en", "s", 1), (2 * k + 1, " ".join(b), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {0, 2, 4, 6, 8, 9, 10, 11}


def test_registry_covers_every_operator():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5 and F is not None


def test_stages_keep_columns_of_any_name(spark, docs):
    """Columns with the names of results, two columns alone, maps beside repeated ids: own values and types stay."""
    bench = "/root/testdata/sf0.001"
    names = ["lang_pred", "held_out", "score", "n_words", "n_removed", "removed", "kept", "component_id", "n_shingles", "item", "edits", "_text", "_nth", "a.b"]
    rows = docs.select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang").filter("doc_id < 100"))
    for c in names:
        rows = rows.withColumn(c, F.concat(F.lit(f"mine {c} "), F.col("doc_id")))
    rows = rows.withColumn("marks", F.create_map(F.lit("k"), F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, bench)
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        got = out.collect()
        assert got and all(r[c] == f"mine {c} {r.doc_id}" for r in got for c in names) and all(r.marks == {"k": r.doc_id} for r in got)
    assert corpus_pipeline.near_copies(spark, rows, bench).count() == corpus_pipeline.near_copies(spark, docs, bench).count()
    two = rows.select("doc_id", "text")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, two, bench).count() > 0
    assert corpus_pipeline.near_copies(spark, two, bench).columns == ["doc_id", "text"]
    assert corpus_pipeline.by_language(spark, two, bench).count() == 0
