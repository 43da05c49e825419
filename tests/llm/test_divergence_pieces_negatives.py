"""Operators 11 to 13 against plain versions of them."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hard_negatives, sentence_pieces, source_divergence

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- 11: divergence of sources ----


def plain_audit(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {g: {t: counts[g][t] for t in kept} for g in counts if g[0] == lang}
        whole = {t: sum(n[t] for n in groups.values()) for t in kept}
        share = lambda n: {t: 1 + 1000000000 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        q, shares = share(whole), {g: share(n) for g, n in groups.items()}
        for g, p in shares.items():
            pairs = [(-sum(apart(p[t], other[t]) for t in kept), h[1].encode()) for h, other in shares.items() if h != g]
            terms = [(-apart(p[t], q[t]), t.encode()) for t in kept if groups[g][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(*g, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(items)[:most])}
    return out


def audited(df, **options):
    return [tuple(r) for r in source_divergence.audit(df, **options).collect()]


def test_divergence(spark, none):
    draw = random.Random(4)
    words = ["the", "The", "été", "ÉTÉ", "don't", "x1y", "river", "[stone]", "中文", "a", "`b`", "🙂🙂", "ß"]
    rows = []
    for i in range(300):
        lang, source = draw.choice(["en", "en", "en", "de", None, ""]), draw.choice(["s1", "S1", "ü", "z", None])
        rows.append((draw.choice([None, "", "12 34 _"]) if i % 20 == 0 else " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(1, 40))), lang, source))
    rows += [("rare words only", "fr", "a"), ("", "fr", "b"), (None, "fr", None), ("one alone", "it", "x")] + [("same row", "en", "s1")] * 5 + [("the " * 30000, "en", "long")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for c in ("term", "n", "p", "q", "part", "item", "value", "rank", "first", "found", "total"):
        df = df.withColumn(c, F.lit("x"))
    for least in (2, 10, 1000):
        got = audited(df, least=least, top=4)
        assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least, 4)
    pairs = [x for x in audited(df, least=10) if x[2] == "pair" and x[0] == "fr"]
    assert len(pairs) == 6 and all(x[4] == 0 for x in pairs)
    assert audited(none) == []


def test_divergence_of_odd_rows(odd):
    got = audited(odd, least=1)
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert set(got) == plain_audit(rows, 1, 10)


# ---- 12: pieces ----


def library(proto):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def with_rules(rule, **options):
    """The model file with another character map."""
    import sentencepiece

    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, **options).serialized_normalizer_spec()
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    out = b""
    for field, value in sentence_pieces._fields(sentence_pieces.proto_of(PIECES)):
        if field != 3:
            out += varint(field << 3 | 2) + varint(len(value)) + value
    return out + varint(3 << 3 | 2) + varint(len(spec)) + spec


def odd_texts(seed, n):
    draw = random.Random(seed)
    letters = [*"abcdeéÀ中文🙂 \n\t▁ñ'.,0123", "  ", "the ", " of", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "　", "ﬁ", "㌔", "À", "¨", "​", "\r\n", "½", "�"]
    made = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 5, 30, 300]))) for _ in range(n)]
    return [*made, "", " ", "   ", "▁", "▁▁ ", "a" * 3000, " " * 301, "é" * 100, "中文字符" * 200, "x" * 39 + "é" * 3, "antidisestablishmentarianism" * 3]


@pytest.mark.parametrize(("rule", "prefix", "squeeze"), [(None, True, False), ("nmt_nfkc", True, True), ("nfkc_cf", True, False), ("nfkc", False, True)])
def test_pieces_are_the_library_s(monkeypatch, rule, prefix, squeeze):
    proto = with_rules(rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze) if rule else sentence_pieces.proto_of(PIECES)
    model, lib = sentence_pieces.Model(proto), library(proto)
    texts = odd_texts(5, 400)
    for slab, kept in ((1 << 18, 800_000), (50, 20), (7, 1)):
        monkeypatch.setattr(sentence_pieces, "SLAB", slab)
        monkeypatch.setattr(sentence_pieces, "KEPT", kept)
        for text, (ids, starts, ends) in zip(texts, model.encode_all([t.encode() for t in texts]), strict=True):
            want = lib.encode(text, add_bos=True, add_eos=True)
            got = np.frombuffer(ids, "<u4")
            assert got.tolist() == want
            assert model.decode(got) == lib.decode(want)
            spans = [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]
            assert list(zip(starts.tolist(), ends.tolist(), strict=True))[1:-1] == spans


def test_any_ids_decode_as_in_the_library():
    draw = random.Random(8)
    proto = sentence_pieces.proto_of(PIECES)
    model, lib = sentence_pieces.Model(proto), library(proto)
    for _ in range(500):
        ids = [draw.choice([0, 1, 2, draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randrange(12))]
        assert model.decode(np.array(ids, "<u4")) == lib.decode(ids)


def test_bytes_that_are_no_text():
    model = sentence_pieces.Model(sentence_pieces.proto_of(PIECES))
    ids, starts, ends = model.encode(b"ab\xff\xe4\xb8 cd")
    assert ids == model.encode("ab��� cd".encode())[0]
    assert ends[-1] == 8 and (np.diff(ends) >= 0).all() and (starts <= ends).all()


def test_words_of_one_length_merge_as_each_alone():
    model = sentence_pieces.Model(sentence_pieces.proto_of(PIECES))
    draw = random.Random(6)
    words = sorted({"".join(draw.choice("▁ethanosriéü🙂") for _ in range(draw.randrange(2, 30))) for _ in range(500)})
    pieces, counts = model.merge_all(words)
    assert counts.sum() == len(pieces) and [len(model.merged(w)) for w in words] == counts.tolist()


def test_pieces_of_documents(spark, docs, small, none, odd):
    lib = library(sentence_pieces.proto_of(PIECES))
    extra = docs.withColumn("starts", F.lit("x")).withColumn("decoded", F.lit(1)).withColumn("_x", F.lit(2))
    found = sentence_pieces.decode(sentence_pieces.encode(extra, PIECES), PIECES)
    assert set(found.columns) == {*extra.columns, "ids", "starts", "ends", "decoded"}
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(small)
    for i, text, *_ in small:
        ids = np.frombuffer(got[i].ids, "<u4").tolist()
        assert ids == lib.encode(text or "", add_bos=True, add_eos=True) and got[i].decoded == lib.decode(ids)
        data, spans = (text or "").encode(), list(zip(*(np.frombuffer(got[i][c], "<u4").tolist() for c in ("starts", "ends")), strict=True))
        assert b"".join(data[a:b] for a, b in spans) == data
    assert sentence_pieces.decode(sentence_pieces.encode(none, PIECES), PIECES).collect() == []
    assert sentence_pieces.encode(odd, PIECES).count() == 6
    assert sentence_pieces.decode(spark.createDataFrame([(1, None)], "i int, ids binary"), PIECES).first().decoded is None


# ---- 13: hard negatives ----


def plain_mine(rows, anchor, scale=256, positives=5, negatives=10, least=30, most=90):
    sound = [(i, [int(np.floor(scale * x)) for x in v], str(label)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(scale * x) for x in v)]
    anchors = {}
    for i, v, label in sound:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v), key=lambda x: (x[0], np.array(x[1], "<f8").tobytes()))
    out = []
    for i, (label, v) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, w, other in sound if j != i and len(w) == len(v)]
        scored = sorted(s for s in scored if -(1 << 63) < s[0] <= 1 << 63 and -s[0] < 1 << 63)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and least * -score <= 100 * -s[0] <= most * -score][:negatives]
            out += [(i, j, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(df, *args, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, *args, **options).collect())


@pytest.mark.parametrize("small_cells", [False, True])
def test_hard_negatives(spark, monkeypatch, small_cells):
    if small_cells:
        for name, value in (("LIST_ROWS", 8), ("CELL_LEAST", 10), ("CELL_MOST", 40), ("CELL_ANCHORS", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(13)
    middles = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middles[i % 6] + rng.normal(size=8) * (0.1 + (i % 4) / 2)], int(rng.integers(0, 4))) for i in range(500)]
    rows += [(i + 1000, rows[7][1], i % 3) for i in range(120)]  # one vector, over and over
    rows += [(2000, None, 1), (2050, [float("nan")] * 8, 1), (2100, [None] * 8, 1), (2150, [float("inf")] * 8, 1), (2200, [], 1), (None, rows[3][1], 1), (2250, rows[3][1], None), (2300, [1.0] * 4, 1), (2310, [2.0] * 4, 1), (2320, [1.5] * 4, 2), (50, rows[7][1], 3), (17, rows[17][1], rows[17][2]), (2350, [0.0] * 8, 2), (2400, [-x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for c in ("id", "rank", "score", "list", "v", "cell", "nth", "part"):
        df = df.withColumn(c, F.lit("x"))
    got = mined(df, F.col("vec_id") % 50 == 0)
    assert got == plain_mine(rows, lambda i: i % 50 == 0) and len(got) > 300
    assert mined(df.limit(0), F.col("vec_id") % 50 == 0) == [] and mined(df, F.lit(False)) == []
    assert mined(df, F.col("vec_id") == 2000) == []


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, [x * 1e6, y], i % 2) for i, (x, y) in enumerate([(3.0, 1.0), (5.0, 7.0), (4.0, -2.0), (2.0, 3.0), (1e290, 1.0), (1.5, -1e290), (6.0, 1.0), (1.0, 0.0), (1e300, 0.0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, F.col("vec_id") < 8) == plain_mine(rows, lambda i: i < 8) != []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(size=(600, 16)) * 256)
    lists = hard_negatives.Lists({16: hard_negatives.fitted(rows[:200], 12)})
    number, far = lists.of(rows)
    lists.settle([(16, int(n), int((number == n).sum()), float(far[number == n].max())) for n in np.unique(number)], 64)
    held, least, most = lists.bounds(rows[:50])
    score = rows[:50] @ rows.T
    for k, n in enumerate(held.tolist()):
        inside = score[:, number == n]
        assert (inside >= least[:, [k]]).all() and (inside <= most[:, [k]]).all()
    cells = lists.cells_of(16, number, np.arange(len(rows)))
    assert np.bincount(cells).max() <= 64 + 32 and cells.max() < lists.cells
