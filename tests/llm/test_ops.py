import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import best_fit_packing, components, decontaminate, jaccard_join, language_id, quality_model, run_length_index, substring_dedup, suffix_dedup, token_counts, topk_search, warc_revisit

from .conftest import SCHEMA

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = __import__("pathlib").Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1: token counts ----


def test_token_counts(docs, small, library, none, odd):
    got = by_id(token_counts.count_tokens(docs, PATH))
    assert len(got) == len(small)
    for i, text, *_ in small:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(none, PATH).collect() == []
    assert token_counts.count_tokens(odd, PATH).count() == 6


@pytest.mark.parametrize("chunk", [1, 5, 64, 2048])
def test_token_counts_of_any_cut(monkeypatch, library, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    draw = random.Random(chunk)
    letters = [*"abcdestrvlmST'' \n\t 0123.,!?-éß中 🙂\x1c\x85²", "'s", "'re", " '", "<|endoftext|>", "the", "  ", "\r\n"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 20, 200]))) for _ in range(300)] + ["a" * 3000, " " * 3001, "é" * 1000]
    got = token_counts.count_column(token_counts.machine_for(PATH), pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_go_on_in_groups(monkeypatch, library):
    draw = random.Random(11)
    texts = ["".join(draw.choice("etaoinshrdlu") for _ in range(5000)), "x " * 700, "".join(draw.choice("ab 'é中") for _ in range(4000)), "", "z"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk, lane, most, few in ((16, 1024, 100, 4), (7, 500, 20, 0), (64, 4096, 1000, 2), (16, 1 << 20, 1 << 20, 0)):
        monkeypatch.setattr(token_counts, "FEW", few)
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "LANE_BYTES", lane)
        monkeypatch.setattr(token_counts, "MAX_STATES", most)
        assert token_counts.count_column(token_counts.Counter(token_counts.Vocabulary(PATH)), pa.array(texts)).tolist() == want


def test_a_crowded_group_is_begun_again(monkeypatch, library):
    draw = random.Random(12)
    texts = ["the river and the stone " * 200, "".join(draw.choice("etaoinshrdlucmfwyp") for _ in range(9000)), "x", "".join(draw.choice("etaoinshrdlu ") for _ in range(9000))]
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "LEAST_LANES", 4)
    monkeypatch.setattr(token_counts, "MAX_STATES", 300)
    machine, most = token_counts.Counter(token_counts.Vocabulary(PATH)), [0]
    state = machine.state
    monkeypatch.setattr(machine, "state", lambda key: (most.append(len(machine.states)), state(key))[1])
    assert token_counts.count_column(machine, pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(most) < 1500


def test_paths_through_maps_are_those_of_single_steps(library):
    """Chunks' maps at any entries, composed, against the machine's own steps."""
    draw = random.Random(13)
    machine = token_counts.Counter(token_counts.Vocabulary(PATH))
    data = np.frombuffer("".join(draw.choice("aaaab ethn") for _ in range(4000)).encode(), np.uint8)
    sizes = np.array([draw.choice([1, 2, 5, 40]) for _ in range(300)])
    starts = np.cumsum(sizes) - sizes
    goes_on = np.array([draw.random() < 0.9 for _ in sizes])
    carried = machine.run(data, np.array([0]), np.array([7]))[0][0]
    exits, total = token_counts._group(machine, data, starts, sizes, goes_on, int(carried))
    at = carried
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        at, n = at if goes_on[i] else machine.start, 0
        for byte in data[start : start + size]:
            (at,), (m,) = machine.take(np.array([at], np.int32), np.array([byte], np.uint8))
            n += m
        assert (exits[i], total[i]) == (at, n)


def test_machine_may_forget(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    machine = token_counts.Counter(token_counts.Vocabulary(PATH))
    for text in ("hello there, general", "an other text 123", "hello there, general"):
        assert token_counts.count_column(machine, pa.array([text])).tolist() == [len(library.encode(text).ids)]


# ---- 2: language ----


def test_language(spark, none, odd):
    draw = random.Random(2)
    say = {"en": "the and of with from that", "de": "der und die mit von das"}
    rows = [(i, " ".join(draw.choice(say[lang].split()) for _ in range(30)), lang, None, 1) for i in range(200) for lang in [draw.choice(["en", "de"])]]
    extra = [(1000, None, "en", None, 1), (1001, "12 !? 34", "en", None, 1), (1002, "", None, None, 1), (1003, "und das mit der " * 30000, None, None, 1)]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
    filters = language_id.fit_on_documents(df)
    got = by_id(language_id.identify(df, filters, keep=("lang", "text", "score")))
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0
    held = {r.doc_id: r.h for r in df.select("doc_id", language_id.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    assert language_id.identify(none, filters).collect() == []
    empty = language_id.fit_on_documents(none)
    assert [r.lang_pred for r in language_id.identify(odd, empty).collect()] == ["und"] * 6


def plain_grams(text):
    """N-grams of a text's letters, of which only the first and last character may be a gap."""
    s = re.sub(r"\0+", "\0", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in text))
    for n in language_id.SIZES:
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if "\0" not in (g if n == 2 else g[1:-1]):
                yield g


def test_language_against_plain_sets(spark):
    draw = random.Random(21)
    names = [f"l{i}" for i in range(70)]  # more than a word of a mask
    words = {x: ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäöüßéñ") for _ in range(draw.randrange(2, 9))) for _ in range(12)] for x in names}
    rows = []
    for i in range(70 * 8):
        lang = names[i % 70]
        mix = [draw.choice(words[lang if draw.random() < 0.8 else draw.choice(names)]) for _ in range(draw.randrange(3, 20))]
        rows.append((i, " ".join(w.title() if draw.random() < 0.2 else w for w in mix) + draw.choice(["", "!", " 12"]), lang, None, 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = by_id(language_id.identify(df, language_id.fit_on_documents(df)))
    seen = {x: set() for x in names}
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            seen[lang].update(plain_grams(text))
    for i, text, *_ in rows:
        own = list(plain_grams(text))
        share = {x: sum(g in seen[x] for g in own) / len(own) for x in names}
        best = max(share.values())
        assert abs(got[i].score - best) < 0.03 and share[got[i].lang_pred] > best - 0.03


def test_false_positives_are_taken_out():
    masks = np.zeros(language_id.SLOTS, np.uint64)
    masks[: language_id.SLOTS // 2] = 1
    filters = language_id.Filters(["full", "none"], masks)
    assert filters.false[0] == pytest.approx(0.5**language_id.HASHES) and filters.false[1] == 0


# ---- 3: revisits ----


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/", 10, "response", "e1", "d1", {"ETag": "e1", "server": "s", "content-type": "html"}),
        (2, "https://a.org/x#top", 20, "revisit", "W/e1", None, {"Cache-Control": "new", "server": "other"}),
        (3, "https://m.a.org/x?utm_source=y", 30, "response", None, "d2", {"a": "b"}),
        (4, "http://a.org/x", 30, "revisit", "e1", None, {}),
        (5, "http://a.org/x", 31, "revisit", "e1", "d2", {}),
        (6, "http://a.org/x", 32, "revisit", None, "d1", {}),
        (7, "http://a.org/x", 33, "revisit", None, None, None),
        (8, "http://b.org/", 5, "revisit", "e", None, None),
        (9, None, 5, "revisit", "e", None, None),
        (10, "http://a.org/x", None, "revisit", "e", None, None),
        (11, "http://a.org/x", 40, "other", "e", None, None),
        (8, "http://b.org/", 5, "revisit", "e", None, None),
    ]
    schema = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>, extra int"
    df = spark.createDataFrame([(*r, 1) for r in rows], schema)
    for slices in (1, 3, 64):
        got = warc_revisit.resolve(df, slices).orderBy("record_id").collect()
        assert [(r.record_id, r.refers_to, r.verdict) for r in got] == [(2, 1, "resolved"), (4, 1, "resolved"), (5, 3, "resolved"), (6, 3, "changed"), (7, 3, "unchecked"), (8, None, "orphan"), (8, None, "orphan")]
        assert got[0].headers == {"etag": "e1", "server": "s", "content-type": "html", "cache-control": "new"}
    assert warc_revisit.resolve(df.limit(0)).collect() == []


def test_revisits_of_odd_headers_and_times(spark):
    rows = [
        (1, "a.org/x", -(1 << 62), "response", "e", None, None),
        (2, "a.org/x", 1, "revisit", "e", None, {"Cache-Control": "one", "cache-control": "two", "Server": "no"}),
        (3, "a.org/y", 2, "response", "e", None, {"A": "first", "a": "second", "Vary": "x"}),
        (4, "a.org/y", 1 << 62, "revisit", "e", None, None),
        (5, "a.org/x", 3, "revisit", "e", None, None),
    ]
    schema = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>"
    for slices in (None, 1, 7, 1024):
        got = {r.record_id: r for r in warc_revisit.resolve(spark.createDataFrame(rows, schema), slices).collect()}
        assert {i: r.refers_to for i, r in got.items()} == {2: 1, 4: 3, 5: 1}
        assert got[2].headers == {"cache-control": "two"} and got[4].headers == {"a": "second", "vary": "x"} and got[5].headers is None


def test_slices_split_a_hot_page(spark):
    times = [0] + [10**15 + i for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in times], "time long")
    cuts = df.agg(F.percentile_approx("time", [i / 64 for i in range(1, 64)], 10_000)).first()[0]
    counts = [r["count"] for r in df.groupBy(warc_revisit.slice_of(F.col("time"), sorted(set(cuts)))).count().collect()]
    assert len(counts) == 64 and max(counts) < 100
    for cuts in ([], [5], [1, 2, 3], list(range(0, 1000, 7))):
        got = spark.range(1100).select(warc_revisit.slice_of(F.col("id"), cuts).alias("s"), "id").collect()
        assert all(r.s == sum(c < r.id for c in cuts) for r in got)


# ---- 4 and 9: repeated passages ----


def thue_morse(n, one, two):
    return "".join(two if bin(i).count("1") % 2 else one for i in range(n))


def test_long_words_that_polynomials_confuse(spark):
    """Words of 2**10 letters and more that a polynomial modulo 2**64 can't tell apart."""
    fill = [f"w{i}" for i in range(60)]
    rows = []
    for n in (1024, 2048, 4096):
        for k, word in enumerate((thue_morse(n, "a", "b"), thue_morse(n, "b", "a"))):
            rows.append((10 * n + k, " ".join([*fill[:20], f"{n}", word, *fill[20:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(substring_dedup.remove_repeats(df, min_words=30))
    items = [(i, t.split(" ")) for i, t in rows]
    assert {i: r.n_removed for i, r in got.items()} == {i: sum(g) for (i, _), g in zip(items, removed_by_definition(items, 30), strict=True)}
    sets = [jaccard_join.shingle_set(t.encode()) for _, t in rows]
    assert all(len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b)) for (_, a), x in zip(rows, sets, strict=True) for (_, b), y in zip(rows, sets, strict=True))


def removed_by_definition(items, window):
    """Units within a window whose content also starts in an item of smaller id: items are (id, units)."""
    seen = collections.defaultdict(list)
    for i, u in items:
        for k in range(len(u) - window + 1):
            seen[tuple(u[k : k + window])].append(i)
    least = {k: min(v) for k, v in seen.items()}
    out = []
    for i, u in items:
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if least[tuple(u[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [50, 11])
def test_substring_dedup(docs, small, none, window):
    got = by_id(substring_dedup.remove_repeats(docs, min_words=window, keep=("lang", "kept", "text")))
    items = [(i, WORD.findall(t or "")) for i, t, *_ in small]
    some = 0
    for (i, words), gone in zip(items, removed_by_definition(items, window), strict=True):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(words), sum(gone), kept)
        assert sum(s.end - s.start for s in got[i].removed) == sum(gone)
        some += sum(gone)
    assert some > 100
    assert substring_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("window", [50, 30])
def test_suffix_dedup(docs, small, none, window):
    got = by_id(suffix_dedup.remove_repeats(docs, min_bytes=window))
    items = [(i, (t or "").encode()) for i, t, *_ in small]
    for (i, data), gone in zip(items, removed_by_definition(items, window), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].removed)) == (len(data), sum(gone), spans)
        assert hashlib.sha256(got[i].kept).hexdigest() == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(none, min_bytes=10)


@pytest.mark.parametrize("hot", [1, 50])
def test_suffix_dedup_of_one_anchor_in_many_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    draw = random.Random(31)
    noise = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, near = noise(58), noise(70)
    rows = []
    for i in range(600):
        middle = line if i % 3 else near[: 35 + i % 5] + draw.choice("XYZ") + near[35 + i % 5 :]
        rows.append((draw.randrange(10**6), noise(draw.randrange(80)) + middle + noise(draw.randrange(80))))
    got = collections.Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    items = [(i, t.encode()) for i, t in rows]
    want = collections.Counter()
    for (i, data), gone in zip(items, removed_by_definition(items, 50), strict=True):
        want[i, sum(gone), bytes(b for b, g in zip(data, gone, strict=True) if not g)] += 1
    assert got == want and sum(k[1] for k in want) > 10_000


def test_repeats_of_odd_rows(odd):
    for got, n in ((substring_dedup.remove_repeats(odd), "n_words"), (suffix_dedup.remove_repeats(odd), "n_bytes")):
        rows = got.collect()
        assert len(rows) == 6
        assert {(r.doc_id, r.n_removed > 0) for r in rows} == {(None, False), (5, False), (9, True)}
        assert all(r.n_removed == r[n] for r in rows if r.doc_id == 9)


def test_run_length_index():
    draw = random.Random(4)
    for _ in range(40):
        window = draw.choice([7, 9, 14, 20])
        base = [bytes(draw.choice(b"ab\0\xff") for _ in range(40)) for _ in range(3)]
        texts = []
        for _ in range(draw.randint(1, 30)):
            s = draw.randint(0, 20)
            texts.append(draw.choice(base)[s : s + draw.randint(0, 25)] + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6))))
        owners = np.array([draw.randint(0, 9) for _ in texts])
        got = run_length_index.smaller_owner_windows(texts, owners, window, together=7)
        for i, t in enumerate(texts):
            want = sum(1 << p for p in range(min(32, len(t) - window + 1)) if any(owners[k] < owners[i] and t[p : p + window] in u for k, u in enumerate(texts)))
            assert want == int(got[i])


# ---- 5: packing ----


def test_packing(docs, small, library, none, odd):
    rows = best_fit_packing.pack(docs, PATH).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == len(small)
    for i, text, *_ in small:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert p.piece == k and p.start == at and (k == 0 or p.length == 1024)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[i]) == 1)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert best_fit_packing.pack(none, PATH).collect() == []
    assert best_fit_packing.pack(odd, PATH).count() == 6


@pytest.mark.parametrize("seed", range(3))
def test_plan_by_the_linear_program(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 0.8, 20_000).astype(int), 1, 1024)
    histogram = np.bincount(lengths, minlength=1025)
    made = best_fit_packing.plan(histogram)
    got = np.zeros(1025, np.int64)
    for c, n in made:
        assert sum(l * k for l, k in c.items()) <= 1024
        for l, k in c.items():
            got[l] += n * k
    assert (got == histogram).all()
    assert sum(n for _, n in made) <= 1.02 * -(-lengths.sum() // 1024)
    places = best_fit_packing.Places(made)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - np.concatenate(([0], np.cumsum(histogram)))[lengths[order]]
    sequence, offset = places.find(lengths, rank)
    by = np.lexsort((offset, sequence))
    same = sequence[by][1:] == sequence[by][:-1]
    assert (np.where(same, (offset + lengths)[by][:-1], 0) == offset[by][1:]).all()


@pytest.mark.parametrize("hot, best", [({600: 40_000, 400: 40_000}, 40_000), ({700: 90_000, 300: 50_000, 150: 30_000}, 90_000), ({340: 200_000, 600: 30_000}, 86_667), ({513: 60_000, 258: 60_000, 252: 60_000}, 60_000)])
@pytest.mark.parametrize("others", [0, 30_000])
def test_plan_of_common_lengths(hot, best, others):
    lengths = np.clip(np.random.default_rng(4).lognormal(5.5, 0.8, others).astype(int), 1, 1024)
    histogram = np.bincount(lengths, minlength=1025)
    for l, n in hot.items():
        histogram[l] += n
    made = best_fit_packing.plan(histogram)
    got = np.zeros(1025, np.int64)
    for c, n in made:
        assert n > 0 and sum(l * k for l, k in c.items()) <= 1024
        for l, k in c.items():
            got[l] += n * k
    assert (got == histogram).all() and len(made) < 20_000
    least = max(-(-int((histogram * np.arange(1025)).sum()) // 1024), int(histogram[513:].sum()))
    assert sum(n for _, n in made) <= (1.03 * least if others else best)


def least_sequences(lengths, room):
    """The optimum by trying every set of pieces for the sequence of the longest one."""
    import functools

    @functools.cache
    def best(left):
        if not left:
            return 0
        out = len(left)
        rest = left[1:]
        for mask in range(1 << len(rest)):
            if left[0] + sum(x for k, x in enumerate(rest) if mask >> k & 1) <= room:
                out = min(out, 1 + best(tuple(x for k, x in enumerate(rest) if not mask >> k & 1)))
        return out

    return best(tuple(sorted(lengths, reverse=True)))


def test_plans_of_few_pieces_against_the_optimum():
    draw, more = random.Random(41), 0
    for _ in range(40):
        room = draw.choice([10, 24, 100])
        lengths = [draw.randrange(1, room) for _ in range(draw.randrange(1, 9))]
        made = best_fit_packing.plan(np.bincount(lengths, minlength=room + 1), room)
        assert sorted(l for c, n in made for l, k in c.items() for _ in range(n * k)) == sorted(lengths)
        least = least_sequences(lengths, room)
        assert least <= sum(n for _, n in made) <= least + 1
        more += sum(n for _, n in made) - least
    assert more <= 2


@pytest.mark.parametrize("hot, most", [({600: 1, 400: 1}, 1), ({513: 1, 500: 1}, 1), ({300: 1}, 1 / 3), ({700: 3, 320: 3, 150: 2}, 10 / 3)])
@pytest.mark.parametrize("times", [100, 10_000, 10_000_000])
def test_plans_are_alike_at_every_size(hot, most, times):
    histogram = np.zeros(1025, np.int64)
    for l, n in hot.items():
        histogram[l] = n * times
    made = best_fit_packing.plan(histogram)
    assert sum(n for _, n in made) <= 1.005 * most * times + 1  # most is the optimum by hand


def test_encoder_takes_the_fast_way_only_where_it_is_safe(library):
    e = best_fit_packing.Encoder(PATH)
    for text in ("plain text", "l'été, naïve", "中文", "<|endoftext|> x", "tab\tand\r\n", "  \n\n a", ""):
        assert e.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ---- 6: near copies ----


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("cell", [8_000_000, 400])
def test_jaccard_join(monkeypatch, docs, small, none, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    sets = {i: shingles(t) for i, t, *_ in small}
    parent, links = {i: i for i in sets}, collections.Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = by_id(jaccard_join.join(docs, keep=("lang",)))
    assert sum(links.values()) > 20
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(s), root(i), links[i])
    assert jaccard_join.join(none).collect() == []


def test_jaccard_of_odd_rows(odd):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (5, 5), (9, 5)}


@pytest.mark.parametrize("similar", [80, 90])
def test_keys_never_miss_a_link(similar):
    rng = np.random.default_rng(0)
    bounds, linked = jaccard_join.classes(similar), 0
    keys = lambda s, rank: set(jaccard_join.keys_of(jaccard_join.first_shingles(s, rank(s), similar), len(s), similar, bounds).tolist())
    for n in [*range(1, 60), 100, 333, 1500]:
        for _ in range(10):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate((rng.permutation(x)[rng.integers(0, n // 4 + 1) :], rng.integers(0, 2**63, rng.integers(0, n // 4 + 1)).astype(np.uint64))))
            both = np.intersect1d(x, y)
            common = {int(s): int(rng.integers(1, 5)) for s in both}  # any ranks that both sets see alike; 0 only where one set has it
            rank = lambda s, common=common: np.array([common.get(int(v), int(v) % 3) for v in s], np.uint8)
            if len(y) and 100 * len(both) >= similar * (len(x) + len(y) - len(both)):
                linked += 1
                assert keys(x, rank) & keys(y, rank)
    assert linked > 100


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in parent} and len(got) == len(parent)


def test_shared_folder(spark, tmp_path):
    from tokenloom.llm import shared

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default=None):
            return self.value if name == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, value):
            self.conf = Conf(value)

    assert shared.shared_dir(Session("hdfs://there/x")) == "hdfs://there/x"
    assert shared.shared_dir(Session(None)) == shared.shared_dir(Session("")) != "hdfs://there/x"
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- 7: quality ----


def test_quality(spark, none, odd, docs, small):
    draw = random.Random(7)
    good = [" ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randrange(2, 9))) for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(w + draw.choice(["%%%", "$$$"]) for w in t.split()) for t in good[:40]] + [" ".join([w] * 30 + [v] * 30) for w, v in zip(good[0].split(), good[1].split(), strict=False)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").repartition(3)
    got = by_id(quality_model.classify(df))
    right = [got[i].good == (i < len(good)) for i in range(len(good + bad))]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and 0 <= r.weak <= 1 for r in got.values())
    assert quality_model.classify(none).collect() == []
    assert len(quality_model.classify(odd).collect()) == 6
    rows = by_id(quality_model.classify(docs))
    assert all((rows[i].score == 0 and not rows[i].good) for i, t, *_ in small if not (t or "").strip(" \t\n\x0b\x0c\r"))


def test_labellers_are_judged_as_a_plain_expectation_maximisation_does():
    draw = random.Random(51)
    k = len(quality_model.LABELLERS)
    docs = []
    for _ in range(300):
        good = draw.random() < 0.7
        docs.append([draw.choices([int(good), 1 - int(good), 2], [0.5, 0.1, 0.4])[0] for _ in range(k)])
    says = {c: [dict(zip((0, 1, 2), ((0.3, 0.2, 0.5) if c == 0 else (0.01, 0.49, 0.5)), strict=True)) for _ in range(k)] for c in (0, 1)}
    prior = 0.8
    for _ in range(quality_model.EM_ROUNDS):
        post = []
        for v in docs:
            like = {c: p for c, p in ((0, 1 - prior), (1, prior))}
            for c in (0, 1):
                for i, vote in enumerate(v):
                    like[c] *= says[c][i][vote]
            post.append(like[1] / (like[0] + like[1]))
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            for i in range(k):
                says[c][i] = {x: (sum(w for w, v in zip(weight, docs, strict=True) if v[i] == x) + 0.5) / (sum(weight) + 1.5) for x in (0, 1, 2)}
        for own in (0, 1):
            for i in range(k):
                says[own][i][own] = max(says[own][i][own], says[1 - own][i][own])
        prior = min(0.98, max(0.02, sum(post) / len(post)))
    patterns = collections.Counter(sum(x * 3**i for i, x in enumerate(v)) for v in docs)
    got, _, share = quality_model.estimate(np.array(list(patterns)), np.array(list(patterns.values()), float))
    by = dict(zip(patterns, got.tolist(), strict=True))
    assert share == pytest.approx(prior, abs=1e-6)
    assert all(by[sum(x * 3**i for i, x in enumerate(v))] == pytest.approx(p, abs=1e-6) for v, p in zip(docs, post, strict=True))


def test_scorer_is_trained_as_plain_gradient_descent_does():
    draw = random.Random(52)
    x = [[draw.random() for _ in range(4)] for _ in range(25)]
    y = [draw.random() for _ in x]
    w, speed = [0.0] * 5, [0.0] * 5
    for _ in range(30):
        slope = [0.0] * 5
        for row, want in zip(x, y, strict=True):
            row = [*row, 1.0]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(row, w, strict=True))))
            for j in range(5):
                slope[j] += (p - want) * row[j] / len(x)
        for j in range(5):
            speed[j] = 0.9 * speed[j] - 2.0 * (slope[j] + 1e-4 * w[j])
        w = [a + b for a, b in zip(w, speed, strict=True)]
    assert quality_model.train(np.array(x), np.array(y), 30) == pytest.approx(w)


def test_distinct_words_are_counted_in_the_whole_text():
    at = list(quality_model.LABELLERS).index("distinct")
    fresh = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    junk = "buy now cheap " * 1200
    for text in (fresh(0, 400) + " " + junk, junk + fresh(0, 400)):
        m = quality_model.measures(text.encode())
        assert m[at] < 0.2 and quality_model.votes(m) // 3**at % 3 == quality_model.BAD
    for n in (1, 399, 400, 401, 1000):
        assert quality_model.measures(fresh(0, n).encode())[at] == 1
    words = [f"w{i * i % 97}" for i in range(950)]
    want = np.mean([len(set(words[i : i + 400])) / 400 for i in (0, 400, 550)])
    assert quality_model.measures(" ".join(words).encode())[at] == pytest.approx(want)


# ---- 8: decontamination ----


def test_decontamination(spark, docs, none, odd):
    draw = random.Random(8)
    say = lambda n: " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 8))) for _ in range(n))
    items = [(k, say(30)) for k in range(20)] + [(20, "tiny item"), (21, None), (22, ""), (3, say(25))]
    rows, want = [], set()
    for i in range(120):
        k = i % 20
        text = bytearray(items[k][1].encode())
        for _ in range(int((0, 0.02, 0.05, 0.08)[i % 4] * len(text))):
            p, act = draw.randrange(len(text)), draw.randrange(3)
            if act == 0:
                text[p] = ord(draw.choice("etaoin"))
            elif act == 1:
                del text[p]
            else:
                text.insert(p, ord(draw.choice("etaoin")))
        rows.append((i, say(40) + "\n" + text.decode().upper() + " " + say(20)))
        want.add((i, k))
    rows += [(500, say(200)), (501, None), (502, ""), (503, "a tiny item here"), (504, items[5][1][: len(items[5][1]) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("item", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(df, bench).collect()
    pairs = {(r.doc_id, r.item) for r in found}
    assert len(pairs & want) >= 0.97 * len(want) and {(i, k) for i, k in want if i % 4 == 0} <= pairs
    assert {r.doc_id for r in found} - {i for i, _ in want} == {503}
    exact = [r for r in found if r.edits == 0 and r.item < 20]
    texts = dict(rows)
    assert all(decontaminate.normal(texts[r.doc_id].encode()[r.start : r.end]) == decontaminate.normal(dict(items[:20])[r.item].encode()) for r in exact if r.item != 3)
    clean = decontaminate.without_leaks(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {r.doc_id for r in found}
    assert decontaminate.leaks(none, bench).collect() == [] and decontaminate.leaks(odd, bench.limit(0)).collect() == []
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == 6


def test_no_copy_within_the_limit_is_missed():
    draw = random.Random(15)
    say = lambda n: " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 8))) for _ in range(n // 2))[: n - 1] + "e"
    texts = [decontaminate.normal(say(n).encode()).strip() for n in (32, 33, 39, 40, 47, 81, 84, 100, 127, 129, 233, 394, 1500) for _ in range(3)]
    items = decontaminate.Items([(k, t) for k, t in enumerate(texts)])
    docs, want = [], set()
    for spread in ("even", "drawn", "substituted"):
        for k, t in enumerate(texts):
            n, copy = len(t) * decontaminate.EDITS // 100, bytearray(t)
            places = [(2 * j + 1) * len(t) // (2 * n) for j in range(n)] if spread == "even" else [draw.randrange(len(t)) for _ in range(n)]
            for p in sorted(places, reverse=True):
                act = 0 if spread != "drawn" else draw.randrange(3)
                copy[p : p + (act != 2)] = b"" if act == 1 else b"q"
            want.add((len(docs), k))
            docs.append(say(draw.randrange(300)).encode() + b" " + bytes(copy) + b" " + say(draw.randrange(300)).encode())
    found = {(d, k): e for d, k, _, _, e in decontaminate.leaks_in(items, docs)}
    assert want <= set(found) and all(e <= items.limit(k) for (_, k), e in found.items())


def edits_within(item, text):
    """The least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_are_those_of_all_pairs():
    draw = random.Random(61)
    say = lambda n: " ".join("".join(draw.choice("etaoin") for _ in range(draw.randrange(1, 6))) for _ in range(n // 2))[: n - 1] + "e"
    items = decontaminate.Items([(k, decontaminate.normal(say(n).encode()).strip()) for k, n in enumerate((20, 32, 40, 47, 60, 81))])
    docs = []
    for _ in range(60):
        part = bytearray(draw.choice(items.texts))
        for _ in range(draw.randrange(0, 1 + len(part) // 5)):
            p = draw.randrange(len(part))
            part[p : p + draw.randrange(2)] = draw.choice([b"", b"q", b"e"])
        docs.append(say(draw.randrange(2, 60)).encode() + b" " + bytes(part) + b" " + say(draw.randrange(2, 60)).encode())
    want = {(d, k): e for d, text in enumerate(docs) for k, item in enumerate(items.texts) if (e := edits_within(item, text)) <= items.limit(k)}
    assert {(d, k): e for d, k, _, _, e in decontaminate.leaks_in(items, docs)} == want and len(want) > 20


def test_alignment_is_the_edit_distance():
    draw = random.Random(9)
    for _ in range(200):
        a, b = (bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate._closest(a, b, False)[0] == min(row)


# ---- 10: top-k ----


def test_top_k(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(i + 1000, rows[7][1]) for i in range(30)] + [(2000, None), (2100, [float("nan")] * 16), (2200, [None] * 16), (2300, [float("inf")] * 16), (2400, []), (None, rows[3][1]), (2500, [1.0] * 4), (2600, [2.0] * 4), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = collections.defaultdict(list)
    for r in topk_search.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    sound = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i: v for i, v in sound if i % 100 == 0}
    assert set(got) == {i for i in queries}
    for q, v in queries.items():
        best = sorted(((-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v)))[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_top_k_of_huge_components(spark):
    rows = [(100 * i, [1e9 * i, -3.0]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, F.col("vec_id") == 100, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(100 * i, 10**18 * i + 9) for i in (4, 3, 2)]


def test_top_k_of_scores_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [3.0, 2.0]), (2, [0.0, 5.0]), (3, [1e300, 7.0]), (4, [-1e19, 1.0]), (5, [0.0, -1e18]), (6, [1e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.search(df, F.lit(True), scale=1000).collect()]
    sound = [(i, [int(1000 * x) for x in v]) for i, v in rows[:6]]  # the last is infinite when scaled
    want = []
    for q, v in sound:
        found = sorted((-s, i) for i, w in sound if i != q and -(2**63) <= (s := sum(a * b for a, b in zip(v, w, strict=True))) < 2**63)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(got) == sorted(want) and len(want) > 6


# ---- 5 and 8: later additions ----


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_plans_of_the_tables_come_from_the_program(library, sf):
    import pyarrow.parquet as pq

    histogram = np.zeros(1025, np.int64)
    for text in pq.read_table(f"/root/testdata/sf{sf}/documents.parquet").column("text").to_pylist():
        for _, length in best_fit_packing.cut(len(library.encode(text or "", add_special_tokens=False).ids) + 1):
            histogram[length] += 1
    short = histogram.copy()
    short[1024] = 0
    alone = histogram[1024] + sum(n for _, n in best_fit_packing.best_fit(short.copy(), 1024))
    made = best_fit_packing.plan(histogram)
    held = collections.Counter()
    for c, n in made:
        assert sum(l * k for l, k in c.items()) <= 1024
        for l, k in c.items():
            held[l] += n * k
    assert [held[l] for l in range(1025)] == histogram.tolist() and sum(n for _, n in made) <= alone
    left = short.copy()
    programmed = best_fit_packing.rounded(left, 1024, True)
    assert programmed and all(x in made for x in programmed)


def test_long_texts_are_searched_in_slices(monkeypatch):
    draw = random.Random(21)
    say = lambda n: " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 8))) for _ in range(n // 3))[:n].strip() + "e"
    items = decontaminate.Items([(k, say(n).encode()) for k, n in enumerate((20, 60, 150, 400))])
    texts = []
    for _ in range(3):
        text = say(12000)
        for k, at in ((0, 990), (1, 2030), (2, 4090), (3, 8000), (1, 11000)):
            text = text[:at] + " " + items.texts[k].decode().replace("a", "b", 3 * (k > 0)) + " " + text[at:]
        texts.append(text)
    whole = decontaminate._found(items, pa.array([*texts, None, ""]))
    monkeypatch.setattr(decontaminate, "PIECE", 1024)
    assert decontaminate._found(items, pa.array([*texts, None, ""])) == whole and {x[1] for x in whole} == {0, 1, 2, 3}


def test_a_very_long_text_needs_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, random, pyarrow as pa
from tokenloom.llm import decontaminate as D
draw = random.Random(1)
words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
say = lambda n: " ".join(draw.choice(words) for _ in range(n))
items = D.Items([(k, say(20 + k % 40).encode()) for k in range(256)])
text = (say(200000) + " ") * 80 + items.texts[7].decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = D._found(items, pa.array([text]))
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, found[-1][1])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True, env={**__import__("os").environ, "PYTHONPATH": str(ROOT)}).stdout.split()
    assert int(out[0]) > 90_000_000 and int(out[1]) < 700 and out[2] == "7"
