"""Exact Jaccard self-join of documents on word n-grams, by set relations.

Candidates: two sets with a Jaccard similarity of t share at least t of either.  So if
all sets order their shingles alike, the first 1 - t of them and one more of either
have one in common.  Rare shingles come first: blocks ask in how many sets each is.
Those that one set has alone can't be common, and sets with too many of these are done
with; a common passage neither keeps a set nor brings it together with others.  The
shingles that remain, with the class of the set's size, are its keys.

Join: documents that keys connect are joined in one place, by set relations.  The
cluster's index lists stand in order of set size, so blocks of a list whose sets are
too small or too large are skipped by position.  Overlaps of a set with all others
are derived from those of the most similar set already done: only the lists of
shingles that one of the two lacks are read.

Equal sets are joined once, as their smallest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .components import components
from .shared import ask, blocks, bucket_count, each_block, packed40, texts, unpacked40, with_answers, with_fields, written
from .units import U, all_windows, mix, prefix, span_hash, word_units, words_of

SHINGLE = 3
#: The least similarity, in hundredths.
SIMILAR = 90
#: Shingles and sets of a cluster that one task joins; larger clusters are joined in cells of two chunks.
CELL, CELL_SETS = 2_000_000, 1024
#: Parts that the copies of one set are dealt to when they fetch their result.
SALTS = 16
#: Sets of a cluster whose overlaps with all others are kept to derive further ones from.
PIVOTS = 64
_PART, _KEY = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)
_EQUAL, _SHINGLES = b"=", b"s"


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z in lower case."""
    text = text.lower()  # of bytes: only A to Z
    starts, ends = words_of(text)
    u = word_units(text, starts, ends)
    if not len(u):
        return u
    if len(u) < n:
        return mix(span_hash(prefix(u), np.array([0]), np.array([len(u)])) ^ U(len(u)))
    return np.unique(all_windows(prefix(u), n))


def classes(similar: int) -> np.ndarray:
    """Least sizes of the size classes; a set's partners are in its class and the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // similar + 1)
    return np.array(out, np.int64)


def first_shingles(shingles: np.ndarray, rank: np.ndarray, similar: int) -> np.ndarray:
    """Those of a set, rare ones first, one of which a set as similar as that has among its own; none if it has no partners.

    rank tells how common a shingle is, 0 if no other set has it; equal ranks go by hash."""
    n = len(shingles)
    most = n - -(-similar * n // 100) + 1
    if np.count_nonzero(rank == 0) >= most:
        return shingles[:0]
    first = np.lexsort((mix(shingles ^ _PART), rank))[:most]
    return shingles[first[rank[first] > 0]]


def keys_of(first: np.ndarray, n: int, similar: int, bounds: np.ndarray) -> np.ndarray:
    """64-bit keys of a set of n shingles: the first ones with its class, and with the class before if that may hold partners."""
    own = int(np.searchsorted(bounds, n, "right")) - 1
    at = [c for c in (own, own - 1) if c == own or c >= 0 and similar * n <= 100 * (int(bounds[own]) - 1)]
    return np.concatenate([mix(first ^ mix(np.array([c + 1], U))) for c in at])


class Scan:
    """One block's sets, the least document of each, and which shingles a second set has."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, shingle: int):
        self.ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        self.sets = [shingle_set(x or b"", shingle) for x in texts(batch.column(batch.schema.get_field_index(text_col)))]
        self.use = np.array([i for i, s in enumerate(self.sets) if len(s) and self.ids[i] is not None], np.int64)
        ids = np.array([self.ids[i] for i in self.use], np.int64)
        whole = np.array([int(np.add.reduce(mix(self.sets[i] ^ _KEY))) for i in self.use], U)
        other = np.array([int(np.add.reduce(mix(self.sets[i] ^ _PART))) ^ len(self.sets[i]) for i in self.use], U)
        self.equal = R.Keys(mix(whole), mix(other) >> U(24), ids)
        self.lead = np.sort(self.equal.first)
        size = np.array([len(self.sets[i]) for i in self.use[self.lead]], np.int64)
        self.owner = np.repeat(np.arange(len(size)), size)
        flat = np.concatenate([self.sets[i] for i in self.use[self.lead]]) if len(size) else np.zeros(0, U)
        order = np.argsort(flat)
        v = flat[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(v)))
        self.keys, self.count = v[first], np.minimum(n, 255)
        self.entry = np.empty(len(v), np.int64)
        self.entry[order] = np.repeat(np.arange(len(first)), n)

    def emit(self, buckets: int):
        for b, body in self.equal.emit(buckets):
            yield b, _EQUAL + body
        for b, lo, hi in R.slices(self.keys, buckets):
            n = self.count[lo:hi]
            yield b + buckets, _SHINGLES + np.uint32(hi - lo).tobytes() + packed40(R.within(self.keys[lo:hi], buckets)) + np.packbits(n > 1).tobytes() + n[n > 1].astype(np.uint8).tobytes()

    def know(self, answers: list[bytes], similar: int) -> tuple[list[int | None], dict[int, np.ndarray]]:
        """The class of each row; the first shingles of the rows whose set may have partners, one for each class and version."""
        whole = _least([x[1:] for x in answers if x[:1] == _EQUAL], self.equal.least)[self.equal.entry]
        known = [np.frombuffer(x, np.uint8, offset=1) for x in answers if x[:1] == _SHINGLES]
        rank = (np.concatenate(known) if known else np.zeros(0, np.uint8))[self.entry]
        ends = np.append(0, np.cumsum(np.bincount(self.owner, minlength=len(self.lead))))
        cls: list[int | None] = list(self.ids)
        for i, c in zip(self.use.tolist(), whole.tolist(), strict=True):
            cls[i] = c
        out = {}
        for k, i in enumerate(self.use[self.lead].tolist()):
            if cls[i] == self.ids[i] and len(first := first_shingles(self.sets[i], rank[ends[k] : ends[k + 1]], similar)):
                out[i] = first
        return cls, out


def _ranks(bodies: list[bytes]) -> list[bytes]:
    """For each shingle: 0 if one set has it, else more the more sets of all blocks have it, by powers of the root of 2."""
    sizes = [int(np.frombuffer(x, np.uint32, 1)[0]) for x in bodies]
    keys = np.concatenate([unpacked40(x[4 : 4 + 5 * n]) for x, n in zip(bodies, sizes, strict=True)])
    counts = []
    for x, n in zip(bodies, sizes, strict=True):
        own, at = np.ones(n, np.int64), 4 + 5 * n
        many = np.unpackbits(np.frombuffer(x, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        own[many] = np.frombuffer(x, np.uint8, offset=at + (n + 7) // 8)
        counts.append(own)
    order = np.argsort(keys)
    k = keys[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    total = np.add.reduceat(np.concatenate(counts)[order], start)
    rank = (2 * np.log2(total)).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(rank, np.diff(np.append(start, len(k))))
    return [x.tobytes() for x in R._split(out, sizes)]


def _reply(bodies: list[bytes]) -> list[bytes]:
    kind, own = bodies[0][:1], [x[1:] for x in bodies]  # a bucket is asked one kind of question
    return [kind + x for x in (_answer(own) if kind == _EQUAL else _ranks(own))]


def _answer(bodies: list[bytes]) -> list[bytes]:
    """For each key: the least document that has it, where that is another than the block's; a bit for each key first."""
    sizes, g, c, d, order = R._gathered(bodies)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    least = np.empty(len(g), np.int64)
    least[order] = d[new][np.cumsum(new) - 1]
    own = np.empty(len(g), np.int64)
    own[order] = d
    return [np.uint32(len(x)).tobytes() + np.packbits(x != y).tobytes() + x[x != y].astype("<i8").tobytes() for x, y in zip(R._split(least, sizes), R._split(own, sizes), strict=True)]


def _least(answers: list[bytes], own: np.ndarray) -> np.ndarray:
    out, at = own.copy(), 0
    for x in answers:
        n = int(np.frombuffer(x[:4], np.uint32)[0])
        end = 4 + (n + 7) // 8
        there = np.flatnonzero(np.unpackbits(np.frombuffer(x[4:end], np.uint8), count=n))
        out[at + there] = np.frombuffer(x[end:], "<i8")
        at += n
    assert at == len(own)
    return out


def link_sets(ids: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, chunk: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An exact join of all sets with each other.

    For each set the least id of its component, and how many documents (copies[i] for
    set i) it links with among the sets of its own chunk and of other chunks."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, size, copies, chunk = [sets[i] for i in order.tolist()], size[order], copies[order], chunk[order]
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(size)))
    by_token = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(m), size)[by_token]  # the index lists, each in order of set size
    at = np.concatenate(([0], np.cumsum(np.bincount(token))))
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def read(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the tokens each set from lo to hi - 1 has; list parts outside are skipped."""
        n = np.zeros(hi - lo, np.int64)
        for t in tokens.tolist():
            part = holder[at[t] : at[t + 1]]
            if len(part) > 32 and (lo > 0 or hi < m):
                part = part[np.searchsorted(part, lo) : np.searchsorted(part, hi)]
                n[part - lo] += 1
            else:
                part = part[(part >= lo) & (part < hi)]
                n[part - lo] += 1
        return n

    pivots: list[tuple[np.ndarray, np.ndarray]] = []
    near, far = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i in range(m):
        mine = token[bounds[i] : bounds[i + 1]]
        lo = int(np.searchsorted(size, -(-similar * size[i] // 100)))
        hi = int(np.searchsorted(size, size[i] * 100 // similar, "right"))
        best = max(range(len(pivots)), key=lambda p: pivots[p][1][i], default=None)
        if best is not None and 2 * pivots[best][1][i] > size[i]:
            theirs, overlap = pivots[best]
            gone, new = np.setdiff1d(theirs, mine, assume_unique=True), np.setdiff1d(mine, theirs, assume_unique=True)
            n = overlap[lo:hi] - read(gone, lo, hi) + read(new, lo, hi)
        elif len(pivots) < PIVOTS:
            whole = read(mine, 0, m)
            pivots.append((mine, whole))
            n = whole[lo:hi]
        else:
            n = read(mine, lo, hi)
        hit = lo + np.flatnonzero((100 + similar) * n >= similar * (size[i] + size[lo:hi]))
        hit = hit[hit != i]
        same = chunk[hit] == chunk[i]
        near[i], far[i] = copies[hit[same]].sum(), copies[hit[~same]].sum()
        for r in np.unique(parent[hit]).tolist():
            a, b = root(i), root(r)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(m)], np.int64)
    own = np.asarray(ids, np.int64)[order]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, own)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return least[roots][back], near[back], far[back]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document with the size of its shingle set, its component and its number of links.

    Two documents link when 100 * intersection >= similar * union.  Returns id_col, the
    columns of ``keep``, ``n_shingles``, ``component_id`` (the least id that links reach,
    its own included) and ``n_links`` (rows it links with, equal sets included).  A document with fewer words than a shingle has all of them
    as its one shingle; a null text or one without words has an empty set and no links;
    a row with a null id has no links and a null component; rows of equal ids are one
    document's versions and share their links; a very long text is a block by itself, in
    one worker with about 40 times its size; an empty table gives an empty one.  Other
    columns are not carried; a column of ``keep`` with a result's name is replaced.

    Shingles are told apart by 64 bits of hash, equal sets by 104; two that share 40 bits
    where they are counted pass for more common ones, which costs candidates, not links.
    """
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    rows = docs.select(*columns)
    table = blocks(rows, text_col, "jaccard")
    n = bucket_count(table)

    answers = ask(with_answers(table), lambda batch, _: Scan(batch, id_col, text_col, shingle).emit(n), _reply, "keys")

    out_columns = [c for c in columns if c == id_col or c in keep]
    schema = with_fields(rows.select(*out_columns).schema, ("n_shingles", "long"), ("_class", "long"), ("_set", "binary"), ("_first", "binary"))
    carried = [f.name for f in schema.fields[:-4]]

    def describe(batches):
        for _, batch, got in each_block(batches):
            scan = Scan(batch, id_col, text_col, shingle)
            cls, survivors = scan.know(got.get("keys", []), similar)
            sets = [scan.sets[i].tobytes() if i in survivors else None for i in range(len(cls))]
            first = [survivors[i].tobytes() if i in survivors else None for i in range(len(cls))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in carried] + [pa.array([len(s) for s in scan.sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(sets, pa.binary()), pa.array(first, pa.binary())],
                names=[*carried, "n_shingles", "_class", "_set", "_first"],
            )

    described = written(with_answers(table, answers).mapInArrow(describe, schema), "described")
    survivors = described.filter("_first is not null")

    def deal(batches):
        bounds = classes(similar)
        for batch in batches:
            keys = [keys_of(np.frombuffer(x, U), n, similar, bounds) for x, n in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            if keys:
                docs = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(docs)], names=["key", "doc"])

    keyed = written(survivors.select("_class", "_first", "n_shingles").mapInArrow(deal, "key long, doc long"), "keyed")
    least = keyed.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key", "least")
    edges = keyed.join(least, "key").filter("doc > least").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    clusters = components(edges).select(F.col("node").alias("_class"), F.col("component").alias("cluster"))
    copies = described.filter("n_shingles > 0").groupBy("_class").agg(F.count("*").alias("copies"))
    placed = written(survivors.select("_class", "n_shingles").join(clusters, "_class"), "places")
    weight = placed.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n_shingles") / CELL, F.count("*") / CELL_SETS)).cast("int").alias("chunks"))
    places = placed.select("_class", "cluster").distinct().join(weight, "cluster").join(copies, "_class")
    own = F.pmod(F.xxhash64("_class"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: o != F.col("chunk"))
    cells = F.when(F.col("chunks") > 1, F.transform(others, lambda o: F.struct(F.least(o, "chunk").alias("a"), F.greatest(o, "chunk").alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    sent = survivors.select("_class", F.col("_set").alias("s")).join(places, "_class").withColumn("chunk", own).withColumn("cell", F.explode(cells))
    sent = sent.select("cluster", "cell.a", "cell.b", "chunk", F.col("_class").alias("doc"), "copies", "s")

    def link(group: pa.Table) -> pa.Table:
        docs, raw = group.column("doc").to_pylist(), group.column("s").to_pylist()
        keep = sorted({(i, x): k for k, (i, x) in enumerate(zip(docs, raw, strict=True))}.values())  # repeated rows of one id
        ids, chunk, copies = (group.column(c).to_numpy()[keep] for c in ("doc", "chunk", "copies"))
        found, near, far = link_sets(ids, [np.frombuffer(raw[k], U) for k in keep], copies, chunk, similar)
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        # links within a chunk are found in each of its cells, and count in one
        once = a == b or np.where(chunk == a, b == (1 if a == 0 else 0), a == 0)
        return pa.table({"a": pa.array(ids), "b": pa.array(found), "n": pa.array(np.where(once, near, 0) + far)})

    linked = written(sent.groupBy("cluster", "a", "b").applyInArrow(link, "a long, b long, n long"), "linked")
    if weight.filter("chunks > 1").limit(1).count():
        found = components(linked)
    else:  # every component lies in one cell
        found = linked.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    counted = linked.groupBy(F.col("a").alias("_class")).agg(F.sum("n").alias("n"))
    about = copies.join(found.withColumnRenamed("node", "_class"), "_class", "left").join(counted, "_class", "left")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).alias("n_links")
    # a set may have very many copies: these are dealt to SALTS parts, each with the result once
    about = about.withColumn("_salt", F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))))
    salt = F.when(F.col("_class") == F.col(id_col), 0).otherwise(1 + F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    found = described.withColumn("_salt", salt).join(about, ["_class", "_salt"], "left")
    return found.select(*carried, "n_shingles", F.coalesce("component", "_class").alias("component_id"), links)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs)
