"""Hard negatives by k-means inverted lists that keep their centroids' radii.

Every row stands in the list of its nearest centroid, and a list knows how far its
farthest row is.  By Cauchy-Schwarz no row of a list scores more against an anchor than
the centroid does plus the anchor's norm times that radius, and none less than the
centroid minus it.  An anchor visits lists from the greatest bound on, skips those
outside its window of scores, and stops when a bound is strictly under its kth score.

Lists fall into cells of bounded size.  A first round sends an anchor to the cell of its
best list only; the kth score found there decides which other cells it goes to in the
second one.  A task holds one cell's rows and streams the anchors past them, so neither
side is ever whole in one place; a cell that many anchors ask for stands in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, tidy, written

POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score between which a negative's lies.
LEAST, MOST = 30, 90
SCALE = 256
#: Centroids are fitted on so many rows at most, those with the least hashes; every row is in a list.
FIT_ROWS, ROUNDS = 32_768, 6
#: Rows that a list has on average, and lists at most.
LIST_ROWS, LISTS = 256, 2048
#: Rows of a cell at least and at most; a cell stands once for so many anchors.
CELL_LEAST, CELL_MOST, CELL_ANCHORS = 4096, 65_536, 65_536
_EXACT, _LONG = float(1 << 53), 1 << 63


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the sample's rows after a few rounds of k-means, in the order of their main direction."""
    usual = sample[np.abs(sample).max(1) < 1e100]
    if not len(usual):
        return np.zeros((1, sample.shape[1]))
    centroids = np.unique(usual[:: max(1, len(usual) // lists)][:lists], axis=0)
    for _ in range(ROUNDS):
        near, _ = nearest(usual, centroids)
        sizes = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, usual)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    middle = centroids - centroids.mean(0)
    _, _, directions = np.linalg.svd(middle, full_matrices=False)
    return centroids[np.argsort(middle @ directions[0], kind="stable")]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and its distance from it."""
    near = np.zeros(len(rows), np.int64)
    with np.errstate(all="ignore"):
        half = (centroids**2).sum(1) / 2
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096] @ centroids.T - half
            near[at : at + 4096] = np.nan_to_num(part, nan=-np.inf, posinf=np.inf, neginf=-np.inf).argmax(1)
        far = np.sqrt(((rows - centroids[near]) ** 2).sum(1))
    return near, np.nan_to_num(far, nan=np.inf, posinf=np.inf)


class Lists:
    """Lists by number: for every length of vector the centroids, and of lists with rows their radii and cells."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids, self.first, n = centroids, {}, 0
        for d in sorted(centroids):
            self.first[d] = n
            n += len(centroids[d])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list and distance; rows of a length that the sample lacked share one around zero."""
        d = rows.shape[1]
        if d not in self.centroids:
            return np.full(len(rows), -d), nearest(rows, np.zeros((1, d)))[1]
        near, far = nearest(rows, self.centroids[d])
        return near + self.first[d], far

    def settle(self, held: list[tuple[int, int, int, float]], cell_rows: int) -> None:
        """Takes (length, list, rows, radius); lists in order fill cells, a larger list is dealt to several."""
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        cell, room = -1, 0
        for d, group in groupby(sorted(held), key=lambda x: x[0]):
            rows = []
            for _, number, n, radius in group:
                if n > cell_rows:
                    parts = -(-n // cell_rows)
                    rows.append((number, cell + 1, parts, radius))
                    cell, room = cell + parts, 0
                    continue
                if n > room:
                    cell, room = cell + 1, cell_rows
                rows.append((number, cell, 1, radius))
                room -= n
            room = 0
            numbers = np.array([r[0] for r in rows])
            middle = self.centroids[d][numbers - self.first[d]] if d in self.centroids else np.zeros((1, d))
            self.lists[d] = (numbers, middle, np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.cells = cell + 1

    def cells_of(self, d: int, lists: np.ndarray, deal: np.ndarray) -> np.ndarray:
        numbers, _, _, first, parts = self.lists[d]
        at = np.searchsorted(numbers, lists)
        return first[at] + deal % parts[at]

    def bounds(self, anchors: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of lists of the anchors' length, and for each anchor the least and greatest score there.

        Rounding of these is far under what they are widened by."""
        d = anchors.shape[1]
        if d not in self.lists:
            return np.zeros(0, np.int64), np.zeros((len(anchors), 0)), np.zeros((len(anchors), 0))
        numbers, middle, radius = self.lists[d][:3]
        if which is not None:
            at = np.flatnonzero(np.isin(numbers, which))
            numbers, middle, radius = numbers[at], middle[at], radius[at]
        with np.errstate(all="ignore"):
            norm = np.sqrt((anchors**2).sum(1))[:, None]
            score = anchors @ middle.T
            reach = norm * radius
            reach = reach + 1e-9 * (norm * np.sqrt((middle**2).sum(1)) + reach) + 1
            low, high = score - reach, score + reach
        odd = ~np.isfinite(low) | ~np.isfinite(high)
        return numbers, np.where(odd, -np.inf, low), np.where(odd, np.inf, high)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact floats, or Python's integers where floats would not be."""
    with np.errstate(all="ignore"):
        most = np.sqrt((anchors**2).sum(1).max() * (rows**2).sum(1).max())
    if most < _EXACT:
        return anchors @ rows.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(anchors) @ whole(rows).T


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of score, column) of the k greatest that fit in each row, the first columns of equals."""
    n = score.shape[1]
    if score.dtype != object and (not score.size or float(np.abs(score).max()) * n + n < float(1 << 62)):
        keys = np.where(fits, score, 0).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        keys[~fits] = np.iinfo(np.int64).min
        top = np.argpartition(keys, n - k, 1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), score.shape)
        row, at = np.nonzero(np.take_along_axis(fits, top, 1))
        return row, top[row, at]
    found = [(i, j) for i in range(len(score)) for j in sorted(np.flatnonzero(fits[i]).tolist(), key=lambda j: (-int(score[i, j]), j))[:k]]
    return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)


class _Anchors:
    """Some anchors of one length on their way through a cell, with their k best so far."""

    def __init__(self, batch: dict[str, np.ndarray], k: int):
        self.v = np.frombuffer(b"".join(batch["v"]), "<f8").reshape(len(batch["v"]), -1)
        self.id, self.label, self.same = batch["id"], batch["label"], batch["same"].astype(bool)
        self.low, self.high, self.floor, self.k = batch["low"], batch["high"], batch["floor"].copy(), k
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.id]

    def visit(self, lists: Lists, cell: dict[int, tuple]) -> None:
        """Lists of a cell from the greatest bound on, until the bound is strictly under the kth score."""
        numbers, least, most = lists.bounds(self.v, np.array(list(cell)))
        if not len(numbers):
            return
        outside = (most < self.low[:, None]) | (least > self.high[:, None])
        most = np.where(outside, -np.inf, most)
        order = np.argsort(-most, 1, kind="stable")
        for step in range(len(numbers)):
            turn = order[:, step]
            bound = most[np.arange(len(turn)), turn]
            going = np.flatnonzero((bound >= self.floor) & (bound > -np.inf))
            if not len(going):
                break
            for which in np.unique(turn[going]).tolist():
                self._meet(going[turn[going] == which], *cell[int(numbers[which])])

    def _meet(self, some: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        score = scores(self.v[some], v)
        fits = ((labels == self.label[some, None]) == self.same[some, None]) & (ids != self.id[some, None])
        fits &= ((score >= np.maximum(self.low[some], self.floor[some])[:, None]) & (score <= self.high[some, None])).astype(bool)
        if score.dtype == object:
            fits &= ((score >= -_LONG) & (score < _LONG)).astype(bool)
        row, at = best(score, fits, self.k)
        for i, j in zip(row.tolist(), at.tolist(), strict=True):
            self.best[some[i]].append((-int(score[i, j]), int(ids[j])))
        for i in some[np.unique(row)].tolist():
            self.best[i] = sorted(self.best[i])[: self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = max(self.floor[i], float(-self.best[i][-1][0]))


_ROW = "cell int, part int, is_anchor boolean, id long, nth int, label string, list long, v binary, same boolean, low double, high double, floor double"
_NAMES = [x.split(" ")[0] for x in _ROW.split(", ")]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)


def _table(batch: pa.RecordBatch, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for name in columns:
        column = batch.column(name)
        out[name] = np.array(column.to_pylist(), object) if name in ("v", "label") else _numbers(column)
    return out


def _by_length(v: np.ndarray) -> Iterator[np.ndarray]:
    sizes = np.array([len(x) for x in v])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _route(anchors: DataFrame, lists: Lists, first: bool) -> DataFrame:
    """Anchors with the cell of their best list, or with all other cells that may hold one of their k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                table = _table(part, ("v", "low", "high", "floor"))
                out: list[tuple[int, int]] = []
                for some in _by_length(table["v"]):
                    v = np.frombuffer(b"".join(table["v"][some]), "<f8").reshape(len(some), -1)
                    numbers, least, most = lists.bounds(v)
                    if not len(numbers):
                        continue
                    _, _, _, begin, parts = lists.lists[v.shape[1]]
                    low, high, floor = (table[c][some, None] for c in ("low", "high", "floor"))
                    bound = np.where((most < low) | (least > high), -np.inf, most)
                    top = bound.argmax(1)
                    goes = bound >= np.maximum(floor, -1.7e308)
                    for i, at in enumerate(some.tolist()):
                        # a list of several cells is only begun in the first round
                        start_cell = int(begin[top[i]]) if bound[i, top[i]] > -np.inf else -1
                        if first:
                            cells = {start_cell} - {-1}
                        else:
                            cells = {c for j in np.flatnonzero(goes[i]).tolist() for c in range(begin[j], begin[j] + parts[j])} - {start_cell}
                        out += [(at, c) for c in sorted(cells)]
                index = pa.array([x[0] for x in out], pa.int64())
                taken = part.take(index)
                columns = {"cell": pa.array([x[1] for x in out], pa.int32())}
                yield pa.RecordBatch.from_arrays([columns.get(n, taken.column(n) if n != "cell" else None) for n in _NAMES], names=_NAMES)

    return anchors.select(*_NAMES).mapInArrow(run, _ROW)


def _visit(rows: DataFrame, routed: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(id, nth, found, score): of every routed anchor the k best rows of its cells."""
    routed = written(routed, "anchors")
    copies = routed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ANCHORS).cast("int").alias("copies"))
    # rows of cells that no anchor asks for stay behind
    several = rows.drop("part").join(copies, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = routed.drop("part").join(copies, "cell").withColumn("part", F.pmod(F.xxhash64("id", "nth"), F.col("copies")).cast("int"))
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.cells))
    both = several.select(*_NAMES).unionByName(dealt.select(*_NAMES))
    placed = both.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "is_anchor", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None
        for batch in tidy(batches):
            keys = _table(batch, ("cell", "part", "is_anchor"))
            edge = np.flatnonzero(np.any([np.diff(keys[c].astype(np.int64)) != 0 for c in keys], 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                key = (int(keys["cell"][a]), int(keys["part"][a]))
                if key != now:
                    now, held, cell = key, [], None
                if not keys["is_anchor"][a]:
                    held.append(_table(batch.slice(a, b - a), ("id", "label", "list", "v")))
                    continue
                if cell is None:
                    cell, held = _lists_of(held), []
                if not cell:
                    continue
                for start in range(a, b, 256):
                    table = _table(batch.slice(start, min(256, b - start)), ("id", "nth", "label", "v", "same", "low", "high", "floor"))
                    for some in _by_length(table["v"]):
                        anchors = _Anchors({n: x[some] for n, x in table.items()}, k)
                        anchors.visit(lists, cell)
                        out = [(i, n, found, -score) for i, n, best in zip(anchors.id.tolist(), table["nth"][some].tolist(), anchors.best, strict=True) for score, found in best]
                        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["id", "nth", "found", "score"])

    return placed.mapInArrow(run, "id long, nth int, found long, score long")


def _lists_of(held: list[dict[str, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A cell's rows by list, in the order of their ids."""
    if not held:
        return {}
    table = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
    order = np.lexsort((table["id"], table["list"]))
    table = {n: x[order] for n, x in table.items()}
    edges = np.flatnonzero(np.diff(table["list"])) + 1
    out = {}
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(order)], strict=True):
        v = np.frombuffer(b"".join(table["v"][a:b]), "<f8").reshape(b - a, -1)
        out[int(table["list"][a])] = (v, table["id"][a:b], table["label"][a:b])
    return out


def _search(rows: DataFrame, anchors: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(id, nth, found, score, rank) of the k best rows of every anchor, in two rounds."""
    keys = ["id", "nth"]
    begun = written(_visit(rows, _route(anchors, lists, True), lists, k), "first")
    kth = begun.groupBy(*keys).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("_kth"))
    floored = anchors.join(kth, keys, "left").withColumn("floor", F.coalesce("_kth", "floor"))
    rest = _visit(rows, _route(floored, lists, False), lists, k)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return begun.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """For every row that is_anchor holds for and each of its positives, rows of other labels that score nearly as high.

    A component x counts as floor(scale * x); a score is the inner product with the anchor.
    Positives are the first rows of the anchor's label, negatives the first rows of other
    labels with a score from least to most hundredths of the positive's; higher scores come
    first, ties by smaller ids.  Returns ``anchor_id``, ``positive_id``, ``rank`` from 1,
    ``negative_id``, ``positive_score`` and ``negative_score``; anchors without positives,
    and positives without negatives, have no rows.

    Rows with a null id, label or vector, or with components that are null, undefined or (scaled)
    infinite, take no part; vectors meet only ones as long, empty ones none.  An anchor meets no row
    of its own id; of several anchor rows with one id the least label and vector count;
    other repeated rows each take a rank.  A pair whose score leaves 64 bits takes no part.
    An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall("a", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < float("inf")))
    finite = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("a"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("a").isNotNull())
        .filter((F.size("a") > 0) & sound)
        .select("id", "label", "is_anchor", F.transform("a", lambda c: c * float(scale)).alias("a"))
    )

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            lists = batch.column(3)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            v = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], v], names=["id", "label", "is_anchor", "v"])

    usable = written(small_batches(finite).mapInArrow(floored, "id long, label string, is_anchor boolean, v binary"), "vectors")
    total = usable.count()
    sample = [r["v"] for r in usable.orderBy(F.xxhash64("id", F.lit(13)), "id", "v").limit(FIT_ROWS).select("v").collect()]
    number = max(1, min(LISTS, total // LIST_ROWS, len(sample) // 8))
    sample = np.array(sample, object)
    lists = Lists({len(sample[some[0]]) // 8: fitted(np.frombuffer(b"".join(sample[some]), "<f8").reshape(len(some), -1), number) for some in _by_length(sample)} if len(sample) else {})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            v = np.array(batch.column(2).to_pylist(), object)
            number, far = np.zeros(len(v), np.int64), np.zeros(len(v))
            for some in _by_length(v):
                number[some], far[some] = lists.of(np.frombuffer(b"".join(v[some]), "<f8").reshape(len(some), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(far)], names=["id", "label", "v", "list", "far"])

    assigned = written(usable.select("id", "label", "v").mapInArrow(assign, "id long, label string, v binary, list long, far double"), "lists")
    held = assigned.groupBy((F.octet_length("v") / 8).cast("int").alias("d"), "list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    at_once = 2 * spark.sparkContext.defaultParallelism
    lists.settle([tuple(r) for r in held], max(CELL_LEAST, min(CELL_MOST, total // at_once)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            sizes = np.array([len(x) for x in batch.column(2).to_pylist()]) // 8
            number, deal, cell = _numbers(batch.column(3)), _numbers(batch.column(4)), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(sizes).tolist():
                some = sizes == d
                cell[some] = lists.cells_of(d, number[some], deal[some])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell)], names=["id", "label", "v", "list", "cell"])

    null = lambda t: F.lit(None).cast(t)
    deal = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).alias("deal")
    placed = assigned.select("id", "label", "v", "list", deal).mapInArrow(cells, "id long, label string, v binary, list long, cell int")
    plain = {"part": F.lit(0), "is_anchor": F.lit(False), "nth": null("int"), "same": null("boolean"), "low": null("double"), "high": null("double"), "floor": null("double")}
    stored = placed.withColumns(plain).select(*_NAMES)

    own = usable.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    anything = {"cell": F.lit(0), "part": F.lit(0), "is_anchor": F.lit(True), "list": null("bigint")}
    asked = own.withColumns(anything | {"nth": F.lit(0), "same": F.lit(True), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "floor": F.lit(float("-inf"))}).select(*_NAMES)
    near = written(_search(stored, asked, lists, positives), "positives")

    hundredths = lambda n: F.col("score").cast("decimal(20,0)") * F.lit(n).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")
    window = near.select("id", F.col("rank").alias("nth"), F.ceil(hundredths(least)).cast("double").alias("low"), F.floor(hundredths(most)).cast("double").alias("high")).filter("low <= high")
    asked = own.join(window, "id").withColumns(anything | {"same": F.lit(False), "floor": F.col("low")}).select(*_NAMES)
    far = _search(stored, written(asked, "windows"), lists, negatives).select("id", "nth", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank"))
    known = near.select("id", F.col("rank").alias("nth"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return known.join(far, ["id", "nth"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(noisy, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM scored WHERE same) WHERE nth <= 5
), found AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""
