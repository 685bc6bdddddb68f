"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

Vectors are quantised to whole numbers. A candidate x gets one more component,
``sqrt(M - |x|**2)`` with M the largest squared norm, an anchor a gets 0 there; then
``|a' - x'|**2 = |a|**2 + M - 2 a.x``, so the largest inner products are the nearest points.
Pivots (candidates taken by a hash of the id, at most ``PIVOTS``) cut the candidates into Voronoi
partitions. An anchor belongs to the group of one of the first pivots. For a score s that an anchor
asks for at least, a candidate must lie within ``r = sqrt(|a|**2 + M - 2 s)`` of it, so by the
triangle inequality its distance to its own pivot p is within r of the anchor's distance to p. Over
the anchors of a group this gives an interval of distances for each partition (partition bounds),
and a candidate is copied to those groups only whose interval holds it.

A cell is a group (in parts of ``ANCHORS``) and a block of its candidates; it is joined exactly,
tile by tile, by whole-number products, and returns at most ``k`` rows for each question, which
Spark merges. There are three such joins: with the partition of the group's own pivot, whose
``k``-th score is the bound of the next; the positives; and the negatives, bounded by what part of
the least positive score they must reach. Bounds only leave out what cannot count, so the result
is exact. The interval table, which is broadcast, has at most ``PIVOTS * GROUPS`` rows (if there
are more dimensions than ``PIVOTS``, one a dimension and group). Scores must fit 64 bits.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
rows that share an id are one row (the least label, then the least vector); vectors of unequal
dimension never meet; a zero vector takes part; a positive of negative score has no negatives;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

PIVOTS, GROUPS = 256, 64  # at most
ANCHORS = 4096  # of a cell
CELL = 32 << 20  # bytes of candidates in a cell, about
TILE = 1024  # candidates, anchors of a tile

_VECTOR = "dim int, id long, label int, c array<double>"
_ASSIGNED = _VECTOR + ", pivot int, dist double, own int"


def quantised(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """dim, id, label, c of the rows that take part."""
    v = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(column).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    whole = F.transform("v", lambda x: _floor(x * float(scale)))
    one = ok.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    return one.select(F.size("v").alias("dim"), "id", "label", whole.alias("c"))


def _floor(x):
    """Doubles of 2**52 and more are whole already, and too large for a long."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), dim)


def _distances(x: np.ndarray, top: np.ndarray, pivots: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Between points (x, top) and pivots (pivots, last), top and last being the added component."""
    square = (x**2).sum(1)[:, None] + (top**2)[:, None] + (pivots**2).sum(1) + last**2 - 2 * (x @ pivots.T + np.outer(top, last))
    return np.sqrt(np.maximum(square, 0))


def _added(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x**2).sum(1), 0))


class Space:
    """The pivots of each dimension, with the largest squared norm there."""

    def __init__(self, pivots: dict[int, list[list[float]]], most: dict[int, float]):
        self.most = most
        self.pivots = {d: np.array(p, np.float64).reshape(len(p), d) for d, p in pivots.items()}
        self.last = {d: _added(p, most[d]) for d, p in self.pivots.items()}

    def slack(self, dim: int) -> float:
        """What rounding may add to a distance here (squared distances are rounded by about 2**-50 of M)."""
        return 1e-6 * (1 + math.sqrt(self.most[dim])) * max(1, dim) ** 0.5

    def of_candidates(self, dim: int, x: np.ndarray) -> np.ndarray:
        return _distances(x, _added(x, self.most[dim]), self.pivots[dim], self.last[dim])

    def of_anchors(self, dim: int, x: np.ndarray) -> np.ndarray:
        return _distances(x, np.zeros(len(x)), self.pivots[dim], self.last[dim])


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = b.column("dim").to_numpy()
    for d in np.unique(dim).tolist():
        yield d, b.take(pa.array(np.flatnonzero(dim == d)))


def _assign(space: Space, every: int, groups: int) -> Callable:
    """Candidates to their nearest pivot; ``own`` is an anchor's group, -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_dim(b):
                x = _matrix(part.column("c"), d)
                far = space.of_candidates(d, x)
                pivot = far.argmin(1)
                own = np.where(part.column("id").to_numpy() % every == 0, space.of_anchors(d, x)[:, :groups].argmin(1), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int32()), pa.array(far[np.arange(len(x)), pivot]), pa.array(own, pa.int32())], names=[*part.schema.names, "pivot", "dist", "own"])

    return run


_ROOM = "dim int, own int, pivot int, low double, high double"


def _reach(space: Space) -> Callable:
    """For each anchor and partition the distances that may count: (dim, group, pivot, low, high), one row a pair of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_dim(b):
                x = _matrix(part.column("c"), d)
                least = part.column("least").to_numpy(zero_copy_only=False)
                far = space.of_anchors(d, x)
                with np.errstate(invalid="ignore", over="ignore"):
                    r = np.sqrt(np.maximum((x**2).sum(1) + space.most[d] - 2 * least, 0)) + space.slack(d)
                own = part.column("own").to_numpy()
                for g in np.unique(own):
                    of = own == g
                    low, high = (far[of] - r[of, None]).min(0), (far[of] + r[of, None]).max(0)
                    n = len(low)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, g), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(low), pa.array(high)], names=["dim", "own", "pivot", "low", "high"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in doubles where no sum reaches 2**53, else in Python's integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), np.int64)


class _Best:
    """The ``k`` best (score, then smaller id) of each question."""

    def __init__(self, k: int):
        self.k = k
        self.row = self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        stay = place < self.k
        self.row, self.score, self.id = row[stay], score[stay], ids[stay]


def _joined(a: pa.Table, c: pa.Table, k: int, negatives: bool, low: int, high: int) -> pa.Table:
    """The exact join of a cell. Positives: one question an anchor. Negatives: one for each of its positives."""
    dim = a.column("dim")[0].as_py() if a.num_rows else 0
    x, y = _matrix(a.column("c"), dim), _matrix(c.column("c"), dim if a.num_rows else 0) if a.num_rows else np.zeros((0, 0))
    ids, label = a.column("id").to_numpy(), a.column("label").to_numpy()
    c_ids, c_label = c.column("id").to_numpy(), c.column("label").to_numpy()
    wanted = a.column("wanted").to_pylist() if negatives else [None] * len(ids)
    questions = [(i, p["id"], p["score"]) for i, w in enumerate(wanted) for p in w] if negatives else [(i, None, None) for i in range(len(ids))]
    asks = np.array([q[0] for q in questions], np.int64)
    bound = np.array([q[2] for q in questions], np.int64) if negatives else None
    best = _Best(k)
    for q in range(0, len(questions), TILE):
        some = asks[q : q + TILE]
        rows, back = np.unique(some, return_inverse=True)
        for s in range(0, len(c_ids), TILE):
            part = slice(s, s + TILE)
            score = _products(x[rows], y[part])[back]
            alike = label[some][:, None] == c_label[part][None]
            if negatives:
                top = bound[q : q + TILE, None].astype(score.dtype)
                ok = ~alike & (high * score <= high * top) & (low * top <= high * score)
            else:
                ok = alike & (ids[some][:, None] != c_ids[part][None])
                if score.shape[1] > k:  # no more than the k best of the tile, and what is equal to the last
                    sure = np.where(ok, score, np.iinfo(np.int64).min)
                    ok &= sure >= -np.partition(-sure, k - 1, axis=1)[:, k - 1 : k] if score.dtype != object else ok
            i, j = np.nonzero(ok)
            best.add(i + q, score[i, j], c_ids[part][j])
    out = {"anchor_id": ids[asks[best.row]] if len(best.row) else [], "id": best.id, "score": best.score}
    if negatives:
        out |= {"positive_id": [questions[r][1] for r in best.row.tolist()], "positive_score": [questions[r][2] for r in best.row.tolist()]}
    return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})


_POSITIVE = "anchor_id long, id long, score long"
_NEGATIVE = _POSITIVE + ", positive_id long, positive_score long"


class Miner:
    """The assigned table, its space and the three joins."""

    def __init__(self, table: DataFrame, every: int):
        spark = table.sparkSession
        small_batches(spark)
        table = stored(table, "quantised")
        square = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
        stats = table.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most"), F.sum((F.col("id") % every == 0).cast("long")).alias("anchors")).where("anchors > 0")
        self.stats = {r.dim: r for r in stats.collect()}  # one row for each dimension that vectors have
        n = sum(r.n for r in self.stats.values())
        anchors = sum(r.anchors for r in self.stats.values())
        per = {d: max(1, min(PIVOTS // len(self.stats), math.isqrt(r.n))) for d, r in self.stats.items()}
        self.groups = max(1, min(GROUPS, anchors // 128))
        turn = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
        some = table.where(F.col("dim").isin(list(per))).withColumn("turn", turn).where(F.col("turn") <= PIVOTS) if per else table.limit(0).withColumn("turn", F.lit(1))
        pivots: dict[int, list] = {}
        for r in sorted(some.select("dim", "turn", "c").collect(), key=lambda r: r.turn):
            if r.turn <= per[r.dim]:
                pivots.setdefault(r.dim, []).append(r.c)
        self.space = Space(pivots, {d: r.most for d, r in self.stats.items()})
        self.every = every
        wide = max(pivots, default=1)
        self.blocks = max(8, -(-n * 8 * max(1, wide) // CELL))
        meets = table.where(F.col("dim").isin(list(pivots))) if pivots else table.limit(0)
        self.all = stored(meets.mapInArrow(_assign(self.space, every, self.groups), _ASSIGNED), "assigned")
        self.anchors = self.all.where("own >= 0")

    def join(self, asking: DataFrame, room: DataFrame, k: int, schema: str, low: int = 0, high: int = 0) -> DataFrame:
        """``asking`` (dim, id, label, c, own, ...) against the candidates in its group's ``room``."""
        negatives = "wanted" in asking.columns
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(self.blocks)).cast("int")
        parts = max(1, -(-sum(r.anchors for r in self.stats.values()) // (ANCHORS * self.groups)))
        part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        near = self.all.withColumnRenamed("own", "home").join(F.broadcast(room), ["dim", "pivot"]).where("dist between low and high")
        c = near.select("dim", "own", each(parts).alias("part"), block.alias("block"), "id", "label", "c")
        own = lambda *names: [F.col(x).alias(x) for x in names]  # noqa: E731  both sides come from one table
        a = asking.select(*own("dim", "own"), part.alias("part"), each(self.blocks).alias("block"), *own("id", "label", "c", *(["wanted"] if negatives else [])))
        cell = ["dim", "own", "part", "block"]
        found = a.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(lambda x, y: _joined(x, y, k, negatives, low, high), schema)
        question = ["anchor_id", "positive_id", "positive_score"] if negatives else ["anchor_id"]
        rank = F.row_number().over(Window.partitionBy(*question).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def room(self, asking: DataFrame) -> DataFrame:
        """The interval of each group and partition, from what its anchors ask for at least (column ``least``)."""
        return asking.select("dim", "id", "c", "own", "least").mapInArrow(_reach(self.space), _ROOM).groupBy("dim", "own", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def positives(self, k: int) -> DataFrame:
        """anchor_id, id, score, rank of the ``k`` best other rows of an anchor's label."""
        home = self.anchors.select("dim", "own").distinct().withColumn("pivot", F.col("own"))
        home = home.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
        first = self.join(self.anchors, home, k, _POSITIVE).where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), F.col("score").cast("double").alias("least"))
        asking = self.anchors.join(first, "id", "left").na.fill(float("-inf"), ["least"])
        return self.join(self.anchors, self.room(asking), k, _POSITIVE)


def mine(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``table`` has dim, id, label, c (see :func:`quantised`). Anchors are the rows whose id is a
    multiple of ``every``; negatives have a score from ``low / high`` of the positive's to the positive's.
    """
    m = Miner(table, every)
    found = stored(m.positives(positives), "positives").where("score >= 0")
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("wanted"), (F.min("score") * F.lit(low / high)).alias("least"))
    asking = m.anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
    out = m.join(asking, m.room(asking), negatives, _NEGATIVE, low, high)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
