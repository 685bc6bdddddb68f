"""Nearest neighbours by a block matrix join with int8 product tiles.

Equal vectors are one class, represented by its least id, so copies, however many, are one row; of
a class only the ``k + 1`` least ids can be among anyone's ``k`` nearest. Classes are dealt to
groups and queries to parts, both of bounded size, and every (part, group) cell is one cogrouped
task: the block matrix join. In a cell, tiles of int8 products give all inner products with a bound
on their quantisation error. Pairs whose upper bound reaches what the query already has survive;
they are recomputed in double precision from the original vectors and pushed to the query's heap
of ``k + 1``. A cell returns its heaps and the heaps of a query's cells are merged, so what leaves
a task is bounded by its queries. The bounds are never exceeded, so the result is exact.

Edge cases: vectors that are null, zero or hold a null or non-finite component take no part, nor
do rows with a null id; vectors of unequal dimension never meet; rows that share an id are one
vector (the least, in array order); with fewer than ``k`` candidates all are returned; ties go to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import hot_join, stored

CANDIDATES, QUERIES = 2048, 512  # vectors in a tile
GROUPS = 24  # cells a part at least
CELL = 64 << 20  # bytes of either side of a cell, about
PAIRS = 1 << 17  # survivors recomputed at once


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v: the rows that take part; v stays in single precision where the table has it."""
    single = isinstance(table.schema[column].dataType, ArrayType) and isinstance(table.schema[column].dataType.elementType, FloatType)
    v = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    return ok.groupBy("id").agg(F.min("v").alias("v"))


class _Side:
    """Vectors of one side of a cell: as they are, as int8 rows, each row's scale and a bound on its rounding."""

    def __init__(self, table: pa.Table, dim: int):
        self.n = table.num_rows
        flat = table.column("v").combine_chunks()
        self.x = np.asarray(flat.flatten()).reshape(self.n, dim)
        x = self.x.astype(np.float64)
        most = np.abs(x).max(1)
        self.scale = most / 127
        tiny = self.scale == 0
        self.scale[tiny] = most[tiny]  # the smallest numbers have no 127th
        self.tile = np.clip(np.rint(x / self.scale[:, None]), -127, 127).astype(np.int8)
        self.slack = np.linalg.norm(x - self.tile * self.scale[:, None], axis=1) * (1 + 1e-9)
        self.norm = np.linalg.norm(x, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


def heaps(q: _Side, c: _Side, reps: list[int], k: int) -> list[list[tuple[float, int, int]]]:
    """For each query the ``k`` best (score, -rep, row) of a cell's candidates, as heaps."""
    dim = q.x.shape[1]
    wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products below 2**24 are exact
    best: list[list[tuple[float, int, int]]] = [[] for _ in range(q.n)]
    bar = np.full(q.n, -np.inf)
    for s in range(0, c.n, CANDIDATES):
        tile = c.tile[s : s + CANDIDATES].astype(wide)
        part = slice(s, s + CANDIDATES)
        for r in range(0, q.n, QUERIES):
            own = slice(r, r + QUERIES)
            dot = (q.tile[own].astype(wide) @ tile.T).astype(np.float64) * q.scale[own, None] * c.scale[part]
            # |q.x - q'.x'| <= |q| |x - x'| + |x'| |q - q'|, and |x'| <= |x| + |x - x'|
            bound = q.norm[own, None] * c.slack[part] + q.slack[own, None] * (c.norm[part] + c.slack[part])
            bound += 1e-9 * q.norm[own, None] * c.norm[part]
            n = dot.shape[1]
            floor = bar[own]
            if n > k:
                floor = np.maximum(floor, np.partition(dot - bound, n - k, axis=1)[:, n - k])
            i, j = np.nonzero(dot + bound >= floor[:, None])
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS] + r, j[at : at + PAIRS] + s
                score = products(q.x[a], c.x[b])
                keep = score >= bar[a]
                for u, w, x in zip(a[keep].tolist(), b[keep].tolist(), score[keep].tolist()):
                    item = (x, -reps[w], w)
                    if len(best[u]) < k:
                        heapq.heappush(best[u], item)
                    elif item > best[u][0]:
                        heapq.heapreplace(best[u], item)
                    else:
                        continue
                    if len(best[u]) == k:
                        bar[u] = best[u][0][0]
    return best


def _cells(k: int):
    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        query, score, ids = [], [], []
        if q.num_rows and c.num_rows:
            dim = q.column("dim")[0].as_py()
            members = c.column("ids")
            for rep, heap in zip(q.column("rep").to_pylist(), heaps(_Side(q, dim), _Side(c, dim), c.column("rep").to_pylist(), k)):
                for x, _, row in heap:
                    query.append(rep)
                    score.append(x)
                    ids.append(members[row].as_py())
        return pa.table({"rep": pa.array(query, pa.int64()), "score": pa.array(score, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return cell


def search(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding", groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each row whose id is a multiple of ``every``."""
    v = stored(vectors(table, key, column), "vectors")
    own = F.col("id") % every == 0
    total, asking, dim = v.agg(F.count("*"), F.sum(own.cast("long")), F.max(F.size("v"))).first()
    # A vector takes up to 8 bytes a component, and one more in its tile.
    rows = max(CANDIDATES, CELL // (9 * (dim or 1)))
    groups, parts = max(groups, -(-total // rows)), max(1, -(-(asking or 0) // rows))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = v.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select("v", "ids", F.get("ids", F.lit(0)).alias("rep"), F.size("v").alias("dim")), "classes")
    queries = stored(hot_join(v.where(own), classes.select("v", "rep"), ["v"], "id").select(F.col("id").alias("query_id"), "rep"), "queries")
    dealt = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = classes.select(F.col("dim").alias("dim"), dealt("rep", groups, 1).alias("group"), copies(parts).alias("part"), F.col("rep").alias("rep"), "ids", F.col("v").alias("v"))
    q = classes.join(queries.select("rep").distinct(), "rep", "left_semi").select("dim", copies(groups).alias("group"), dealt("rep", parts, 2).alias("part"), "rep", "v")
    cell = ["dim", "part", "group"]
    near = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(_cells(k + 1), "rep long, score double, ids array<long>")
    # The heaps of all cells of a class, then its nearest ids; a query's own id is one of k + 1.
    each = near.select("rep", "score", F.explode("ids").alias("id")).select("rep", F.struct((-F.col("score")).alias("a"), "id").alias("x"))
    turn = F.row_number().over(Window.partitionBy("rep").orderBy("x"))
    best = each.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("x")).alias("near"))
    found = hot_join(queries, best, ["rep"], "query_id")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = found.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.a")).alias("score"))
