"""Greedy walks, spread over tasks: pairs are taken in an order, and each row is in one pair at most.

A walk only has to be in order among pairs that can compete, so pairs are dealt by a key that no
competition crosses (an amount, a merchant; ``within``) and each task walks its pairs as a sorted
stream, remembering the rows that the key at hand has used. Only if a key has more than ``MOST``
pairs are its pairs cut into connected components, by alternating large and small stars, whose
rounds grow with the logarithm of a component's size; and only components of more than ``MOST``
pairs are walked in rounds in which each pair goes that comes first for both its rows.

Rows that compete for equal amounts over time need no pairs at all: :func:`queued` takes them as a
stream by date. Needs ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import heapq
import itertools
import uuid
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MOST = 2_000_000  # pairs of a key, or of a component, that one task walks


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names, and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with those of each key in one task, one after the other, in order.

    They are dealt by a hash of the key, not the key itself: after a join by the key Spark would
    leave that shuffle out, then may read the join's input where it lies, and a key is in many tasks.
    """
    return rows.repartition(F.xxhash64(*by, F.lit("dealt"))).sortWithinPartitions(*by, *order)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, debits, credits = object(), set(), set()
    for b in batches:
        keep = []
        for key, d, c in zip(b.column("walk").to_pylist(), b.column("debit").to_pylist(), b.column("credit").to_pylist()):
            if key != now:
                now, debits, credits = key, set(), set()
            free = d not in debits and c not in credits
            if free:
                debits.add(d)
                credits.add(c)
            keep.append(free)
        yield b.filter(pa.array(keep, pa.bool_()))


def walked(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Of each value of ``walk`` the pairs that a walk in order takes."""
    return dealt(pairs, ["walk"], order).mapInArrow(_walk, pairs.schema).drop("walk")


def components(edges: DataFrame) -> DataFrame:
    """debit, component of a graph of (debit, credit): the least credit, as text, that a debit is connected with."""
    name = lambda c: F.concat(F.lit(c[0]), F.col(c).cast("string"))  # noqa: E731  c... is before d...
    e = held(edges.select(name("debit").alias("u"), name("credit").alias("v")).distinct())
    told = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = held(small.distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == told:
            return e.where("u like 'd%'").select(F.substring("u", 2, 1 << 30).cast(edges.schema["debit"].dataType).alias("debit"), F.col("v").alias("component"))
        told = now


def _rounds(pairs: DataFrame, order: list[str]) -> DataFrame:
    rest, out = pairs, None
    key = F.struct(*order)
    while True:
        best = rest.withColumn("key", key)
        a = best.groupBy("debit").agg(F.min("key").alias("a"))
        b = best.groupBy("credit").agg(F.min("key").alias("b"))
        taken = held(best.join(a, "debit").join(b, "credit").where((F.col("key") == F.col("a")) & (F.col("key") == F.col("b"))).select(*pairs.columns))
        if taken.isEmpty():
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        rest = held(rest.join(taken.select("debit"), "debit", "left_anti").join(taken.select("credit"), "credit", "left_anti"))


def assign(candidates: DataFrame, *order: str, within: list[str] | None = None, most: int = MOST) -> DataFrame:
    """One-to-one pairs (debit, credit, ...), as if taken greedily by ``order``; ties go to the lesser debit, then credit.

    ``within``: columns of which pairs that share a debit or a credit have the same values; without
    them all pairs are cut into connected components.
    """
    order = list(dict.fromkeys([*order, "debit", "credit"]))
    edges = held(candidates)
    if within:
        keyed = edges.withColumn("walk", F.xxhash64(*within).cast("string"))
        large = keyed.groupBy("walk").count().where(F.col("count") > most).select("walk")
        if large.isEmpty():
            return walked(keyed, order)
        done = walked(keyed.join(large, "walk", "left_anti"), order)
        edges = keyed.join(large, "walk", "left_semi").drop("walk")
    else:
        done = None
    labels = components(edges.select("debit", "credit"))
    keyed = held(edges.join(labels, "debit").withColumnRenamed("component", "walk"))
    large = keyed.groupBy("walk").count().where(F.col("count") > most).select("walk")
    few = walked(keyed.join(large, "walk", "left_anti"), order).select(*candidates.columns)
    done = few if done is None else done.select(*candidates.columns).unionByName(few)
    if large.isEmpty():
        return done
    return done.unionByName(_rounds(keyed.join(large, "walk", "left_semi").select(*candidates.columns), order))


def _drawn(group: list[tuple], cells: dict, at: dict) -> Iterator[tuple]:
    """(debit, credit, pair) as a walk by debit, then credit, takes them of cell pairs that come at one place in the order.

    The rows of a cell are alike, so the least free one goes first, and a free row is always the head of its cell.
    """
    offers: dict = {}
    for pair in group:
        offers.setdefault(pair[0], []).append(pair)
    head = lambda cell: cells[cell][at[cell]] if at.setdefault(cell, 0) < len(cells[cell]) else None
    heap = [(i, cell) for cell in offers if (i := head(cell)) is not None]
    heapq.heapify(heap)
    while heap:
        debit, own = heap[0]
        offers[own] = free = [p for p in offers[own] if head(p[1]) is not None]
        if not free:
            heapq.heappop(heap)
            continue
        pair = min(free, key=lambda p: head(p[1]))
        yield debit, head(pair[1]), pair
        at[own] += 1
        at[pair[1]] += 1
        if (i := head(own)) is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (i, own))


def assign_cells(pairs: DataFrame, rows: DataFrame, within: str, order: list[str]) -> DataFrame:
    """:func:`assign` where rows that are alike stand together: ``pairs`` of cells (debit, credit, ...) stand for the pairs of all their rows.

    ``rows``: cell, id and ``within``, a column of which a debit and its credits have the same value;
    a row is a debit or a credit, by its cell. One row a pair of rows taken, with the cell pair's other
    columns. A task holds the ids of one value of ``within`` and the cell pairs of one place in the order.
    """
    columns = pairs.columns
    ids = rows.select(F.col(within).alias("walk"), F.lit(0).alias("step"), F.col("cell").alias("debit"), "id")
    stream = ids.unionByName(pairs.withColumns({"walk": F.col(within), "step": F.lit(1)}), allowMissingColumns=True)
    stream = dealt(stream, ["walk"], ["step", *order, "debit", "credit", "id"])
    whole = rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kinds = to_arrow_schema(StructType([f for f in stream.schema.fields if f.name in columns]))
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, group, cells, at = object(), None, [], {}, {}
        for b in itertools.chain(batches, [None]):
            taken = []
            walks = [object()] if b is None else b.column("walk").to_pylist()
            steps, debits, credits, numbers = ([1], [None], [None], [None]) if b is None else (b.column(c).to_pylist() for c in ("step", "debit", "credit", "id"))
            places = [None] if b is None else zip(*(b.column(c).to_pylist() for c in order))
            for k, (walk, step, debit, credit, number, here) in enumerate(zip(walks, steps, debits, credits, numbers, places)):
                if group and (walk != now or here != place):
                    taken += _drawn(group, cells, at)
                    group = []
                if walk != now:
                    now, cells, at = walk, {}, {}
                if step == 0:
                    if debit not in cells:
                        cells[debit] = array("q") if whole else []
                    cells[debit].append(number)
                elif b is not None:
                    place = here
                    group.append((debit, credit, b, k))
            taken.sort(key=lambda t: id(t[2][2]))
            for _, own in itertools.groupby(taken, key=lambda t: id(t[2][2])):
                own = list(own)
                got = own[0][2][2].take(pa.array([t[2][3] for t in own], pa.int64()))
                made = {"debit": [t[0] for t in own], "credit": [t[1] for t in own]}
                yield pa.RecordBatch.from_arrays([pa.array(made[n], got.column(n).type) if n in made else got.column(n) for n in names], names=names)

    return stream.mapInArrow(run, StructType([f for f in stream.schema.fields if f.name in columns])).select(*columns)


def queued(asking: DataFrame, offered: DataFrame, days: int, by: list[str]) -> DataFrame:
    """debit, credit: each asking row (id, day, ``by``), by day and id, takes the earliest free offered row of its key up to ``days`` later.

    No pairs are made: asking rows wait in a queue, and an offered row, as it comes by date, goes to
    the first that still waits. What a task holds is the queue, the asking rows of ``days`` days.
    """
    a = asking.select(*by, F.col("id"), "day", F.lit(0).alias("side"))
    b = offered.select(*by, F.col("id"), "day", F.lit(1).alias("side"))
    rows = a.unionByName(b).withColumn("walk", F.xxhash64(*by).cast("string"))
    kind = asking.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = object(), {}
        for x in batches:
            debit, credit = [], []
            keys = list(zip(*(x.column(c).to_pylist() for c in by)))
            for walk, key, i, day, side in zip(x.column("walk").to_pylist(), keys, x.column("id").to_pylist(), x.column("day").to_pylist(), x.column("side").to_pylist()):
                if walk != now:
                    now, waiting = walk, {}
                queue = waiting.setdefault(key, deque())
                if side == 0:
                    queue.append((day, i))
                    continue
                while queue and (day - queue[0][0]).days > days:
                    queue.popleft()
                if queue:
                    debit.append(queue.popleft()[1])
                    credit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(debit, x.column("id").type), pa.array(credit, x.column("id").type)], ["debit", "credit"])

    return dealt(rows, ["walk"], ["day", "side", "id"]).mapInArrow(run, f"debit {kind}, credit {kind}")


def gathered(rows: DataFrame, by: list[str], order: list[str], walk: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``walk`` applied to the rows of each key, in order; a task holds one key's rows at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = tuple(r[c] for c in by)
                if key != now:
                    out += walk(own) if own else []
                    now, own = key, []
                own.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if own:
            yield pa.RecordBatch.from_pylist(walk(own), schema=kinds)

    return dealt(rows, by, order).mapInArrow(run, schema)
