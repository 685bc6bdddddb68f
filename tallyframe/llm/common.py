"""Helpers shared by the corpus operators: scratch tables, folds and word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH, BYTES = 2000, 16 << 20  # rows and bytes handed to a Python worker at once


def small_batches(spark: SparkSession) -> None:
    """Hand over at most ``BATCH`` rows and about ``BYTES`` at once, as texts can be long.

    These are settings of the session, which has them from then on; smaller ones of its own stay.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share and which the session must name."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table (at ``path``, if named) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads, as its rows live on in another stored table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


HOT, SALTS = 500, 64  # keys that are dealt over several tasks, and over how many


def hot_join(many: DataFrame, one: DataFrame, on: list[str], spread: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``one``, which has each key once, with no task left with a frequent key.

    The ``HOT`` most frequent keys of ``many`` are dealt over ``SALTS`` tasks by a hash of the
    column ``spread``, and their rows of ``one`` copied there; any other key has less than a
    ``HOT``-th of the rows. What is broadcast is that list, of bounded length. Keys are counted in
    ``counted``, a table cheaper to read that has them as often; the list is planned twice.
    """
    counts = (many if counted is None else counted).groupBy(*on).agg(F.count("*").alias("hot_n")).where("hot_n > 1000")
    hot = F.broadcast(counts.orderBy(F.desc("hot_n"), *on).limit(HOT))
    salt = F.when(F.col("hot_n").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("hot_n").isNotNull(), SALTS - 1).otherwise(0)))
    a = many.join(hot, on, "left").withColumn("hot_salt", salt).drop("hot_n")
    b = one.join(hot, on, "left").withColumn("hot_salt", salts).drop("hot_n")
    return a.join(b, [*on, "hot_salt"], how).drop("hot_salt")


_left: list[Callable[[], None]] = []


def left(drop: Callable[[], None]) -> None:
    """Called in a task: what stays in its Python worker beyond the task is dropped by ``drop``."""
    if drop not in _left:
        _left.append(drop)


def freed() -> None:
    """Called in a task: drop what other operators left in its Python worker, which Spark uses for one task after another."""
    while _left:
        _left.pop()()


def docs_of(df: DataFrame) -> DataFrame:
    """The two columns the operators read; any other column is ignored, whatever its name."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the text '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_pow: np.ndarray = np.ones(1, np.uint64)
_inv: np.ndarray = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        one = np.ones(size, np.uint64)
        a, b = one * _P, one * _P_INV
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


SLICE = 1 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's word count.

    The bytes of all texts are hashed at once by polynomial prefix sums modulo 2**64; a word's
    hash depends on its bytes alone. Slices at white space bound the memory of long texts.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    hashes, starts = [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + SLICE)
        if stop < len(data):
            near = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(near):  # one word over the whole slice
                stop = min(len(data), stop + SLICE)
                near = np.flatnonzero(_SPACE[data[at:stop]])
            stop = at + int(near[-1]) + 1
        part = _LOWER[data[at:stop]]
        space = np.empty(len(part) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = _SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1])
        s, e = edge[0::2], edge[1::2]
        p, inv = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * p[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(where, ends, "left"), prepend=0)
    return h, counts.astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, cap: int | None = None) -> DataFrame:
    """(doc_id, text, y) of the labelled documents of the training folds (crc32(doc_id) mod 3 is not 1): all, or at most ``cap``.

    With ``cap``, the label rows are taken in order of a hash of their id, which bounds what is
    broadcast. A repeated id counts once, with its largest label and, among the rows of ``docs``,
    its least text; rows with a null id or label take no part.
    """
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(3) != 1))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    if cap is not None:
        y = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap))
    rows = docs_of(docs).where(fold(3) != 1).join(y, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
