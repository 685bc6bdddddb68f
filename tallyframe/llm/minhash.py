"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document is the set of its distinct 5-word shingles. The sketch has T coordinates: in round
i every element is hashed to one coordinate and a value, and a coordinate keeps the least value
of the first round that reached it; after T such rounds round T + j sends all elements to
coordinate j, so every coordinate is filled, and the share of equal coordinates concentrates
around the Jaccard similarity. Bands of ``ROWS`` coordinates give buckets; there are as many bands
as leave a pair of the least wanted similarity in no common bucket with a probability of ``MISS``
at most: 24 for 0.85, 35 for 0.8 (:func:`plan`). Every link is confirmed on full sets.

The work is by classes of equal sets, so exact copies, however many, are one row. It has two parts,
both of which decide on full sets alone. First each bucket's members meet one pivot of the bucket,
which is linear in the members and connects groups of near copies. Then only buckets that still
hold several components are compared in full: cut into blocks of bounded size that meet two by
two, except that members of a bucket's main component never meet each other, so no task holds a
bucket, and a large group that the pivots connected costs nothing more. A pair is looked at in the
first band that it shares, in that alone. Where two blocks meet only links that connect are
returned: a spanning forest, so rows grow with the members, not with the pairs, and no link
between components is lost. All links are merged by star contraction.

Edge cases: a null, empty or blank text has no shingles and is linked with nothing; fewer than
five words are one shingle; a null doc_id is not linked and its component is null; rows that
share a doc_id are one document, linked with what any of its texts is linked with, and each has its
own n_shingles; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, hot_join, mix, stored, word_hashes

WORDS = 5
ROWS, MISS = 5, 1e-6
SIDE, SHINGLES = 1500, 600_000  # members and shingles of a block
PIVOTS = 4  # pivots of a bucket at most; what they leave apart is compared in full
SLOTS = 1 << 24  # bits of the bitmap that spares texts without a candidate the shuffle: 2 MB
_U = np.uint64


@lru_cache
def plan(percent: int) -> int:
    """The number of bands for links from ``percent`` on."""
    p = percent / 100
    return 1 if percent >= 100 else math.ceil(math.log(MISS) / math.log1p(-(p**ROWS)))


@lru_cache
def _salts(n: int, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(factor))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    h, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            x = h[at : at + n]
            at += n
            if not n:
                out.append(x)
                continue
            k = min(n, WORDS)
            g = mix(x[: n - k + 1] + _U(k))
            for j in range(1, k):
                g = mix(g + x[j : n - k + 1 + j])
            out.append(np.unique(g))
    return out


def sketch(g: np.ndarray, t: int = 120) -> np.ndarray:
    """The ``t`` filled coordinates of a non-empty set."""
    out = np.full(t, _U(2**64 - 1))
    salt = _salts(2 * t, 0xD1342543DE82EF95)
    done = 0
    step = max(1, min(t, int(t * 6 / len(g)) + 1))
    while done < t and out.max() == _U(2**64 - 1):
        rounds = np.arange(done, min(t, done + step))
        for r in [rounds] if len(g) * len(rounds) < 1 << 16 else rounds[:, None]:
            x = mix(g[None, :] + salt[r, None])
            np.minimum.at(out, ((x >> _U(40)) % _U(t)).astype(np.int64).ravel(), (r.astype(np.uint64)[:, None] << _U(48) | (x & _U(2**40 - 1))).ravel())
        done += len(rounds)
    for j in np.flatnonzero(out == _U(2**64 - 1)):
        out[j] = _U(t + j) << _U(48) | (mix(g + salt[t + j]) & _U(2**40 - 1)).min()
    return mix(out)


def bands(s: np.ndarray) -> np.ndarray:
    """The key of each band, of the 16 bits a coordinate that the block pairs see: what agrees there in a band shares its bucket."""
    x = s.reshape(-1, ROWS) & _U(0xFFFF)
    key = _salts(len(x), 0xA0761D6478BD642F)
    for j in range(ROWS):
        key = mix(key + x[:, j])
    return key.astype(np.int64)


def _identity(g: np.ndarray) -> tuple[int, int]:
    return int(g.sum(dtype=np.uint64).astype(np.int64)), int(mix(g ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def profiles(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit identity (one, two), bands and sketch of every text."""
    t = plan(percent) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, keys, marks = [], [], [], [], []
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                with np.errstate(over="ignore"):
                    for g in shingle_sets(texts[i : i + 500]):
                        n.append(len(g))
                        x, y = _identity(g)
                        one.append(x)
                        two.append(y)
                        s = sketch(g, t) if len(g) else None
                        keys.append(None if s is None else bands(s))
                        marks.append(None if s is None else s.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "one", "two", "bands", "sketch"],
            )

    return docs_of(docs).mapInArrow(run, "doc_id long, n_shingles long, one long, two long, bands array<long>, sketch binary")


def forest(band: int, side: np.ndarray, ids: np.ndarray, comps: np.ndarray, marks: list[bytes], sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that connect what two blocks hold (or one, with all rows on side 0), beyond the components they have."""
    x = np.frombuffer(b"".join(marks), "<u2").reshape(len(ids), -1)[:, : band * ROWS]
    size = np.array([len(g) // 8 for g in sets])
    end = np.cumsum(size)
    codes = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)[1]
    group = np.unique(comps, return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, np.uint8)
    two = side.any()
    right = np.flatnonzero(side == 1) if two else np.arange(len(ids))
    out = []
    for a in np.flatnonzero(side == 0).tolist():
        c = right if two else right[a + 1 :]
        c = c[group[c] != group[a]]
        # The smaller set bounds the intersection.
        c = c[100 * np.minimum(size[c], size[a]) >= percent * np.maximum(size[c], size[a])]
        if band and len(c):  # pairs that meet in an earlier band
            c = c[~(x[c] == x[a]).reshape(len(c), band, ROWS).all(2).any(1)]
        if not len(c):
            continue
        own = codes[end[a] - size[a] : end[a]]
        mark[own] = 1
        first = np.cumsum(size[c]) - size[c]
        both = np.add.reduceat(mark[np.concatenate([codes[end[k] - size[k] : end[k]] for k in c.tolist()])], first, dtype=np.int64)
        mark[own] = 0
        c = c[100 * both >= percent * (size[a] + size[c] - both)]
        linked, at = np.unique(group[c], return_index=True)
        out += [(int(ids[a]), int(ids[k])) for k in c[at].tolist()]
        group[np.isin(group, linked)] = group[a]
    return out


def _links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: the forests of all block pairs of rows (key, i, j, side, band, id, comp, sketch, set)."""
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def work() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            band, side, ids, comps = (t.column(c).to_numpy() for c in ("band", "side", "id", "comp"))
            found = forest(int(band[0]), side, ids, comps, t.column("sketch").to_pylist(), t.column("set").to_pylist(), percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in names])
            cut = np.concatenate([[0], np.flatnonzero(np.any(np.diff(where, axis=1), axis=0)) + 1, [b.num_rows]])
            for s, e in zip(cut.tolist(), cut[1:].tolist()):
                if s == e:
                    continue
                own = tuple(where[:, s].tolist())
                if own != now and held:
                    yield work()
                    held = []
                now = own
                held.append(b.slice(s, e - s))
        if held:
            yield work()

    return members.repartition(*names).sortWithinPartitions(*names, "side", "id").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the rows (a, b, set, other) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set"), batch.column("other")):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                ok = 100 * min(len(p), len(q)) >= percent * max(len(p), len(q))
                if ok:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok = 100 * both >= percent * (len(p) + len(q) - both)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set", "other").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """id, one, two, set: the full set of each text, with its identity."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out, one, two = [], [], []
            for i in range(0, len(texts), 500):
                with np.errstate(over="ignore"):
                    for g in shingle_sets(texts[i : i + 500]):
                        x, y = _identity(g)
                        one.append(x)
                        two.append(y)
                        out.append(g.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(out, pa.binary())], ["id", "one", "two", "set"])

    return docs.mapInArrow(run, "id long, one long, two long, set binary")


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids``, none of which is lost, without a shuffle of ``docs``.

    The bitmap has ``SLOTS`` bits whatever the input; where it fills up, more rows pass.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)) + 1
    bits = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substr("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return docs.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket").where(hit).select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """id, comp: the least id of each node's connected component, by alternating large and small stars.

    Only the sums of what changed reach the driver; no node's neighbours are gathered. Each star is
    stored by itself, as a plan repeats its inputs at each use, and the driver holds all of it.
    """
    turned = lambda df, *ways: df.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ways)))).where("u <> v")
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        least = turned(edges, ("u", "v"), ("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = stored(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "stars")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(turned(large.join(down, "u"), ("v", "m"), ("u", "m")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    # Now every edge leads to a root, which is no edge's upper end.
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("comp")), F.struct(F.col("v").alias("id"), F.col("v").alias("comp")))
    return stored(edges.select(F.inline(ends)).distinct(), "comps")


def _placed(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``members`` with the component that each is in so far."""
    if comp is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _apart(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    several = placed.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band", "key")
    return placed.join(several, ["band", "key"])


def _pivoted(placed: DataFrame, sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """a, b: links of each bucket's members with its pivot, a member of a component drawn by ``turn``."""
    pivot = placed.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("comp", F.lit(turn)).alias("h"), "comp", "id", "one", "two")).alias("p"))
    pairs = placed.join(pivot, ["band", "key"]).where("comp <> p.comp")
    # Stored before the sets come in: the join below reads them three times.
    pairs = stored(pairs.select("id", "one", "two", F.col("p.id").alias("b"), F.col("p.one").alias("p_one"), F.col("p.two").alias("p_two")).distinct(), "pairs")
    full = sets.select("id", "one", "two", "set")
    wide = pairs.join(full, ["id", "one", "two"]).select(F.col("id").alias("a"), "b", "p_one", "p_two", "set")
    return _verified(hot_join(wide, full.toDF("b", "p_one", "p_two", "other"), ["b", "p_one", "p_two"], "a", counted=pairs), percent)


def _blocks(apart: DataFrame) -> DataFrame:
    """key, i, j, side, band, id, one, two, comp: the members of each bucket for every pair of its blocks that can hold a link."""
    of = apart.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    main = of.groupBy("band", "key").agg(F.max(F.struct("n", "s", "comp")).alias("main"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    parts = lambda n, s: F.greatest(F.ceil(n / SIDE), F.ceil(s / SHINGLES))
    m = apart.join(main.select("band", "key", "main", parts(F.col("main.n"), F.col("main.s")).alias("x"), parts(F.col("all_n") - F.col("main.n"), F.col("all_s") - F.col("main.s")).alias("y"), parts(F.col("all_n"), F.col("all_s")).alias("z")), ["band", "key"])
    hash_ = F.xxhash64("one", "two")
    chief = F.col("comp") == F.col("main.comp")
    own = F.when(F.col("z") == 1, 0).when(chief, F.pmod(hash_, "x")).otherwise(F.col("x") + F.pmod(hash_, "y"))
    first, last = F.when(chief & (F.col("z") > 1), F.col("x")).otherwise(0), F.when(F.col("z") == 1, 0).otherwise(F.col("x") + F.col("y") - 1)
    m = m.withColumn("own", own).withColumn("o", F.explode(F.sequence(first, last)))
    return m.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "band", "id", "one", "two", "comp")


def link(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    profile = stored(profiles(docs, percent), "profiles")
    sure = profile.where("n_shingles > 0 and doc_id is not null")
    classes = sure.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    keyed = classes.select("id", "one", "two", "size", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.sum(F.xxhash64("one", "two").cast("decimal(38,0)")).alias("who"), F.min("one").alias("low")).where("n > 1")
    # Bands that gather the same classes are one bucket, the first of them.
    buckets = buckets.groupBy("n", "total", "who", "low").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n")
    members = stored(keyed.join(buckets, ["band", "key"]), "members")
    ids = stored(members.select(F.col("id").alias("doc_id")).distinct(), "ids")
    # The exact semi-join is of sets: one of texts would be moved below the bitmap's join.
    sets = _sets(likely(docs_of(docs), ids)).join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi").groupBy("id", "one", "two").agg(F.first("set").alias("set"))
    sets = stored(sets.join(classes.select("one", "two", "sketch"), ["one", "two"]), "sets")
    edges = stored(_pivoted(_placed(members, None), sets, 0, percent), "links")
    comp = components(edges)
    apart = stored(_apart(_placed(members, comp)), "apart")
    # Buckets larger than a block get more pivots while these connect something.
    for turn in range(1, PIVOTS):
        large = apart.where(F.col("n") > SIDE)
        if large.isEmpty():
            break
        more = stored(_pivoted(large, sets, turn, percent), "links")
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        comp = components(edges)
        apart = stored(_apart(_placed(apart.drop("comp"), comp)), "apart")
    if not apart.isEmpty():
        more = stored(_links(_blocks(apart).join(sets, ["id", "one", "two"]).drop("one", "two"), percent), "links")
        if not more.isEmpty():
            comp = components(edges.unionByName(more))
    out = profile.join(classes.select("one", "two", "id"), ["one", "two"], "left").join(comp, "id", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "id")).otherwise(F.col("doc_id"))
    out = stored(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("own")), "owns")
    # Texts that share a doc_id connect what they belong to.
    several = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b")
    if not several.isEmpty():
        shared = components(out.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("own").alias("b")).where("a <> b"))
        out = hot_join(out, shared.select(F.col("id").alias("own"), "comp"), ["own"], "doc_id", "left").withColumn("own", F.coalesce("comp", "own"))
    return out.select("doc_id", "n_shingles", F.col("own").alias("component_id"), (F.col("doc_id") == F.col("own")).alias("kept"))


def dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns kept, of which each component keeps its document of least id; rows without an id stay."""
    links = stored(link(docs, percent), "kept").where("doc_id is not null")
    out = docs.join(links.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = links.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        once = out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(twice, "doc_id", "left_anti").unionByName(once)
    return out.select(*(f"`{c}`" for c in docs.columns))
