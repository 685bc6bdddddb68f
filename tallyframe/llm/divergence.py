"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Terms are runs of ASCII letters and of bytes from 0x80 on, A-Z lower-cased. In a task a numpy
lookup table over the concatenated UTF-8 buffers finds their boundaries, XXH64 of all slices at
once groups them, and each slice is compared with its group's first, byte by byte; slices that only
share a hash are grouped by their bytes. A (document x term) CSR matrix in coordinate order gives
occurrences and documents of each (language, source, term), which Spark adds up.

The kept terms of a language are dealt to cells: a part of the terms, and two parts of the sources.
A cell is a (source x term) CSR matrix. Shares are whole numbers of a 10**9th, so all is exact. A
source without a term has the same default share for all of them, so a pair's sum is
``V * f(default, default')`` plus a correction at the terms that one of both has; the corrections
are ``reduceat`` sums over the matrix, row by row. Cells are bounded by ``ENTRIES`` and ``SOURCES``;
their partial sums and their ten best terms are merged by Spark. Nothing is collected or broadcast.

Edge cases: null text, lang and source count as ''; each row is a document, whatever its id, so a
repeated row counts again; a source without kept terms has the default share for all; a language
without kept terms has pairs of value 0; a language with one source has no pairs; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

UNIT = 1_000_000_000  # shares are whole numbers of this part
BLOCK = 4 << 20  # bytes of text tokenized at once
HELD = 400_000  # rows a task holds before they leave
ENTRIES = 250_000  # (source, term) counts of a cell, about
SOURCES = 256  # sources of one side of a cell

# The constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)

_IN = np.zeros(256, bool)
_IN[0x41:0x5B] = _IN[0x61:0x7B] = _IN[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def slice_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices of ``buf``: those below 32 bytes all at once, longer ones one by one."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    h = _P5 + size.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(size >= 8 * (k + 1))
        lane = _turned(eight[start[at] + 8 * k] * _P2, 31) * _P1
        h[at] = _turned(h[at] ^ lane, 27) * _P1 + _P4
    done = size & ~7
    at = np.flatnonzero(size & 4)
    lane = (eight[start[at] + done[at]] & np.uint64(0xFFFFFFFF)) * _P1
    h[at] = _turned(h[at] ^ lane, 23) * _P2 + _P3
    done = size & ~3
    for k in range(3):
        at = np.flatnonzero((size & 3) > k)
        h[at] = _turned(h[at] ^ (buf[start[at] + done[at] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + size[i]].tobytes())
    return h


def slices(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in ``buf``; a text's terms end with it where texts are kept apart by a byte that is in no term."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IN[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2] - edge[0::2]


def grouped(buf: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's group, and a member of each group: groups hold equal bytes."""
    group, _ = pd.factorize(hashes)
    first = np.full(int(group.max(initial=-1)) + 1, -1, np.int64)
    first[group[::-1]] = np.arange(len(group) - 1, -1, -1)
    lead = first[group]
    same = size == size[lead]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    at, k = np.flatnonzero(same), 0
    while len(at):
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        same[at] = ((eight[start[at] + k] ^ eight[start[lead[at]] + k]) & mask) == 0
        k += 8
        at = at[same[at] & (size[at] > k)]
    own: dict[bytes, int] = {}
    extra: list[int] = []
    for i in np.flatnonzero(~same):
        raw = buf[start[i] : start[i] + size[i]].tobytes()
        if raw not in own:
            own[raw] = len(first) + len(extra)
            extra.append(i)
        group[i] = own[raw]
    return group, np.concatenate([first, np.array(extra, np.int64)])


def _terms(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices as an Arrow array, copied in one go."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(buf[at])])


def block_counts(buf: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """owner, term, occurrences, documents of a block: text i ends before byte ``ends[i]``, where a byte of no term stands."""
    low = _LOWER[buf]
    start, size = slices(low)
    group, first = grouped(low, start, size, slice_hashes(low, start, size))
    n = len(first)
    doc = np.searchsorted(ends, start, "right")
    # CSR: coordinates (document, term) in order; then the same by (owner, term).
    coord, count = np.unique(doc * max(n, 1) + group, return_counts=True)
    cell = owner[coord // max(n, 1)] * max(n, 1) + coord % max(n, 1)
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = _terms(low, start[first], size[first])
    return cell[at] // n, terms.take(pa.array(cell[at] % n)), np.add.reduceat(count, at), np.diff(np.append(at, len(cell)))


def _cut(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about a block; none ends inside a term, unless the term is longer than a block."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + BLOCK)
        if stop < len(raw) and len(apart := np.flatnonzero(~_IN[raw[at:stop]])):
            stop = at + int(apart[-1]) + 1
        elif stop < len(raw):
            over = np.flatnonzero(~_IN[raw[stop:]])
            stop = stop + int(over[0]) if len(over) else len(raw)
        yield raw[at:stop]
        at = stop


_COUNTS = "lang string, source string, term string, n long, docs long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for b in batches:
        lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
        pair = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        text = b.column("text").cast(pa.binary())
        off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        size = np.diff(off)
        at = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
            if size[at] > BLOCK:  # one text: its pieces are one document
                stop, parts = at + 1, []
                for piece in _cut(raw[off[at] : off[at + 1]]):
                    _, t, n, _ = block_counts(piece, np.array([len(piece)]), np.zeros(1, np.int64))
                    parts.append(pa.table({"term": t, "n": n}))
                whole = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
                owner, term, n = np.full(len(whole), pair[at]), whole.column("term"), whole.column("n_sum")
                docs = np.ones(len(whole), np.int64)
            else:
                # The texts with a blank behind each.
                own = size[at:stop] + 1
                ends = np.cumsum(own)
                buf = np.full(int(ends[-1]), 0x20, np.uint8)
                to = np.arange(off[stop] - off[at]) + np.repeat(np.arange(stop - at), size[at:stop])
                buf[to] = raw[off[at] : off[stop]]
                owner, term, n, docs = block_counts(buf, ends, pair[at:stop])
            at = stop
            width = max(1, len(source.dictionary))
            held.append(pa.table({"lang": lang.dictionary.take(pa.array(owner // width)), "source": source.dictionary.take(pa.array(owner % width)), "term": term, "n": n, "docs": docs}))
            rows += len(held[-1])
            if rows > 2 * HELD:
                held = [merged()]
                rows = len(held[0])
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches(10_000)
                    held, rows = [], 0
    if held:
        yield from merged().combine_chunks().to_batches(10_000)


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs of every term, dealt by (lang, term)."""
    small_batches(docs.sparkSession)
    each = _named(docs, "lang", "source", "text").mapInArrow(_rows, _COUNTS)
    return each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, source, term, n, lang_n of the terms in at least ``least`` documents of their language."""
    whole = Window.partitionBy("lang", "term")
    c = counts(docs).withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole))
    return c.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / total), by long division, so nothing overflows below a total of 9e15."""
    left, out = np.asarray(count, np.int64), np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def corrections(p: np.ndarray, term: np.ndarray, row: np.ndarray, default: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left``, what its pairs with each of ``right`` have beyond the default at the terms of this CSR matrix (p, term, by row in order)."""
    bounds = np.searchsorted(row, np.arange(len(default) + 1))
    mine = np.empty(width, np.int64)
    other = np.isin(row, right)
    r_p, r_term, r_row = p[other], term[other], row[other]
    starts = np.searchsorted(r_row, right)
    filled = np.diff(np.append(starts, len(r_row))) > 0
    for s in left:
        own = slice(bounds[s], bounds[s + 1])
        mine.fill(default[s])
        mine[term[own]] = p[own]
        base = gap(default[s], default[right])
        # At the other's terms, as if mine alone counted elsewhere ...
        value = gap(mine[r_term], r_p) - gap(mine[r_term], default[r_row])
        out = np.zeros(len(right), np.int64)
        if filled.any():
            out[filled] = np.add.reduceat(value, starts[filled])
        # ... and at my terms against the other's default, which the line above has taken off where both have one.
        for k, r in enumerate(right):
            out[k] += (gap(p[own], default[r]) - base[k]).sum()
        yield s, out


_FOUND = "lang string, source string, part string, item string, value long"


def _cell(entries: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    names = groups.column("source").to_pylist()
    place = {x: i for i, x in enumerate(names)}
    side = groups.column("side").to_numpy()
    total = groups.column("total").to_numpy()
    default = share(np.full(len(names), 2), total) if len(names) else total
    row = np.array([place[x] for x in entries.column("source").to_pylist()], np.int64)
    word, terms = pd.factorize(entries.column("term").to_pandas())
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    p = share(entries.column("n").to_numpy()[order] + 2, total[row]) if len(row) else np.zeros(0, np.int64)
    i, j = (entries if entries.num_rows else groups).column("i")[0].as_py(), (entries if entries.num_rows else groups).column("j")[0].as_py()
    lang = (entries if entries.num_rows else groups).column("lang")[0].as_py()
    source, part, item, value = [], [], [], []
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for s, sums in corrections(p, word, row, default, left, right, len(terms)):
        for r, x in zip(right.tolist(), sums.tolist()):
            if r != s and x:
                source.append(names[s])
                item.append(names[r])
                value.append(x)
                part.append("pair")
    if i == j and len(row):
        q = share(entries.column("lang_n").to_numpy()[order] + 2, entries.column("lang_total").to_numpy()[order])
        f = gap(p, q)
        for s in left:
            own = np.flatnonzero((row == s) & (p > q))
            best = sorted(own.tolist(), key=lambda k: (-f[k], terms[word[k]].encode("utf-8", "surrogatepass")))[:top] if len(own) <= 4 * top else None
            if best is None:
                bar = np.partition(f[own], len(own) - top)[len(own) - top]
                best = sorted(own[f[own] >= bar].tolist(), key=lambda k: (-f[k], terms[word[k]].encode("utf-8", "surrogatepass")))[:top]
            for k in best:
                source.append(names[s])
                item.append(terms[word[k]])
                value.append(int(f[k]))
                part.append("term")
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    table = stored(kept(docs, least), "terms")
    n = table.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    # A term's count in its language stands in each of its rows: it is counted with one of them.
    one = table.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.sum("lang_n").alias("lang_sum"), F.count("*").alias("kept"))
    seen = _named(docs, "lang", "source").distinct().join(n, ["lang", "source"], "left").join(one, "lang", "left").na.fill(0)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("entries").over(Window.partitionBy("lang")) / ENTRIES)).cast("int")
    groups = seen.select("lang", "source", (F.col("n") + 2 * F.col("kept")).alias("total"), (F.col("lang_sum") + 2 * F.col("kept")).alias("lang_total"), "kept", (turn / SOURCES).cast("int").alias("side"), blocks.alias("blocks"))
    groups = stored(groups, "groups")
    sides = groups.groupBy("lang").agg(F.max("side").alias("last"))
    pairs = groups.where("kept > 0").join(sides, "lang")
    # A group stands in the cells of its own side with every other, both ways.
    every = F.sequence(F.lit(0), F.col("last"))
    both = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(F.col("side").alias("i"), x.alias("j"))), F.transform(every, lambda x: F.struct(x.alias("i"), F.col("side").alias("j")))))
    put = pairs.withColumn("at", F.explode(both))
    g = put.select("lang", "at.i", "at.j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "side", "total")
    e = _of_group(table, put.select("lang", "source", "at.i", "at.j", "blocks", "lang_total")).select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "lang_n", "lang_total")
    cell = ["lang", "i", "j", "block"]
    found = e.groupBy(*cell).cogroup(g.groupBy(*cell)).applyInArrow(lambda a, b: _cell(a, b, top), _FOUND)
    found = stored(found, "divergence")
    base = _pairs(groups)
    extra = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("extra"))
    pair = base.join(extra, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.coalesce("extra", F.lit(0))).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    term = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pair.withColumn("rank", rank).unionByName(term)


def _of_group(table: DataFrame, put: DataFrame) -> DataFrame:
    """The counts with what their group's row says, in each of its cells; a frequent group is dealt over 16 tasks by its terms."""
    salt = F.pmod(F.xxhash64("term"), F.lit(16)).cast("int")
    return table.withColumn("salt", salt).join(put.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["lang", "source", "salt"]).drop("salt")


def _pairs(groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept terms if neither had any of them."""
    default = (F.lit(1) + F.expr(f"{2 * UNIT} div nullif(total, 0)")).alias("p")
    a = groups.select("lang", "source", "kept", default)
    b = groups.select("lang", F.col("source").alias("item"), default.alias("q"))
    f: Column = F.expr("(p - q) * (p - q) div (p + q)")
    return a.join(b, "lang").where("source != item").select("lang", "source", "item", F.coalesce(F.col("kept") * f, F.lit(0)).cast("long").alias("value"))
