"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

Every document is cut at multiples of the capacity as it is encoded; those pieces fill windows
by themselves. The rests are gathered into groups of ``group`` windows' worth of tokens, and each
group is partitioned by multiway differencing, which gives near-equal windows; while one holds
more than the capacity, their number rises and the group is partitioned again (:func:`windows`).
Since documents may be cut, the near-equal windows are then filled to the brim by moving the
smallest number of tokens from the last ones (:func:`level`). What is left of a window goes to the
next group; the last group of a partition ends in windows of powers of two, which need no padding.

A task holds one group of rests at a time, whatever the number or length of the documents, and
its result depends on its partition alone, so a lost task can run again. No shuffle is needed.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed each; an
empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import docs_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_sum = itemgetter(0)


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into ``k`` parts with near-equal sums.

    A partial partition is a list of (sum, items), largest first, empty parts left out. The two
    with the largest spread are merged, the largest part of one with the smallest of the other.
    """
    if k <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(max(k, 1) - 1)]
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)  # parts that must be shared
        shared = [(a[len(a) - 1 - j][0] + b[len(b) - over + j][0], (a[len(a) - 1 - j][1], b[len(b) - over + j][1])) for j in range(over)]
        parts = sorted(a[: len(a) - over] + b[: len(b) - over] + shared, key=_sum, reverse=True)
        if len(parts) == k and (low := parts[-1][0]):
            spread = parts[0][0] - low
        else:
            spread = parts[0][0]
        heapq.heappush(heap, (-spread, n, parts))
        n += 1
    out = []
    for _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items into windows of at most ``capacity``; the window count rises while one is exceeded."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    k = -(-sum(sizes) // capacity)
    while sizes:
        parts = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1
    return []


def level(parts: list[list[tuple[int, int, int]]], targets: list[int]) -> list[list[tuple[int, int, int]]]:
    """Cut what parts (item, start, length) hold beyond their targets and move it to parts with room; parts without a target are moved whole.

    Targets go to parts by size, the largest first, so little moves.
    """
    total = lambda p: sum(x[2] for x in p)
    parts = sorted((list(p) for p in parts), key=total, reverse=True)
    parts += [[] for _ in range(len(targets) - len(parts))]
    targets = sorted(targets, reverse=True)
    targets += [0] * (len(parts) - len(targets))
    spare: list[tuple[int, int, int]] = []
    for p, t in zip(parts, targets):
        over = total(p) - t
        while over > 0:
            i, s, n = p.pop()
            if n > over:
                p.append((i, s, n - over))
                spare.append((i, s + n - over, over))
                over = 0
            else:
                spare.append((i, s, n))
                over -= n
    for p, t in zip(parts, targets):
        room = t - total(p)
        while room > 0 and spare:
            i, s, n = spare.pop()
            take = min(n, room)
            p.append((i, s, take))
            if take < n:
                spare.append((i, s + take, n - take))
            room -= take
    return parts


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """The pieces of one partition's documents, group after group."""

    def __init__(self, capacity: int, group: int, first: int):
        self.capacity, self.size, self.sequence = capacity, capacity * group, first
        self.rest: list[tuple[int | None, int, int, np.ndarray]] = []  # doc, start, doc_tokens, ids
        self.held = 0
        self.rows: list[tuple] = []

    def _row(self, doc, start, ids, tokens, offset) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.capacity
        for s in range(0, whole, self.capacity):
            self._row(doc, s, ids[s : s + self.capacity], n, 0)
            self.sequence += 1
        if whole < n:
            self.rest.append((doc, whole, n, ids[whole:].copy()))  # a view would keep the whole document's ids
            self.held += n - whole
            if self.held >= self.size:
                self.flush()

    def flush(self, final: bool = False) -> None:
        """Emit the full windows of the rests; what is left of a window stays for the next group, or ends in powers of two."""
        sizes = [len(x[3]) for x in self.rest]
        full, last = divmod(sum(sizes), self.capacity)
        ends = _powers(last) if final else [last] * bool(last)
        parts = [[(i, 0, sizes[i]) for i in p] for p in windows(sizes, self.capacity)]
        rest = []
        for n, part in enumerate(level(parts, [self.capacity] * full + ends)):
            if n >= full and not final:
                rest += [(doc, start + s, tokens, ids[s : s + n_]) for i, s, n_ in part for doc, start, tokens, ids in [self.rest[i]]]
                continue
            offset = 0
            for i, s, size in part:
                doc, start, tokens, ids = self.rest[i]
                self._row(doc, start + s, ids[s : s + size], tokens, offset)
                offset += size
            self.sequence += bool(part)
        self.rest, self.held = rest, sum(len(x[3]) for x in rest)


def pack(docs: DataFrame, path: str, capacity: int = 1024, closing: int = 0, group: int = 64) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        packer = _Packer(capacity, group, TaskContext.get().partitionId() << 36)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

        for b in batches:
            for doc, pieces in zip(b.column("doc_id").to_pylist(), e.many(b.column("text").to_pylist())):
                ids = np.frombuffer(b"".join(pieces) + closing.to_bytes(4, "little"), "<u4")
                packer.add(doc, ids)
            yield out()
        packer.flush(True)
        yield out()

    return docs_of(docs).mapInArrow(run, SCHEMA)
