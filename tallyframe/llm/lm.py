"""Language-model scoring with Elias-Fano n-gram tries.

The model is an interpolated trigram:
``p(w | u v) = (c(u v w) + b * p(w | v)) / (c(u v) + b)``, ``p(w | v) = (c(v w) + a * p(w)) / (c(v) + a)``,
over a discounted unigram ``p(w) = (c(w) - d) / N`` whose freed mass ``d * V / N`` is the unknown
word's. Words have dense numbers, the frequent ones small ones, so n-grams are exact. A trie has three
levels of Elias-Fano sequences: the first words, the second words and the third words, the latter two
stored relative to the ordinal of their context, which makes each level one increasing sequence;
monotone pointers lead from a context to its range in the next level. Beside the second and third
level stands each n-gram's joint probability as a byte (exact for small counts, then in geometric
steps): a conditional probability is made of two of them, the n-gram's rounded down and its
context's rounded up, so smoothed probabilities never sum to more than 1. Unigram counts need to be
exact for the base score and are no codes. The levels are written to a file and memory-mapped; rank
and select read the mapped words by a directory of two counts for each 64 bits, and a query is a
successor search within its context's range.

The model grows with the corpus, so no task holds it whole: it is dealt by first word into tries of
bounded size; n-grams of words that make up a thousandth of all tokens or more are dealt by the second
and, if that is frequent as well, by the third word too. Documents are gathered into chunks; a chunk
asks each trie once for its distinct n-grams, and the counts of the same request train the trie. A
request without n-grams is not sent, so there are never more of them than distinct n-grams of a chunk.

Edge cases: a null or empty text is the end token alone; repeated rows each count and each get a
row; a null doc_id is in the fold of the empty text; an empty training fold gives probability 1
to the unknown word; an empty table gives no rows.
"""

from __future__ import annotations

import io
import os
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, docs_of, mix, scratch, stored, word_hashes

FOLDS, HELD = 7, 2
MU = (1000.0, 20.0)  # a and b of the module's text
CHUNK = 4 << 20  # bytes of text in a chunk
PER_TRIE = 1_000_000  # tokens dealt to a trie
SHARE = 1000  # a word with this part of all tokens is dealt by the words that follow it
EXACT, CODES = 64, 255  # counts below the first have codes of their own; all codes
_U = np.uint64
END = mix(np.array([0xE0D], np.uint64))[0]
NONE, BEGIN, WORDS = 0, 1, 2  # numbers: no word or an unknown one, the place before a text, the first word


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an unsigned array, compressed; planes of zeros above the largest value are left out."""
    x = np.ascontiguousarray(x, "<u8")
    size = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8).T[:size]
    return zstandard.compress(len(x).to_bytes(8, "little") + planes.tobytes(), 1)


def _expand(b: bytes) -> np.ndarray:
    raw = zstandard.decompress(b)
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _pack(keys: np.ndarray, *rest: np.ndarray) -> bytes:
    """Increasing keys as differences, and arrays beside them."""
    return _squeeze(np.concatenate([np.diff(keys, prepend=_U(0)), *(x.astype(np.uint64) for x in rest)]))


def _unpack(b: bytes, columns: int) -> np.ndarray:
    x = _expand(b).reshape(columns, -1)
    np.cumsum(x[0], out=x[0])
    return x


def _pack_grams(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Increasing n-grams: a second word is the difference to the one before it below the same first word."""
    new, _ = _runs_of(u)
    step = np.diff(v, prepend=_U(0))
    step[new] = v[new]
    return _pack(u, step, w, n)


def _unpack_grams(b: bytes) -> np.ndarray:
    x = _unpack(b, 4)
    new, run = _runs_of(x[0])
    sums = np.cumsum(x[1])
    x[1] = sums - (sums[new] - x[1][new])[run]
    return x


def _key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number a triple, in the order of the triples; it holds among the triples given only."""
    columns = [u, v, w]
    bits = lambda: [int(x.max()).bit_length() if len(x) else 0 for x in columns]
    for i in range(3):  # what is too wide goes by its rank
        if sum(bits()) > 64:
            columns[i] = np.unique(columns[i], return_inverse=True)[1].astype(np.uint64)
    _, second, third = bits()
    if sum(bits()) > 64:
        pair = np.unique(columns[0] << _U(second) | columns[1], return_inverse=True)[1].astype(np.uint64)
        return pair << _U(third) | columns[2]
    return columns[0] << _U(second + third) | columns[1] << _U(third) | columns[2]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct keys stand, in their order, and the place of each key among them."""
    order = np.argsort(key)
    own, place = _runs_of(key[order])
    back = np.empty(len(key), np.int64)
    back[order] = place
    return order[own], back


def _runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and the run of each row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new), np.cumsum(new) - 1


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: The place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8).ravel()


class EliasFano:
    """An increasing sequence: low bits packed, high parts in unary, read where they lie."""

    def __init__(self, n: int, low: int, packed: np.ndarray, unary: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low = n, low
        # A view of the 8 bytes that start at each byte; the packed bits end in 8 spare bytes.
        self.words = np.ndarray((len(packed) - 7,), "<u8", packed, strides=(1,))
        self.unary, self.ones, self.zeros = unary.view("<u8"), ones.view("<u4"), zeros.view("<u4")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Length, number of low bits, and as bytes: low bits, unary words, ones and zeros before each word."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(low)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(unary.view("<u8")), dtype=np.int64)])[:-1]
        zeros = np.arange(len(ones)) * 64 - ones
        packed = [np.zeros(0, np.uint8)]
        for i in range(0, n, 1 << 15):  # a multiple of 8 values ends at a whole byte
            planes = np.ascontiguousarray(values[i : i + (1 << 15)])[:, None].view(np.uint8)
            packed.append(np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :low].ravel(), bitorder="little"))
        return n, low, np.concatenate([*packed, np.zeros(8, np.uint8)]), unary, ones.astype("<u4").view(np.uint8), zeros.astype("<u4").view(np.uint8)

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """The place of the i-th (from 0) one or zero of the unary bits."""
        before = self.ones if one else self.zeros
        i = i.astype(np.uint32)
        k = np.searchsorted(before, i, "right") - 1
        word = self.unary[k] if one else ~self.unary[k]
        left = i - before[k]
        at = k << 6
        for width in (32, 16, 8):
            n = np.bitwise_count(word & _U((1 << width) - 1))
            over = left >= n
            left = left - n * over
            step = over * np.uint8(width)
            word = word >> step
            at = at + step
        return at + _IN_BYTE[(word & _U(255)).astype(np.uint16) << 3 | left.astype(np.uint16)]

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low
        return self.words[bit >> 3] >> (bit & 7).astype(np.uint64) & _U((1 << self.low) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self._select(at, True) - at).astype(np.uint64) << _U(self.low) | self._low(at)

    def _group(self, h: np.ndarray) -> np.ndarray:
        """The first place whose high part is at least h, which is at most one more than the largest."""
        return np.where(h > 0, self._select(np.maximum(h, 1) - 1, False) - (h - 1), 0)

    def find(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which x stand in [start, stop), and where: a successor search among the values of x's high part, which differ in low bits alone."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = self[np.array([self.n - 1])][0] >> _U(self.low)
        h = x >> _U(self.low)
        some = np.flatnonzero(h <= top)
        h, low = h[some].astype(np.int64), x[some] & _U((1 << self.low) - 1)
        a = np.clip(self._group(h), start[some], stop[some])
        end = np.clip(self._group(h + 1), start[some], stop[some])
        b = end.copy()
        while len(open_ := np.flatnonzero(a < b)):
            m = (a[open_] + b[open_]) >> 1
            less = self._low(m) < low[open_]
            a[open_[less]] = m[less] + 1
            b[open_[~less]] = m[~less]
        hit = np.flatnonzero(a < end)
        hit = hit[self._low(a[hit]) == low[hit]]
        return some[hit], a[hit]


class Trie:
    """Three levels, memory-mapped from one file: words, pointers and quantised joint probabilities.

    It is made of increasing triples and their counts; a triple whose third word is ``NONE`` is a bigram.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, counts: np.ndarray, steps: np.ndarray, folder: str):
        first = np.ones(len(u), bool)
        first[1:] = u[1:] != u[:-1]
        second = first.copy()
        second[1:] |= v[1:] != v[:-1]
        one, two, third = np.flatnonzero(first), np.flatnonzero(second), w > NONE
        codes = code_of(counts, steps)
        ordinal = lambda x: (np.cumsum(x) - 1).astype(np.uint64)
        self.bits = _U(max(1, int(max(v.max(), w.max())).bit_length() if len(u) else 1))
        levels = [
            u[one],
            np.append(ordinal(second)[one], _U(len(two))),
            ordinal(first)[two] << self.bits | v[two],
            np.append((np.cumsum(third) - third)[two], third.sum()).astype(np.uint64),
            ordinal(second)[third] << self.bits | w[third],
        ]
        coded = [EliasFano.encode(x) for x in levels]
        parts = [x for c in coded for x in c[2:]] + [np.where(third[two], 0, codes[two]).astype(np.uint8), codes[third]]
        path = os.path.join(folder, "trie")
        at = []
        with open(path, "wb") as f:
            for x in parts:
                f.write(bytes(-f.tell() % 8))
                at.append(f.tell())
                f.write(x.tobytes())
        self.map = np.memmap(path, np.uint8, "r")
        views = [self.map[i : i + len(x)] for i, x in zip(at, parts)]
        self.firsts, self.to_second, self.seconds, self.to_third, self.thirds = (EliasFano(*c[:2], *views[4 * i : 4 * i + 4]) for i, c in enumerate(coded))
        self.codes = views[-2:]

    def _below(self, level: EliasFano, pointers: EliasFano, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words stand below their contexts, and where."""
        own, back = _runs_of(context)
        start, stop = pointers[context[own]].astype(np.int64)[back], pointers[context[own] + 1].astype(np.int64)[back]
        fits = np.flatnonzero(word >> self.bits == 0)
        i, at = level.find(context[fits].astype(np.uint64) << self.bits | word[fits], start[fits], stop[fits])
        return fits[i], at

    def query(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of each of the ordered triples, or bigrams where the third word is ``NONE``; 0 where the n-gram is unknown."""
        out = np.zeros(len(u), np.uint8)
        n = self.firsts.n
        if not n or not len(u):
            return out
        own, back = _runs_of(u, v)  # each context is looked up once
        one, up = _runs_of(u[own])
        at = np.full(len(one), -1)
        i, found = self.firsts.find(u[own][one], np.zeros(len(one), np.int64), np.full(len(one), n))
        at[i] = found
        at = at[up]
        i = np.flatnonzero(at >= 0)
        hit, found = self._below(self.seconds, self.to_second, at[i], v[own][i])
        at = np.full(len(own), -1)
        at[i[hit]] = found
        at = at[back]
        two, three = np.flatnonzero((at >= 0) & (w == NONE)), np.flatnonzero((at >= 0) & (w > NONE))
        out[two] = self.codes[0][at[two]]
        hit, found = self._below(self.thirds, self.to_third, at[three], w[three])
        out[three[hit]] = self.codes[1][found]
        return out


def steps_of(total: int) -> np.ndarray:
    """The least count of each code from 1 on: counts below ``EXACT``, then geometric steps up to the total."""
    more = np.geomspace(EXACT, max(total, EXACT) + 1, CODES - EXACT).astype(np.int64)
    return np.unique(np.concatenate([np.arange(1, EXACT), more]))


def code_of(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.searchsorted(steps, counts, "right").astype(np.uint8)


def counts_of(codes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest count that a code stands for."""
    low = np.concatenate([[0], steps])
    return low[codes], np.append(low[1:] - 1, low[-1])[codes]


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, tokens, payload: documents gathered into blocks of about ``size`` bytes; one long text is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, total = TaskContext.get().partitionId() << 32, [], 0

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal chunk
            t = pa.Table.from_batches(rows)
            f = io.BytesIO()
            with pa.ipc.new_stream(f, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                w.write_table(t)
            n = total // 8 + t.num_rows  # about, and seldom more than there are
            chunk += 1
            return pa.RecordBatch.from_arrays([pa.array([chunk - 1]), pa.array([n]), pa.array([f.getvalue()], pa.binary())], ["chunk", "tokens", "payload"])

        for b in batches:
            ends = np.cumsum([len(x) if x else 0 for x in b.column("text").to_pylist()])
            at = 0
            while at < b.num_rows:
                past = int(ends[at - 1]) if at else 0
                stop = min(b.num_rows, int(np.searchsorted(ends, past + size - total, "left")) + 1)
                held.append(b.slice(at, stop - at))
                total += int(ends[stop - 1]) - past
                at = stop
                if total >= size:
                    yield out(held)
                    held, total = [], 0
        if held:
            yield out(held)

    return docs_of(docs).mapInArrow(run, "chunk long, tokens long, payload binary")


class _Chunk:
    """The tokens of a chunk: words of each document, then the end."""

    def __init__(self, payload: bytes):
        t = pa.ipc.open_stream(payload).read_all()
        self.ids = t.column("doc_id").to_pylist()
        h, n = word_hashes(t.column("text").to_pylist())
        self.n = n + 1
        self.doc = np.repeat(np.arange(len(n)), self.n)
        self.last = np.cumsum(self.n) - 1
        self.first = self.last - n
        self.word = np.full(len(h) + len(n), END, np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[self.last] = False
        self.word[inner] = h
        self.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in self.ids], bool)
        self.train = ~self.held[self.doc]
        self.by_part = None

    def words(self, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by their parts, those parts, and the place of each token's word among them."""
        if self.by_part:
            return self.by_part
        own, back = np.unique(self.word, return_inverse=True)
        part = (own >> _U(32)) % _U(tries)
        order = np.argsort(_small(part, tries), kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        self.by_part = own[order], part[order], place[back]
        return self.by_part

    def grams(self, number: np.ndarray, tries: int, hot: np.ndarray) -> _Grams:
        """Distinct n-grams of known words by their parts, from the number of each distinct word."""
        numbers = np.unique(np.concatenate([[NONE, BEGIN], number]).astype(np.uint64))
        after = lambda x: np.concatenate([[BEGIN], x[:-1]]).astype(np.uint64)[: len(x)]
        w = np.searchsorted(numbers, number).astype(np.uint64)[self.words(tries)[2]]  # NONE and BEGIN stay
        v = after(w)
        v[self.first] = BEGIN
        u = after(v)
        u[self.first] = BEGIN
        pair = np.flatnonzero((v > NONE) & (w > NONE))
        triple = pair[u[pair] > NONE]
        a, b = np.concatenate([v[pair], u[triple]]), np.concatenate([w[pair], v[triple]])
        c = np.concatenate([np.full(len(pair), NONE, np.uint64), w[triple]])
        at, back = _distinct(_key(a, b, c))
        a, b, c = numbers[a[at]], numbers[b[at]], numbers[c[at]]
        n = np.bincount(back, np.concatenate([self.train[pair], self.train[triple]]), len(at)).astype(np.uint64)
        part = _places(a, b, c, tries, hot)
        order = np.argsort(_small(part, tries), kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        return _Grams(part[order], a[order], b[order], c[order], n[order], pair, place[back[: len(pair)]], triple, place[back[len(pair) :]])


class _Grams(NamedTuple):
    """Parts, words and training counts of distinct n-grams; tokens that end a bigram or trigram, and its place."""

    part: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    n: np.ndarray
    pair: np.ndarray
    of_pair: np.ndarray
    triple: np.ndarray
    of_triple: np.ndarray


def _small(part: np.ndarray, parts: int) -> np.ndarray:
    """In 16 bits where they do: sorting is then by counting."""
    return part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def _runs(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part and where it lies in ordered parts."""
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield int(part[a]), slice(a, b)


def _places(u: np.ndarray, v: np.ndarray, w: np.ndarray, tries: int, hot: np.ndarray) -> np.ndarray:
    """The trie of each n-gram: by its first word, by more words while all before them are hot (sorted numbers)."""

    def is_hot(x: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(x), bool)
        return hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x

    h = mix(u + _U(0x9E6C63D0876A9A47))
    wide = np.flatnonzero(is_hot(u))
    h[wide] = mix(h[wide] ^ v[wide])
    wide = wide[is_hot(v[wide]) & (w[wide] > NONE)]
    h[wide] = mix(h[wide] ^ w[wide])
    return (h % _U(tries)).astype(np.int64)


_REQUEST = "part long, chunk long, block binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, chunks, blocks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(chunks, pa.int64()), pa.array(blocks, pa.binary())], ["part", "chunk", "block"])


def _by_part(requests: DataFrame, answer) -> DataFrame:
    """part, chunk, block: each part's requests together, answered by ``answer(blocks)``; its stats in the row of chunk -1."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks, stats = answer(table.column("block").to_pylist())
        rows = [(part, chunk, block) for chunk, block in zip(table.column("chunk").to_pylist(), blocks)]
        return pa.Table.from_batches([_rows([*rows, (part, -1, stats)])])

    return requests.groupBy("part").applyInArrow(run, _REQUEST)


def _told(answers: DataFrame, name: str) -> DataFrame:
    """All answers to a chunk, which are bounded by its distinct n-grams."""
    return answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "block")).alias(name))


def _in_order(told: list[dict]) -> list[bytes]:
    return [x["block"] for x in sorted(told, key=lambda x: x["part"])]


def _numbered(told: list[dict]) -> np.ndarray:
    """Number and training count of each distinct word of a chunk."""
    return np.concatenate([_expand(b).reshape(2, -1) for b in _in_order(told)], axis=1)


def score(docs: DataFrame, mu: tuple[float, float] = MU, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    name = {x: scratch(spark, x) for x in ("chunks", "words")}
    chunks = stored(chunked(docs, chunk_bytes), "chunks", name["chunks"])
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    tries = max(64, -(-tokens // PER_TRIE))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist()):
                c = _Chunk(payload)
                own, part, back = c.words(tries)
                n, every = np.bincount(back, c.train, len(own)).astype(np.uint64), np.bincount(back, minlength=len(own))
                yield _rows([(p, chunk, _pack(own[x], n[x], every[x])) for p, x in _runs(part)])

    def tell_words(blocks: list[bytes]) -> tuple[list[bytes], bytes]:
        asked = [_unpack(b, 3) for b in blocks]
        own, back = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        add = lambda i: np.bincount(back, np.concatenate([x[i] for x in asked]), len(own)).astype(np.int64)
        counts, every = add(1), add(2)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(own), np.uint64)
        number[order] = np.arange(len(own)).astype(np.uint64) * _U(tries) + (own[0] >> _U(32)) % _U(tries) + _U(WORDS)
        number[counts == 0] = NONE
        large = (every >= max(1, tokens // SHARE)) & (counts > 0) & (own != END)
        sums = [int((counts > 0).sum()), counts.sum(), (counts == 1).sum(), (counts == 2).sum(), counts[own == END].sum(), every.sum()]
        out, at = [], 0
        for x in asked:
            i = back[at : at + len(x[0])]
            out.append(_squeeze(np.concatenate([number[i], counts[i].astype(np.uint64)])))
            at += len(i)
        return out, _squeeze(np.array([*map(int, sums), *np.stack([number[large], every[large].astype(np.uint64)], 1).ravel().tolist()], np.uint64))

    words = stored(_by_part(chunks.select("chunk", "payload").mapInArrow(ask_words, _REQUEST), tell_words), "words", name["words"])
    # The totals and a bounded list of frequent words (no more than 8 * SHARE), from one row of each part.
    V = N = n1 = n2 = texts = total = 0
    large: dict[int, int] = {}
    for r in words.where("chunk = -1").select("block").toLocalIterator():
        x = _expand(bytes(r.block)).tolist()
        V, N, n1, n2, texts, total = V + x[0], N + x[1], n1 + x[2], n2 + x[3], texts + x[4], total + x[5]
        large.update(zip(x[6::2], x[7::2]))
    hot = np.array(sorted([BEGIN, *(w for w, c in large.items() if c * SHARE >= total)]), np.uint64)
    steps = steps_of(N)
    known = stored(chunks.select("chunk", "payload").join(_told(words, "words"), "chunk"), "known")
    for path in name.values():
        discard(spark, path)

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload, told in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), b.column("words").to_pylist()):
                c = _Chunk(payload)
                g = c.grams(_numbered(told)[0], tries, hot)
                yield _rows([(p, chunk, _pack_grams(g.u[x], g.v[x], g.w[x], g.n[x])) for p, x in _runs(g.part)])

    def tell_codes(blocks: list[bytes]) -> tuple[list[bytes], bytes]:
        asked = [_unpack_grams(b) for b in blocks]
        ends = np.cumsum([x.shape[1] for x in asked])
        u, v, w, n = np.concatenate(asked, axis=1)
        del asked
        at, back = _distinct(_key(u, v, w))
        n = np.bincount(back, n, len(at)).astype(np.int64)
        u, v, w = u[at], v[at], w[at]
        k = n > 0
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            trie = Trie(u[k], v[k], w[k], n[k], steps, folder)
            codes = trie.query(u, v, w)[back]
            del trie
        return [zstandard.compress(x.tobytes(), 1) for x in np.split(codes, ends[:-1])], b""

    codes = stored(_by_part(known.mapInArrow(ask_grams, _REQUEST), tell_codes), "codes")
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, words, told in zip(*(b.column(x).to_pylist() for x in ("payload", "words", "codes"))):
                c = _Chunk(payload)
                number, count = _numbered(words)
                g = c.grams(number, tries, hot)
                count = count.astype(np.int64)[c.words(tries)[2]]
                code = np.frombuffer(b"".join(zstandard.decompress(x) for x in _in_order(told or [])), np.uint8)
                least, most = counts_of(code, steps)
                two, three, context = (np.zeros(len(count)) for _ in range(3))
                two[g.pair], context[g.pair] = least[g.of_pair], most[g.of_pair]
                three[g.triple] = least[g.of_triple]
                before = lambda x: np.concatenate([[0], x[:-1]])
                one, context = before(count), before(context)
                one[c.first] = context[c.first] = texts
                base = np.log10((count + 1) / (N + V + 1))
                p = np.where(count > 0, count - d, d * V) / N if N else np.ones(len(count))
                p = (two + mu[0] * p) / (one + mu[0])
                p = np.log10((three + mu[1] * p) / (context + mu[1]))
                add = lambda x: np.bincount(c.doc, x, len(c.ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.n), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(len(c.ids), N)), pa.array(add(base)), pa.array(add(p))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = known.join(_told(codes, "codes"), "chunk", "left").select("payload", "words", "codes")
    return out.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
