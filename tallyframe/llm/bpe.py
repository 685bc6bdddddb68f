"""Byte-level BPE as a bounded-lookahead streaming transducer.

Every text goes through a :class:`Transducer`, fed block after block (most texts are one block). It cuts its input into
words; tokens are stable, and leave, by one of two rules. No merge crosses the end of a word, so
once the three characters after a word are seen, all its tokens are. Inside a word,
``Model.lookahead`` is computed from the merge list: the farthest that unknown bytes to the right
can change where tokens end. A boundary that far from the end of the bytes seen so far is stable,
so a word of any length passes a window of fixed size (:class:`Run`): merge the window, emit the
tokens that end before the lookahead, keep the rest. The state is a bounded tail of text or of
bytes. Words already merged are remembered in a table of bounded size; those that are new in a few
blocks are merged together, one rule a word and round, as arrays.

Decoding is a state machine from bytes to text (:class:`Utf8Machine`), whose state is the
unfinished character.

Edge cases: a null text counts as empty; an empty text has no ids; the added tokens of the
vocabulary file (``<|endoftext|>``) are matched in the text first, as the file asks; decoding
replaces bytes that are not UTF-8 by U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, left

BLOCK = 1 << 16  # characters cut into words at once
SHORT = 64  # bytes: longer words go through the windowed encoder
MEMO = 600_000  # words remembered, in two halves
GROUP = 1 << 21  # characters whose new words are merged together, about

_NONE = 1 << 30
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1

_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = "A-Za-zÀ-ÖØ-öø-ʯ"
_PLAIN = re.compile(f"[^\x00-\x7f{_LATIN}]")


def _cutter(module, letters: str, digits: str, spaces: str):
    return module.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


_FAST = _cutter(re, _LATIN, "0-9", "\\t-\\r ")


@functools.cache
def _general():
    import regex

    return _cutter(regex, r"\p{L}", r"\p{N}", _SPACES)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """A vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.added else bytes(chars[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.made))
            self.pairs.append((vocab[a], vocab[b]))
            self.made.append(vocab[a + b])
        self.slots = self._pair_slots()
        self.byte_ranks = np.array([self.rank.get(a << 20 | b, _NONE) for a in self.byte_id for b in self.byte_id], np.int32)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.lookahead = self._lookahead()
        self.window = 4 * self.lookahead + 4096

    def _lookahead(self) -> int:
        """Bytes from the end of a text beyond which its token boundaries are final.

        Rules act in order of rank. A rule (u, v) carries doubt from the start of v to the start
        of u only if v begins where an earlier rule (u', v') brought doubt, so v starts with u'.
        The longest such chain, in bytes of the left parts, bounds the doubt.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in self.pairs:
            u, v = self.bytes[a], self.bytes[b]
            far = len(u) + max((reach.get(v[:n], 0) for n in range(1, len(v) + 1)), default=0)
            if far > reach.get(u, 0):
                reach[u] = far
                most = max(most, far)
        return most + max(map(len, self.bytes))

    def _pair_slots(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open-addressing table of the ranked pairs, for lookups of whole arrays: keys, ranks, longest probe."""
        bits = max(8, len(self.rank).bit_length() + 3)
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        probe = 1
        for pair, r in self.rank.items():
            at = (pair * _ODD & _MASK) >> (64 - bits)
            n = 1
            while keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
                n += 1
            keys[at], ranks[at] = pair, r
            probe = max(probe, n)
        return keys, ranks, probe

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where no rule joins it or an id is missing (-1)."""
        keys, ranks, probe = self.slots
        shift = np.uint64(65 - len(keys).bit_length())
        pair = left.astype(np.int64) << 20 | right
        at = ((pair.view(np.uint64) * np.uint64(_ODD)) >> shift).astype(np.int64)
        out = np.full(pair.shape, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for n in range(probe):
            slot = (at[todo] + n) & (len(keys) - 1)
            found = keys[slot] == pair[todo]
            out[todo[found]] = ranks[slot[found]]
            todo = todo[~found & (keys[slot] >= 0)]
            if not len(todo):
                break
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """:meth:`merge` of many short words at once, as bytes: one rule application a word and round.

        A column is a word, a row a place in it; the last row stands for "none". Places are linked, so
        a round touches the merged places and their neighbours alone. A pair's key is its rank, then its
        place, so that a column's least key is the rule to apply.
        """
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        made, byte_id = np.array([*self.made, 0], np.int32), np.array(self.byte_id, np.int32)
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 20), (20, 36), (36, SHORT)):
            cols = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(cols):
                continue
            raw = np.frombuffer(b"".join([words[i].ljust(high, b"\0") for i in cols.tolist()]), np.uint8).reshape(-1, high).T
            n, place = len(cols), np.arange(high + 1)
            ids = np.full((high + 1, n), -1, np.int32)
            ids[:high] = np.where(place[:high, None] < sizes[cols], byte_id[raw], -1)
            keys = np.full((high + 1, n), _NONE, np.int32)
            first = self.byte_ranks[raw[:-1].astype(np.int32) << 8 | raw[1:]]
            keys[: high - 1] = np.where((ids[1:high] >= 0) & (first < _NONE), first << 6 | place[: high - 1, None], _NONE)
            after = np.repeat(np.minimum(place + 1, high).astype(np.uint8)[:, None], n, 1)
            before = np.repeat(np.where(place > 0, place - 1, high).astype(np.uint8)[:, None], n, 1)
            while True:
                best = keys.min(0)
                c = np.flatnonzero(best < _NONE)
                if len(c) <= 0.7 * n:  # the finished words leave
                    rest = best == _NONE
                    done = ids[:, rest].T
                    ends = np.cumsum((done >= 0).sum(1)) * 4
                    flat = done[done >= 0].tobytes()
                    for i, a, b in zip(cols[rest].tolist(), [0, *ends.tolist()], ends.tolist()):
                        out[i] = flat[a:b]
                    if not len(c):
                        break
                    cols, best = cols[c], best[c]
                    ids, keys, after, before = (x.take(c, 1) for x in (ids, keys, after, before))  # in C order, so that ravel is a view
                    n, c = len(c), np.arange(len(c))
                else:
                    best = best[c]
                i, k, f, t = ids.ravel(), keys.ravel(), after.ravel(), before.ravel()
                j = best & 63
                at = j * n + c
                gone = f[at].astype(np.int64) * n + c
                then = f[gone]
                right, prior = then.astype(np.int64) * n + c, t[at]
                left = prior.astype(np.int64) * n + c
                new = made[best >> 6]
                i[at], i[gone] = new, -1
                k[gone] = _NONE
                f[at], t[right] = then, j
                ranks = self._ranks(np.concatenate([new, i[left]]), np.concatenate([i[right], new]))
                k[np.concatenate([at, left])] = np.where(ranks < _NONE, ranks << 6 | np.concatenate([j, prior]), _NONE)
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, the leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = self.made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (q := rank(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def stream(self, parts: Iterator[bytes]) -> Iterator[list[int]]:
        """Encode one word given in parts; each list of ids is final when it is yielded."""
        run = Run(self)
        for part in parts:
            yield run.push(part)
        yield run.close()


class Run:
    """One word, fed in parts; tokens leave once the lookahead behind them is full."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def push(self, part: bytes) -> list[int]:
        m, out = self.model, []
        self.held += part
        at = 0
        while len(self.held) - at >= m.window:
            end = 0
            for i in m.merge(self.held[at : at + m.window]):
                if end + len(m.bytes[i]) > m.window - m.lookahead:
                    break
                end += len(m.bytes[i])
                out.append(i)
            at += end
        self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        return self.model.merge(self.held) if self.held else []


class Transducer:
    """Text in blocks to words, all of whose tokens are stable, and to the stable ids of a word that is still open."""

    BEHIND = 3  # characters after a word that can change where it ends

    def __init__(self, model: Model):
        self.model = model
        self.held = ""  # text not cut yet
        self.run: Run | None = None  # the open word
        self.more: re.Pattern | None = None  # what goes on with it
        self.mark = max(map(len, model.added), default=1) - 1

    def feed(self, text: str, final: bool = False) -> list[str | bytes]:
        """Words (str) and ids (bytes, little-endian unsigned 32-bit integers) that are final."""
        out: list[str | bytes] = []
        buf, self.held = self.held + text, ""
        if self.model.special is not None:
            while m := self.model.special.search(buf):
                self._cut(buf[: m.start()], True, out)
                out.append(self.model.added[m[0]].to_bytes(4, "little"))
                buf = buf[m.end() :]
        if final:
            self._cut(buf, True, out)
            return out
        # An added token may have begun in the last characters.
        keep = next((n for n in range(min(self.mark, len(buf)), 0, -1) if any(x.startswith(buf[-n:]) for x in self.model.added)), 0)
        self._cut(buf[: len(buf) - keep], False, out)
        self.held += buf[len(buf) - keep :]
        return out

    def _cut(self, buf: str, final: bool, out: list[str | bytes]) -> None:
        cut = _FAST if _PLAIN.search(buf) is None else _general()
        at = 0
        while at < len(buf) or self.run is not None:
            if self.run is not None:
                end = self.more.match(buf, at).end()
                whole = end == len(buf) and not final
                # Of white space before a word, or the end of the block, the last sign is left over.
                stop = max(at, end - 1) if self.more is _blank() and (whole or end < len(buf)) else end
                ids = self.run.push(buf[at:stop].encode("utf-8", "surrogatepass"))
                if not whole:
                    ids += self.run.close()
                    self.run = None
                out.append(np.array(ids, "<u4").tobytes())
                at = stop
                if whole:
                    break
                continue
            sure, last = len(buf) if final else len(buf) - self.BEHIND, at
            if sure == len(buf):
                out += cut.findall(buf, at)
                return
            for m in cut.finditer(buf, at):
                if m.end() > sure:
                    break
                out.append(m[0])
                last = m.end()
            at = last
            if len(buf) - at <= BLOCK:
                break
            # One word fills a block: it is encoded while it is read.
            self.run, self.more = Run(self.model), next(x for x in _runs() if x.match(buf, at))
            lead = buf[at] == " " and self.more is not _blank()
            if lead:
                self.run.push(b" ")
                at += 1
            self.more = self.more if self.more is _blank() else _bare(self.more)
        self.held = buf[at:]


@functools.cache
def _runs() -> tuple:
    """What a word that fills a block can be: letters, digits, other signs (all with a blank before), white space."""
    import regex

    return tuple(regex.compile(p) for p in (r" ?\p{L}+", r" ?\p{N}+", rf" ?[^{_SPACES}\p{{L}}\p{{N}}]+", f"[{_SPACES}]*"))


def _blank():
    return _runs()[3]


@functools.cache
def _bare(run):
    """A run's pattern without the blank before, or empty."""
    import regex

    return regex.compile(run.pattern.removeprefix(" ?")[:-1] + "*")


class Encoder:
    """Text to ids."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.memo: dict[str, bytes] = {}  # word to its ids as little-endian unsigned 32-bit integers
        self.old: dict[str, bytes] = {}

    def _blocks(self, texts: Iterator[str | None]) -> Iterator[tuple[bytes, bool]]:
        """Ids of each block, and whether its text ends with it. Some blocks are fed before their new words are merged at once.

        A block's words are looked up while they are fresh; what is held of it are ids, its gaps and what belongs there.
        """
        held: list[tuple[list[bytes | None], list[int], list[str | bytes], bool]] = []
        size = 0
        for text in texts:
            text, t = text or "", Transducer(self.model)
            for at in range(0, max(1, len(text)), BLOCK):
                last = at + BLOCK >= len(text)
                items = t.feed(text[at : at + BLOCK], last)
                ids = list(map(self.memo.get, items))
                gaps = [i for i, x in enumerate(ids) if x is None]
                held.append((ids, gaps, [items[i] for i in gaps], last))
                size += min(BLOCK, len(text) - at)
                if size >= GROUP:
                    yield from self._known(held)
                    held, size = [], 0
        yield from self._known(held)

    def _known(self, held: list[tuple[list[bytes | None], list[int], list[str | bytes], bool]]) -> Iterator[tuple[bytes, bool]]:
        found = self._found({w for _, _, words, _ in held for w in words if type(w) is str})
        for ids, gaps, words, last in held:
            for i, w in zip(gaps, words):
                ids[i] = w if type(w) is bytes else found[w]
            yield b"".join(ids), last

    def _found(self, new: set[str]) -> dict[str, bytes]:
        """The ids of words that are not in the newer half of the memory, which then keeps the short ones."""
        if len(self.memo) + len(new) > MEMO // 2:  # words that come again stay; others go, and are merged again when they come
            self.old, self.memo = self.memo, {}
        old = self.old
        found = {w: old.pop(w) for w in new if w in old}
        words = [w for w in new if w not in found]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [len(r) <= SHORT for r in raw]
        found.update(zip(compress(words, short), self.model.merge_many(list(compress(raw, short)))))
        self.memo.update(islice(found.items(), max(0, MEMO // 2 - len(self.memo))))
        if not all(short):
            for w, r in zip(words, raw):
                if len(r) > SHORT:
                    run = Run(self.model)
                    found[w] = np.array(run.push(r) + run.close(), "<u4").tobytes()
        return found

    def many(self, texts: list[str | None]) -> Iterator[Iterator[bytes]]:
        """Of each text its ids as little-endian unsigned 32-bit integers, block after block; to be read to the end, one after the other."""
        blocks = self._blocks(iter(texts))

        def own() -> Iterator[bytes]:
            for ids, last in blocks:
                yield ids
                if last:
                    return

        for _ in texts:
            yield own()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(next(self.many([text]))), "<u4")


class Utf8Machine:
    """Bytes to text, block after block; the state is the beginning of a character that later bytes may finish."""

    #: First and last second byte of the leads that restrict it.
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self):
        self.open = b""

    def _unfinished(self, data: bytes) -> int:
        for n, byte in enumerate(data[: -min(4, len(data) + 1) : -1], 1):
            if 0x80 <= byte < 0xC0:
                continue
            size = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 1
            low, high = self.SECOND.get(byte, (0x80, 0xBF))
            return n if n < size and (n < 2 or low <= data[1 - n] <= high) else 0
        return 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.open + data
        n = 0 if final else self._unfinished(data)
        self.open = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")


class Decoder:
    def __init__(self, model: Model):
        self.table = model.bytes

    def pieces(self, blocks: Iterator[bytes]) -> Iterator[str]:
        machine = Utf8Machine()
        for block in blocks:
            yield machine.feed(b"".join(map(self.table.__getitem__, np.frombuffer(block, "<u4").tolist())))
        yield machine.feed(b"", True)

    def decode(self, ids) -> str:
        return "".join(self.pieces(iter([np.asarray(ids, "<u4").tobytes()])))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary; it stays until a task of another operator frees the worker."""
    left(encoder.cache_clear)
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long) of every text."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            ids = [np.frombuffer(b"".join(x), "<u4") for x in e.many(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs_of(docs).mapInArrow(run, "doc_id long, ids array<long>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    def run(batches):
        d = Decoder(encoder(path).model)
        for b in batches:
            text = [None if x is None else d.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode it again, block by block; digests of both, one row a document."""

    def run(batches):
        e = encoder(path)
        d = Decoder(e.model)
        for b in batches:
            n, ids, texts = [], [], []
            for pieces in e.many(b.column("text").to_pylist()):
                seen, size = hashlib.sha256(), 0

                def told(pieces=pieces, seen=seen):
                    nonlocal size
                    for block in pieces:
                        seen.update(block)
                        size += len(block) // 4
                        yield block

                back = hashlib.sha256()
                for piece in d.pieces(told()):
                    back.update(piece.encode())
                n.append(size)
                ids.append(seen.hexdigest())
                texts.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
