"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role`` and a line end, its text, ``<|im_end|>`` and a line end. Control
strings of common templates inside a text are escaped: each backslash is doubled, and a backslash
goes behind the first character of each control string, so none is left in it; dropping the first
of two characters where it is a backslash restores the text. A role's line ends are escaped too.

Rows are dealt by conversation and sorted, and pass a task in blocks of bounded size. In a block,
numpy finds the places where a backslash goes in, sums segment lengths to offsets, turns these into
scatter indices, and copies headers, texts and marks into one preallocated buffer, which becomes
the Arrow column. A conversation is one row (a piece), or several where it is larger than a block;
the spans of the loss mask (the texts of one role) are code points of its piece.

:func:`read_back` parses the pieces again and digests what it finds; it keeps hash states only. The
digest of a conversation takes its turns in order, so one task passes them, in bounded memory.

Edge cases: a null text or role counts as empty; turns are in order of turn (null first), then role,
then text, so repeated rows are repeated turns; rows with a null conversation id are one
conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 8 << 20  # bytes of text put together at once

# Control strings of common chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_START, _END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile("(?=(" + "|".join(map(re.escape, CONTROLS)) + "))")
_TURN = re.compile(re.escape(_START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(_END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_BACKSLASH = 0x5C


def escaped(text: str) -> str:
    """``text`` without control strings, reversibly."""
    at = {m.start() + 1 for m in _CONTROL.finditer(text)} | {i for i, c in enumerate(text) if c == "\\"}
    return "".join("\\" + c if i in at else c for i, c in enumerate(text))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escapes(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the concatenated texts before which a backslash goes; text i ends before byte ``ends[i]``."""
    found = [np.flatnonzero(buf == _BACKSLASH)]
    for control in CONTROLS:
        raw = control.encode()
        at = np.flatnonzero(buf[: max(0, len(buf) - len(raw) + 1)] == raw[0])
        for k, c in enumerate(raw[1:], 1):
            at = at[buf[at + k] == c]
        at = at[at + len(raw) <= ends[np.searchsorted(ends, at, "right")]]
        found.append(at + 1)
    return np.unique(np.concatenate(found))


def assemble(roles: list[str], role: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns as one buffer: bytes, where each turn begins (and the end), where its escaped text begins and ends."""
    heads = [(_START + escaped(r).replace("\n", "\\\n") + "\n").encode("utf-8", "surrogatepass") for r in roles]
    tail = np.frombuffer(_END.encode(), np.uint8)
    head = np.array([len(h) for h in heads], np.int64)[role]
    ends = np.cumsum(size)
    extra = escapes(text, ends)
    added = np.diff(np.searchsorted(extra, ends), prepend=0)
    turns = np.concatenate([[0], np.cumsum(head + size + added + len(tail))])
    out = np.empty(int(turns[-1]), np.uint8)
    begin = turns[:-1] + head
    stop = begin + size + added
    # A text's bytes move by where its turn has it, and by the backslashes up to them.
    shift = np.repeat(begin - (ends - size) - (np.searchsorted(extra, ends) - added), size)
    step = np.ones(len(text), np.int64)
    step[extra] += 1
    to = np.cumsum(step) - 1 + shift
    out[to] = text
    out[to[extra] - 1] = _BACKSLASH
    out[stop[:, None] + np.arange(len(tail))] = tail
    for r, h in enumerate(heads):
        of = np.flatnonzero(role == r)
        out[turns[of][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    return out, turns, begin, stop


_PIECES = "conv_id long, piece long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>"


def _pieces(loss: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for b in batches:
            text = b.column("text").cast(pa.binary())
            off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            coded = b.column("role").dictionary_encode()
            roles, role = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            conv = b.column("conv_id")
            keys, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(conv):
                stop = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
                out, turns, begin, end = assemble(roles, role[at:stop], raw[off[at] : off[stop]], np.diff(off[at : stop + 1]))
                k, z = keys[at:stop], null[at:stop]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (z[1:] != z[:-1])]))
                bounds = np.append(first, stop - at)
                point = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before a byte
                names = [None if z[i] else int(k[i]) for i in first]
                places = []
                for name in names:
                    piece = piece + 1 if name == last else 0
                    last = name
                    places.append(piece)
                masked = role[at:stop] == (roles.index(loss) if loss in roles else -1)
                base = np.repeat(point[turns[first]], np.diff(bounds))
                spans = pa.StructArray.from_arrays([pa.array((point[begin] - base)[masked]), pa.array((point[end] - base)[masked])], ["start", "stop"])
                inside = np.concatenate([[0], np.cumsum(masked)])[bounds].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(turns[bounds].astype(np.int32)), pa.py_buffer(out)]),
                        pa.ListArray.from_arrays(pa.array(inside), spans),
                    ],
                    names=["conv_id", "piece", "n_turns", "formatted", "loss"],
                )
                at = stop

    return run


def formatted(turns: DataFrame, loss: str = "assistant") -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss: each conversation's pieces, in order, in one partition."""
    small_batches(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_pieces(loss), _PIECES)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None  # conversation, turns, their digest, loss characters, their digest, characters

    def closed(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*[[c, n, d.hexdigest(), k, m.hexdigest(), f] for c, n, d, k, m, f in rows])) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in _DIGESTS.split(", ")])

    for b in batches:
        done = []
        for conv, piece, out, loss in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), b.column("formatted"), b.column("loss").to_pylist()):
            out = out.as_py()
            if piece == 0:
                if now is not None:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            while m := _TURN.match(out, at):
                now[2].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode("utf-8", "surrogatepass"))
                now[1] += 1
                at = m.end()
            if at != len(out):
                raise ValueError(f"conversation {conv}: no turn at character {at} of piece {piece}")
            for span in loss:
                text = unescaped(out[span["start"] : span["stop"]])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "surrogatepass"))
            now[5] += len(out)
        yield closed(done)
    if now is not None:
        yield closed([now])


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the output of :func:`formatted`."""
    return pieces.mapInArrow(_digests, _DIGESTS)


def read_back_stored(pieces: DataFrame) -> DataFrame:
    """:func:`read_back` of a stored table, whose pieces are brought together and in order first."""
    return read_back(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece"))
