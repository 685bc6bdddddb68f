"""Matroska: texts stored as 8-bit PCM tracks, and a parser of EBML files into packet tables.

The writer puts a payload into an audio track (``A_PCM/INT/LIT``, 8 bits, mono, 8 kHz): frames of
``FRAME`` samples, laced by eights into SimpleBlocks, in clusters with cues. The parser walks the
EBML elements (variable-length ids and sizes, unknown sizes included), and gives a row for each
frame: track, timestamp, byte range; Xiph, EBML and fixed-size lacing are split. It reads a
file once, in order, and holds no more than the file and its table of frames.

Edge cases: a null text counts as empty; the payload of an empty text is 64 zero bytes; repeated
rows each get a row; a file that is cut off or not Matroska raises ``ValueError`` in :func:`parse`
and has an empty packet table in :func:`packets`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of

FRAME, LACED, BLOCKS = 512, 8, 64  # samples in a frame, frames in a block, blocks in a cluster
RATE = 8000
UNIT = 64

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
ENTRY, NUMBER, UID, TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
SCALE, DURATION, TIME, SIMPLE, GROUP, BLOCK = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA0, 0xA1
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS, INFO}
TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


def number(n: int, size: int = 0) -> bytes:
    """A variable-length size."""
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(data)) + data


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Body of a block after its flags; kind 0 none, 1 Xiph, 2 fixed-size, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(frames) > 1:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            k = next(k for k in range(1, 9) if abs(b - a) < 1 << 7 * k - 1)
            head += number(b - a + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track."""
    head = element(EBML, uint(VERSION, 1), uint(READ_VERSION, 1), uint(MAX_ID, 4), uint(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ, 2))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)), uint(CHANNELS, 1), uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1), uint(UID, 1), uint(TYPE, 2), element(CODEC, b"A_PCM/INT/LIT"), audio))
    info = element(INFO, uint(SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    parts = [info, tracks]
    at = len(info) + len(tracks)
    cues = []
    step = FRAME * LACED
    for c in range(0, len(payload), step * BLOCKS):
        begin = c * 1000 // RATE
        body = [uint(TIME, begin)]
        for b in range(c, min(len(payload), c + step * BLOCKS), step):
            frames = [payload[i : i + FRAME] for i in range(b, min(len(payload), b + step), FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            body.append(element(SIMPLE, number(1) + struct.pack(">hB", b * 1000 // RATE - begin, 0x80 | kind << 1), lace(frames, kind)))
        cluster = element(CLUSTER, *body)
        cues.append(element(POINT, uint(CUE_TIME, begin), element(POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *parts, element(CUES, *cues))


NUMBERS = {TIME, SCALE, DURATION, NUMBER, TYPE, CHANNELS, DEPTH, FREQUENCY, CUE_TIME, CUE_TRACK, CUE_CLUSTER}


@dataclass
class Movie:
    """What a file holds; ``packets`` are (track, timestamp in ticks, start, length, keyframe)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    clusters: int = 0
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte of the cluster


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, int]:
    """Value, next place and width of a variable-length number; an id keeps its marker."""
    if at >= len(data) or not data[at]:
        raise ValueError("cut off or not EBML")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep else n & (1 << 7 * width) - 1), at + width, width


def _unlace(data: bytes, at: int, stop: int, kind: int) -> list[tuple[int, int]]:
    if kind == 0:
        return [(at, stop - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n > 1:
        size, at, _ = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            more, at, width = _vint(data, at, False)
            size += more - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    elif kind == 2:
        sizes = [(stop - at) // n] * (n - 1)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds its block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def parse(data: bytes) -> Movie:
    """The tracks, cues and packets of a file; a ValueError for any that is damaged."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError("cut off") from e


def _parse(data: bytes) -> Movie:
    """With a list of open masters, no recursion."""
    movie = Movie()
    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("not EBML")
    open_: list[tuple[int, int]] = []  # id, end
    at, segment, cluster, track, cue = 0, 0, 0, {}, [0, 0]
    while at < len(data):
        while open_ and at >= open_[-1][1]:
            open_.pop()
        ident, at, _ = _vint(data, at, True)
        size, at, width = _vint(data, at, False)
        unknown = size == (1 << 7 * width) - 1
        if ident in TOP:  # ends a cluster or segment of unknown size
            while open_ and (open_[-1][0] == CLUSTER or ident == SEGMENT):
                open_.pop()
        stop = len(data) if unknown else at + size
        if stop > len(data):
            raise ValueError("cut off")
        if ident in NUMBERS and stop - at > 8:
            raise ValueError("a number of more than 8 bytes")
        if ident in MASTERS:
            open_.append((ident, stop))
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                movie.clusters += 1
            elif ident == ENTRY:
                track = {}
            continue
        if ident in (SIMPLE, BLOCK):
            number_, p, _ = _vint(data, at, False)
            shift, flags = struct.unpack_from(">hB", data, p)
            for start, n in _unlace(data, p + 3, stop, flags >> 1 & 3):
                movie.packets.append((number_, cluster + shift, start, n, bool(flags & 0x80) if ident == SIMPLE else True))
        elif ident == TIME:
            cluster = int.from_bytes(data[at:stop], "big")
        elif ident == SCALE:
            movie.scale = int.from_bytes(data[at:stop], "big")
        elif ident == DURATION:
            movie.duration = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
        elif ident == NUMBER:
            movie.tracks[int.from_bytes(data[at:stop], "big")] = track
        elif ident in (TYPE, CHANNELS, DEPTH):
            track[{TYPE: "type", CHANNELS: "channels", DEPTH: "depth"}[ident]] = int.from_bytes(data[at:stop], "big")
        elif ident == CODEC:
            track["codec"] = data[at:stop].decode("ascii", "replace")
        elif ident == FREQUENCY:
            track["rate"] = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
        elif ident == CUE_TIME:
            cue = [int.from_bytes(data[at:stop], "big"), 0]
        elif ident == CUE_TRACK:
            cue[1] = int.from_bytes(data[at:stop], "big")
        elif ident == CUE_CLUSTER:
            movie.cues.append((cue[0], cue[1], segment + int.from_bytes(data[at:stop], "big")))
        at = stop
    return movie


def samples(data: bytes, movie: Movie, track: int = 1) -> bytes:
    """The frames of a track, one after the other."""
    return b"".join(data[s : s + n] for t, _, s, n, _ in movie.packets if t == track)


def features(data: bytes, movie: Movie) -> str:
    """Packets, clusters, milliseconds, and of the 8-bit samples: mean, crossings of the middle, peak and mean frame energy."""
    x = np.frombuffer(samples(data, movie), np.uint8).astype(np.int16) - 128
    rest = np.add.reduceat(np.square(x, dtype=np.int64), np.arange(0, len(x), FRAME))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(movie.packets)};clusters={movie.clusters};ms={movie.duration:.0f};mean={int(x.sum(dtype=np.int64)) / len(x) + 128:.4f};crossings={crossings};peak={int(rest.max())};energy={int(rest.sum()) // len(rest)}"


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, zero-filled to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def muxed(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text as a Matroska file."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([write(payload(t)[0]) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs_of(docs).mapInArrow(run, "doc_id long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """The packet table of rows (doc_id, media): doc_id, packet, track, timestamp_ms, start, length, keyframe."""
    names = ["doc_id", "packet", "track", "timestamp_ms", "start", "length", "keyframe"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                try:
                    movie = parse(data or b"")
                except ValueError:
                    continue
                rows = [(doc, i, t, ts * movie.scale / 1e6, s, n, k) for i, (t, ts, s, n, k) in enumerate(movie.packets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track long, timestamp_ms double, start long, length long, keyframe boolean")


def described(docs: DataFrame) -> DataFrame:
    """Every text stored as Matroska, read back and described: sizes, digests, feature string."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                data, n = payload(t)
                data = write(data)
                movie = parse(data)
                back = samples(data, movie)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(data, movie)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs_of(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
