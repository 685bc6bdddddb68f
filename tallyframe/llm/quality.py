"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover the whole text. In a chunk,
each byte is embedded, learned filters slide over the embedded bytes, and each filter's
responses are rectified and max-pooled; a self-match plane adds how often a byte equals the
byte a few places before, the trace of repeated words. The chunk features are combined by their
maximum and mean over the document and a logistic unit gives one probability.

Training (:func:`fit`) uses a bounded sample of labelled documents of the training folds: at most
``cap`` rows, of at most ``room`` bytes together, and of each all chunks. Scoring covers every chunk
of every text. Both go through chunks in blocks, so the net's buffers do not grow with a text's
length; the texts of up to 256 rows, whole, are in memory.

Edge cases: a null or empty text is one chunk of padding and gets a score like any other;
repeated rows each get a row; an empty table gives no rows; with labels of one class only, or
none, every score is the smoothed share of that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, labelled, stored

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, DIM, FILTERS = 8, 4, 6, 24
LAGS = range(2, 25)
BLOCK = 1024  # chunks held at once
WINDOWS = 4  # parts of a chunk in which self-matches are counted
_AT = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
_RAMP = (np.arange(CHUNK) % 256).astype(np.uint8)


def chunks(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer for all texts; of each chunk its start there and its document."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer((b"\0" * CHUNK).join([*raw, b""]), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + CHUNK)[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    doc = np.repeat(np.arange(len(raw)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return data, first[doc] + k * step, doc


class Net:
    """Parameters of the network; plain arrays, so it travels in a task's closure (about 12 KB)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.05, 2 * (FILTERS + 1)).astype(np.float32)
        self.last = np.zeros(1, np.float32)
        self.constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.last]

    def pooled(self, x: np.ndarray, where: bool = False):
        """Features of chunks (rows of bytes): pooled filters, self-match; with ``where`` also the winning places."""
        e = self.embed[x].reshape(len(x), CHUNK * DIM)
        view = np.lib.stride_tricks.as_strided(e, (len(x), len(_AT), WIDTH * DIM), (e.strides[0], STRIDE * DIM * 4, 4))
        z = (view.reshape(-1, WIDTH * DIM) @ self.filters).reshape(len(x), len(_AT), FILTERS)
        top = z.max(1) + self.bias
        # Padding is replaced by a ramp, which never equals itself a few places before.
        real = np.where(x == 0, _RAMP, x)
        tail = real[:, LAGS[-1] :]
        match = np.zeros(len(x), np.float32)
        for lag in LAGS:
            same = (tail == real[:, LAGS[-1] - lag : CHUNK - lag]).reshape(len(x), WINDOWS, -1)
            match = np.maximum(match, np.count_nonzero(same, axis=2).max(1) * np.float32(6 / same.shape[2]))
        out = np.concatenate([np.maximum(top, 0), match[:, None]], 1)
        return (out, z.argmax(1)) if where else out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.last, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        data, start, doc = chunks(texts)
        windows = np.lib.stride_tricks.sliding_window_view(data, CHUNK)
        most = np.full((len(texts), FILTERS + 1), -np.inf, np.float32)
        total = np.zeros((len(texts), FILTERS + 1), np.float64)
        for i in range(0, len(start), BLOCK):
            d = doc[i : i + BLOCK]
            f = self.pooled(windows[start[i : i + BLOCK]])
            cut = np.flatnonzero(np.diff(d, prepend=-1))
            most[d[cut]] = np.maximum(most[d[cut]], np.maximum.reduceat(f, cut))
            total[d[cut]] += np.add.reduceat(f, cut, dtype=np.float64)
        mean = total / np.bincount(doc, minlength=len(texts))[:, None]
        return self.probability(np.concatenate([most, mean.astype(np.float32)], 1)).astype(np.float64)


def train(texts: list[str | bytes | None], y: np.ndarray, steps: int = 320, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the log loss; the gradient of a max-pool goes to the winning window alone."""
    net = Net(seed)
    y = np.asarray(y, np.float32)
    if len(set(y.tolist())) < 2:
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    r = np.random.default_rng(seed)
    data, start, doc = chunks(texts)
    windows = np.lib.stride_tricks.sliding_window_view(data, CHUNK)
    of = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1)
    classes = [np.flatnonzero(y == v) for v in (0, 1)]
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    for t in range(1, steps + 1):
        # Both classes in equal number; their weights restore the shares found.
        pick = np.concatenate([r.choice(c, batch // 2) for c in classes])
        rows = np.concatenate([of[i] for i in pick])
        d = np.repeat(np.arange(len(pick)), [len(of[i]) for i in pick])
        blocks = [slice(i, i + BLOCK) for i in range(0, len(rows), BLOCK)]
        told = [net.pooled(windows[start[rows[k]]], True) for k in blocks]
        f, where = (np.concatenate(x) for x in zip(*told))
        first = np.flatnonzero(np.diff(d, prepend=-1))
        count = np.diff(np.append(first, len(d)))
        top = np.maximum.reduceat(f, first)
        doc_f = np.concatenate([top, np.add.reduceat(f, first) / count[:, None]], 1)
        p = net.probability(doc_f)
        g = (p - y[pick])[:, None] / len(pick)
        g_f = g * net.out
        g_chunk = g_f[d, FILTERS + 1 :] / count[d, None] + g_f[d, : FILTERS + 1] * (f == top[d])
        g_conv = (g_chunk * (f > 0))[:, :FILTERS]
        g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
        filters = net.filters.reshape(WIDTH, DIM, FILTERS)
        for k in blocks:
            win = (where[k] * STRIDE)[:, :, None] + np.arange(WIDTH)  # chunk, filter, byte
            seen = np.take_along_axis(windows[start[rows[k]]][:, None, :], win, 2)
            part = net.embed[seen]  # chunk, filter, byte, dim
            g_filters += np.einsum("cf,cfwd->wdf", g_conv[k], part).reshape(WIDTH * DIM, FILTERS)
            g_part = np.einsum("cf,wdf->cfwd", g_conv[k], filters)
            g_embed += np.stack([np.bincount(seen.ravel(), g_part[..., j].ravel(), 256) for j in range(DIM)], 1)
        grads = [g_embed + 1e-5 * net.embed, g_filters + 1e-4 * net.filters, g_conv.sum(0), (g * doc_f).sum(0) + 1e-4 * net.out, g.sum(0)]
        for q, grad, a, b in zip(net.parts(), grads, m, v):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            q -= (rate * min(1, 3 * (1 - t / (steps + 1))) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, cap: int = 3000, room: int = 64 << 20, label: str = "quality") -> Net:
    """Train on the driver on a sample of at most ``cap`` labelled documents of at most ``room`` bytes together, whole texts all.

    Documents that the room has no place for are left out as a whole, in order of a hash of their ids.
    """
    rows = stored(labelled(docs, labels, label, cap), "labelled")
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, used = [], 0
    for r in sizes:
        if used + r.n <= room:
            taken.append(r.doc_id)
            used += r.n
    if len(taken) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(taken))
    sample = sorted((r.doc_id, r.text or "", r.y) for r in rows.select("doc_id", "text", "y").collect())
    return train([t for _, t, _ in sample], np.array([y for *_, y in sample]))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            out = [net.score(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cap: int = 3000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    out = score(docs, fit(docs, labels, cap))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, cap: int = 3000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, that score at least the threshold."""
    net = fit(docs, labels, cap)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        t = [x if isinstance(x, str) else None for x in text]
        return pd.Series(np.concatenate([net.score(t[i : i + 256]) for i in range(0, len(t), 256)] or [np.zeros(0)]))

    return docs.where(scored("text") >= threshold)
