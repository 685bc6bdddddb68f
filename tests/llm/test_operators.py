"""Each operator against a brute-force version, a round trip or held-out accuracy, on the odd rows of ``docs``."""

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import ann, bpe, common, lm, media, minhash, packing, pii, quality, queries, secrets, toxicity
from tallyframe.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bpe_matches_the_library(docs, rows, empty, tokenizer):
    got = counted(bpe.round_trip(docs, vocabulary()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    assert counted(back, "doc_id", "text") == collections.Counter((i, t or "") for i, t in rows)
    assert bpe.round_trip(empty, vocabulary()).count() == 0


def test_bpe_streams_in_bounded_windows():
    m = bpe.encoder(vocabulary()).model
    r = random.Random(2)
    raw = bytes(r.choice(b"abc xyz,.") for _ in range(5 * m.window))
    parts = [raw[i : i + 777] for i in range(0, len(raw), 777)]
    assert [i for x in m.stream(iter(parts)) for i in x] == m.merge(raw)


def test_packing_is_whole_and_full(docs, rows, empty, tokenizer):
    got = packing.pack(docs, vocabulary()).collect()
    ids_of = collections.defaultdict(list)
    for i, t in rows:
        ids_of[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in got:
        sequences[r.sequence_id].append(r)
        # The piece's digest is that of these ids of a document of the id and size.
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids_of[r.doc_id])
        pieces[r.doc_id, r.doc_tokens].update(range(r.start, r.start + r.length))
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert (n := sum(r.length for r in s)) <= 1024 and (n == 1024 or n & (n - 1) == 0)
    # Each id of each document (of as many as share an id and a size) lies in one piece.
    sizes = collections.Counter((i, len(x)) for i, xs in ids_of.items() for x in xs)
    assert set(pieces) == set(sizes)
    assert all(c == dict.fromkeys(range(n), sizes[i, n]) for (i, n), c in pieces.items())
    assert packing.pack(empty, vocabulary()).count() == 0


def test_differencing_balances_and_raises_the_count():
    r = random.Random(1)
    sizes = [r.randint(1, 600) for _ in range(200)]
    parts = packing.karmarkar_karp(sizes, 20)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) <= 20
    assert all(sum(sizes[i] for i in p) <= 1000 for p in packing.windows(sizes, 1000))
    # Two windows would do for the sum; differencing can't, so the count rises.
    assert len(packing.windows([600, 600, 600], 1000)) == 3
    p = packing._Packer(100, 4, 0)
    for i in range(9):
        p.add(i, np.full(60, i, np.uint32))
    p.flush(True)
    full = collections.Counter()
    for row in p.rows:
        full[row[5]] += row[2]
    assert sorted(full.values(), reverse=True) == [100] * 5 + [32, 8]


def brute_links(rows):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_duplicates(docs, rows, empty):
    got = minhash.link(docs).collect()
    assert len(got) == len(rows)
    want = brute_links(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert minhash.link(empty).count() == 0


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIDE", 8)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"v{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_links(rows)


def test_buckets_of_several_components_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIDE", 5)
    monkeypatch.setattr(minhash, "SHINGLES", 2500)
    r = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):  # a template whose copies are often less alike than is asked for
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 5, 6])):
            w[r.randrange(150)] = f"v{i % 9}x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    want = brute_links(rows)
    assert 3 < len({c for _, c in want.values()}) < 110
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_rows_of_one_document_connect_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (8, b), (9, c), (9, a + " z"), (7, c)]
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 3, False), (9, 3, False), (9, 3, False)]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 50, 3000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        assert (minhash.sketch(a) == minhash.sketch(a[::-1])).all()
        b = np.concatenate([a, np.unique(r.integers(0, 2**63, n).astype(np.uint64))])
        assert abs((minhash.sketch(a) == minhash.sketch(np.unique(b))).mean() - 0.5) < 0.25


def test_language_model(docs, rows, empty, monkeypatch):
    got = lm.score(docs, chunk_bytes=20000).collect()
    tok = [(i, WORD.findall(lower(t)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, x in tok if not held(i) for w in x)
    N, V = sum(c.values()), len(c)
    grams = collections.Counter(x[k - n : k] for i, y in tok if not held(i) for x in [("<s>", "<s>", *y)] for n in (2, 3) for k in range(3, len(x) + 1))
    n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)
    texts = sum(not held(i) for i, _ in tok)
    want = []
    for i, x in tok:
        score = 0.0
        for u, v, w in zip(["<s>", "<s>", *x], ["<s>", *x], x):
            one = texts if v == "<s>" else c[v]
            two = texts if v == "<s>" else grams[u, v]
            p = (c[w] - d) / N if c[w] else d * V / N
            p = (grams[v, w] + lm.MU[0] * p) / (one + lm.MU[0])
            score += math.log10((grams[u, v, w] + lm.MU[1] * p) / (two + lm.MU[1]))
        want.append((i or -1, held(i), len(x), sum(c[w] > 0 for w in x), N, sum(math.log10((c[w] + 1) / (N + V + 1)) for w in x), score))
    for a, b in zip(sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, -b[5])
        assert -0.1 * b[2] - 1e-9 <= a[6] - b[6] <= 1e-6 * max(1, -b[6])  # quantised down, by at most a step a code
    assert lm.score(empty).count() == 0


def test_elias_fano_and_trie(tmp_path):
    r = np.random.default_rng(5)
    for n in (0, 1, 5, 4000, 40000):
        x = np.sort(r.integers(0, 1 << 50, n).astype(np.uint64))
        e = lm.EliasFano(*lm.EliasFano.encode(x))
        assert (e[np.arange(n)] == x).all()
        y = np.concatenate([x[: n // 2], r.integers(0, 1 << 50, 50).astype(np.uint64)])
        hit, at = e.find(y, np.zeros(len(y), np.int64), np.full(len(y), n))
        assert (hit == np.flatnonzero(np.isin(y, x))).all() and (x[at] == y[hit]).all() and (at == np.searchsorted(x, y[hit])).all()
        assert not len(e.find(y, np.full(len(y), n), np.full(len(y), n))[0])
    u, v, w = (r.integers(0, k, 9000).astype(np.uint64) for k in (300, 60, 40))
    _, at = np.unique(lm._key(u, v, w), return_index=True)
    u, v, w = u[at], v[at], w[at]
    have = r.random(len(u)) < 0.5
    count = r.integers(1, 64, len(u))
    trie = lm.Trie(u[have], v[have], w[have], count[have], lm.steps_of(10**6), str(tmp_path))
    assert (trie.query(u, v, w) == np.where(have, count, 0)).all()
    assert (trie.query(u, v, w + np.uint64(64)) == 0).all()
    few, many = lm.counts_of(lm.code_of(np.arange(10**6), lm.steps_of(10**6)), lm.steps_of(10**6))
    assert (few <= np.arange(10**6)).all() and (np.arange(10**6) <= many).all() and (many <= 1.1 * few + 1).all()


def test_keys_keep_the_order_of_triples():
    r = np.random.default_rng(6)
    for top in (9, 1 << 22, 1 << 40):
        x = r.integers(0, top, (3, 3000)).astype(np.uint64)
        x[:, 2000:] = x[:, :1000]
        assert (x[:, np.argsort(lm._key(*x), kind="stable")] == x[:, np.lexsort(x[::-1])]).all()
        assert len(np.unique(lm._key(*x))) == len(np.unique(x, axis=1).T)
        x = np.unique(np.concatenate([x, x + np.array([[0], [0], [1]], np.uint64), x + np.array([[0], [2], [0]], np.uint64)], axis=1), axis=1)
        assert (lm._unpack_grams(lm._pack_grams(*x, x[2])) == np.concatenate([x, x[2:]])).all()


def brute_pii(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for k, (p, ok) in enumerate(tests):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if ok(m)]
    return tuple(sorted(out))


def test_personal_data(spark, docs, rows, empty):
    r = random.Random(5)
    odd = [(1000 + i, "".join(r.choice(["1", "23", "4111 1111 1111 1111", ".", "a", "@", "-", " ", "+", "(", "𝒳", "_", "%", "255", "\n"]) for _ in range(r.randint(0, 50)))) for i in range(400)]
    odd += [(2000, "1 " * 3000), (2001, "a." * 20000 + "@" + "b." * 20000), (2002, "x@y.z_q@w.e")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = pii.scan(table).collect()
    base = collections.Counter((x.doc_id, tuple(map(tuple, x.base))) for x in got)
    assert base == collections.Counter((i, brute_pii(t)) for i, t in [*rows, *odd])
    assert all(set(map(tuple, x.base)) <= set(map(tuple, x.spans)) for x in got)
    assert pii.scan(empty).count() == 0


def test_personal_data_context_discovers_unseen_identifiers(spark):
    r = random.Random(8)
    rows = [(i, f"plain words here {r.random():.0f} tel: +1 (619) 555-{i:04d} and more words") for i in range(40)]
    rows += [(100 + i, f"other words tel: 0619/555{i:03d} and more") for i in range(3)]
    got = {x.doc_id: x for x in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in got[101].spans] == [pii.KINDS.index("context")]
    assert not got[101].base


def test_secrets(spark, docs, rows, empty, tmp_path):
    def brute(t):
        t, out = t or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            if len(m[2]) >= 6:
                out.append((m.start(), 0, m.end(), "assign"))
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))

    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    found = secrets.scan(docs, ledger)
    base = F.filter("spans", lambda x: x.kind.isin(*secrets.BASE))
    want = collections.Counter((i, brute(t)) for i, t in rows)
    assert counted(found.select("doc_id", secrets.joined(base).alias("s")), "doc_id", "s") == want
    blobs = len({t or "" for _, t in rows})
    assert ledger.rows().count() == blobs
    again = secrets.scan(docs, ledger)
    assert again.count() == len(rows) and ledger.rows().count() == blobs  # nothing was scanned twice
    more = spark.createDataFrame([(1, "password=abcdef1"), (2, "a new text"), (3, rows[0][1])], "doc_id long, text string")
    assert secrets.scan(more, ledger).count() == 3 and ledger.rows().count() == blobs + 2 - ("password=abcdef1" in {t for _, t in rows})
    secrets.scan(more, ledger, secrets.RULES[:1])
    assert ledger.rows().where(F.col("rules") == secrets.version(secrets.RULES[:1])).count() == 3
    odd = docs.withColumnsRenamed({"blob": "__text", "band": "spans", "one": "row", "lang": "a.b"})
    clean = secrets.redact(odd, ledger)
    assert clean.columns == odd.columns and clean.count() == len(rows)
    assert {r["__text"] for r in clean.collect()} == {"x"} and {r["spans"] for r in clean.collect()} == {7}
    assert counted(clean.where("text is null"), "doc_id") == collections.Counter((i,) for i, t in rows if t is None)
    assert not any(brute(r.text) for r in clean.collect())
    assert secrets.scan(empty, ledger).count() == 0 and secrets.redact(empty, ledger).count() == 0
    # The registered query's columns, and a ledger that the session names.
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.tallyframe.secretLedger", str(tmp_path / "ledger"))
    got = queries.op9_secrets(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.tallyframe.secretLedger")
    told = lambda s: (*(sum(x.startswith(k) for x in s.split(",")) for k in secrets.BASE), hashlib.sha256(s.encode()).hexdigest())
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == collections.Counter((i, *told(s)) for (i, s), n in want.items() for _ in range(n))


def test_matroska(docs, rows, empty):
    got = {(r.doc_id, r.payload_sha256, r.n_bytes) for r in media.described(docs).collect()}
    assert got == {(i, hashlib.sha256(media.payload(t)[0]).hexdigest(), len((t or "").encode())) for i, t in rows}
    r = random.Random(3)
    for kind in (1, 2, 3):
        frames = [r.randbytes(100 if kind == 2 else r.randint(0, 700)) for _ in range(7)]
        block = media.number(1) + b"\0\0" + bytes([kind << 1]) + media.lace(frames, kind)
        cluster = bytes.fromhex("1F43B675") + b"\xff"
        f = media.element(media.EBML, media.uint(media.VERSION, 1)) + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7
        f += cluster + media.uint(media.TIME, 5) + media.element(media.GROUP, media.element(media.BLOCK, block)) + cluster + media.uint(media.TIME, 9) + media.element(media.SIMPLE, block)
        m = media.parse(f)
        assert [f[s : s + n] for _, _, s, n, _ in m.packets] == frames * 2 and m.clusters == 2
    table = media.packets(media.muxed(docs))
    assert table.agg(F.sum("length")).first()[0] == sum(len(media.payload(t)[0]) for _, t in rows)
    assert media.described(empty).count() == 0
    with pytest.raises(ValueError):
        media.parse(media.write(b"\0" * 640)[:-9])
    for r in media.described(docs).select("doc_id", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect():
        data = next(media.payload(t)[0] for i, t in rows if i == r.doc_id and hashlib.sha256(media.payload(t)[0]).hexdigest() == r.payload_sha256)
        stored = media.write(data)
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert told["mean"] == f"{sum(data) / len(data):.4f}" and int(told["crossings"]) == sum((a < 128) != (b < 128) for a, b in zip(data, data[1:]))


def test_damaged_matroska_is_a_value_error(spark):
    r = random.Random(19)
    whole = media.write(bytes(r.randbytes(3000)))
    bad = []
    for _ in range(1500):
        x = bytearray(whole[: r.randrange(4, len(whole) + 1)])
        for _ in range(r.randint(0, 4)):
            x[r.randrange(4, len(x)) if len(x) > 4 else 0] = r.randrange(256)
        bad.append(bytes(x))
    for x in bad:
        try:
            media.parse(x)
        except ValueError:
            pass
    table = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad[:200])] + [(999, None)], "doc_id long, media binary")
    assert media.packets(table).where("length < 0").count() == 0


def brute_nearest(x, ids, own, k=20):
    import functools

    y = x.astype(np.float64).tolist()
    dot = lambda a, b: functools.reduce(lambda t, ab: t + ab[0] * ab[1], zip(a, b), 0.0)
    out = {}
    for q in own:
        s = [(-dot(y[i], y[q]), i) for i in ids if i != q]
        out[q] = [(n, i, -v) for n, (v, i) in enumerate(sorted(s)[:k], 1)]
    return out


@pytest.mark.parametrize("cells", [False, True])
def test_nearest_neighbours(spark, monkeypatch, cells):
    if cells:  # several tiles, groups and parts
        monkeypatch.setattr(ann, "CANDIDATES", 16)
        monkeypatch.setattr(ann, "QUERIES", 2)
        monkeypatch.setattr(ann, "CELL", 1)
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 12)).astype(np.float32)
    x[50:60] = x[40]
    x[100:140] = x[20]  # more equal vectors than are asked for
    x[200:240] = x[60] * (1 + 1e-6 * r.normal(size=(40, 1)))  # within the rounding of a tile
    x[7] = 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(None, [1.0] * 12), (900, None), (920, [float("nan")] * 12), (940, [None] * 12), (960, [1.0, 2.0])]
    got = collections.defaultdict(list)
    for g in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[g.query_id].append((g.rank, g.vec_id, g.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_nearest(x, [i for i in range(300) if i != 7], range(0, 300, 20))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_equal_vectors_are_one_row(spark):
    table = spark.range(4000).selectExpr("id as vec_id", "array(1.0D, 2.0D) as embedding")
    got = ann.search(table).collect()
    assert len(got) == 200 * 20 and {r.score for r in got} == {5.0}
    of = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        of[r.query_id].append(r.vec_id)
    assert of[0] == list(range(1, 21)) and of[20] == list(range(20)) and of[2000] == list(range(20))
    classes = ann._Side(pa.table({"v": [[1.0, 2.0]]}), 2)
    assert len(ann.heaps(classes, classes, [0], 21)[0]) == 1


def junk(r, kind):
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 150))]
    return " ".join({0: words, 1: [w + "$$$" for w in words], 2: [w.upper() + "!!" for w in words], 3: [w for w in words[:8] for _ in range(15)]}[kind])


def test_quality_score_is_the_network_of_every_chunk():
    net = quality.Net(3)
    r = random.Random(4)
    net.out = np.linspace(-0.4, 0.5, len(net.out)).astype(np.float32)
    texts = ["", None, "short", "äöü " * 300, "".join(r.choice("abc de\n") for _ in range(5000)), "x" * 1400]

    def plain(t):
        raw = (t or "").encode()
        step, feats = quality.CHUNK - quality.OVERLAP, []
        for at in range(0, max(1, len(raw) - quality.OVERLAP), step):  # overlapping chunks up to the text's end
            c = raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            row = []
            for k in range(quality.FILTERS):
                best = -np.inf
                for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    best = max(best, float(net.embed[list(c[p : p + quality.WIDTH])].ravel().astype(float) @ net.filters[:, k].astype(float)))
                row.append(max(0.0, best + float(net.bias[k])))
            real = [b or i % 256 for i, b in enumerate(c)]
            most, first = 0.0, quality.LAGS[-1]
            size = (quality.CHUNK - first) // quality.WINDOWS
            for lag in quality.LAGS:
                for w in range(quality.WINDOWS):
                    span = range(first + w * size, first + (w + 1) * size)
                    most = max(most, sum(real[i] == real[i - lag] for i in span) * 6 / size)
            feats.append([*row, most])
        f = np.array(feats)
        z = np.concatenate([f.max(0), f.mean(0)]) @ net.out.astype(float) + float(net.last[0])
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    assert np.allclose(net.score(texts), [plain(t) for t in texts], atol=1e-4)


def test_quality_sample_is_of_whole_documents(spark):
    d = spark.createDataFrame([(i, "ab " * (400 if i < 9 else 20)) for i in range(60)] + [(9, "zz")] * 30, "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    before, quality.train = quality.train, lambda texts, y: seen.append(texts)
    try:
        quality.fit(d, y, room=3000)
        quality.fit(d, y)
    finally:
        quality.train = before
    assert sum(map(len, seen[0])) <= 3000 and {len(t) for t in seen[0]} <= {2, 60, 1200}
    assert len(seen[1]) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))


def test_quality_on_held_out_rows(spark, docs, empty):
    r = random.Random(9)
    rows = [(i, junk(r, i % 4 if i % 2 else 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(not i % 2 or i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(d, y).where("held_out").collect()
    right = sum((x.predicted == 1) == (x.doc_id % 2 == 0) for x in got)
    assert right >= 0.95 * len(got)
    assert quality.classify(docs, y).count() == docs.count()
    none = quality.classify(docs, y.limit(0)).collect()
    assert all(x.score == 0.5 for x in none)
    assert quality.classify(empty, y).count() == 0


def test_toxicity_on_held_out_rows_and_disguises(spark, docs, empty):
    r = random.Random(10)
    rows = []
    for i in range(600):
        words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(words + (["moronic"] if i % 5 == 0 else []))))
    disguised = [(1000, "so m0r0n1c"), (1001, "so m o r o n i c ,"), (1002, "so moooronic"), (1003, "m.o.r.o.n.i.c"), (1004, "a$$$ the!! 4.0 x@y.de")]
    table = spark.createDataFrame(rows + disguised, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(table, y).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(600))
    assert [got[i].predicted for i in range(1000, 1005)] == [1, 1, 1, 1, 0]
    assert toxicity.classify(docs, y).count() == docs.count()
    assert {x.score for x in toxicity.classify(docs, y.limit(0)).collect()} == {1 - (1 - toxicity.BASE)}
    assert toxicity.classify(empty, y).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    from pyspark.sql import functions as F

    ids = spark.range(10500).where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).orderBy(F.xxhash64("id"), "id")
    late = [x.id for x in ids.collect()][6000:6040]  # the toxic rows lie behind the first 6,000
    words = F.expr("concat_ws(' ', transform(sequence(1, 5), k -> concat(translate(hex(xxhash64(id, k)), '0123456789', 'ghijklmnop'), '')))")
    docs = spark.range(10500).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(late), F.concat_ws(" ", words, F.lit("zembly"))).otherwise(words).alias("text"))
    y = docs.select("doc_id", F.col("doc_id").isin(late).cast("int").alias("toxic"))
    scorer = toxicity.fit(docs, y)
    assert any("zembly".startswith(t) for t in scorer.terms) and scorer.score("a zembly") >= 0.7 > scorer.score("a word")
    # The counts equal those of plain sets.
    rows = {tuple(sorted(set(re.findall(r"[^\W\d_]+", x.text.lower())))): x.doc_id in late for x in docs.collect() if zlib.crc32(str(x.doc_id).encode()) % 3 != 1}
    grams = collections.Counter(f"^^{w}."[i : i + 3] for r in rows for w in r for i in range(len(w) + 1))
    assert {g: n for g, n in grams.items() if re.fullmatch("[a-z^]{2}[a-z.]", g)} == scorer.trigrams
    heads = collections.Counter(h for r in rows for h in {w[:k] for w in r for k in range(4, min(len(w), 9) + 1) if len(w) > 4})
    assert all(scorer.terms[t] == min(0.999, 40.25 / (heads[t] + 1)) for t in scorer.terms)


def test_an_encoder_leaves_a_worker_to_the_next_operator(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 200)
    path = queries.vocabulary()
    e, r = bpe.encoder(path), random.Random(30)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(60)) + " the" for _ in range(30)]
    got = [e.encode(t).tolist() for t in texts]
    assert 0 < len(e.old) + len(e.memo) <= 200 and got == [bpe.Encoder(path).encode(t).tolist() for t in texts]
    many = spark.range(32).selectExpr("id as doc_id", "'so it is' as text").repartition(32, "doc_id")

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize] * b.num_rows)], ["n"])

    held = lambda: sum(x.n for x in many.mapInArrow(kept, "n long").collect())
    packing.pack(many, path).collect()
    before = held()
    toxicity.score(many, toxicity.Scorer({}, {}, {})).collect()
    assert 0 <= held() < before
    common.freed()
    assert bpe.encoder.cache_info().currsize == 0


def test_merging_looks_up_merged_places_alone(monkeypatch):
    e, r = bpe.Encoder(queries.vocabulary()), random.Random(31)
    tokens = [t for t in e.model.bytes if 0 < len(t) < 12]
    words = [bytes([97]) * n for n in range(bpe.SHORT + 1)] + [b"\0" * n for n in range(1, bpe.SHORT + 1)]
    words += [b"".join(r.choice(tokens) for _ in range(r.randint(1, 6)))[: bpe.SHORT] for _ in range(3000)]
    words += [bytes(r.randrange(256) for _ in range(r.randint(1, bpe.SHORT))) for _ in range(1000)]
    asked, ranks = [], bpe.Model._ranks
    monkeypatch.setattr(bpe.Model, "_ranks", lambda self, left, right: asked.append(len(left)) or ranks(self, left, right))
    got = e.model.merge_many(words)
    assert got == [np.array(e.model.merge(w), "<u4").tobytes() for w in words]
    # A merge makes two new pairs; the pairs of bytes that a word begins with are looked up in a table of their own.
    assert sum(asked) == 2 * sum(len(w) - len(x) // 4 for w, x in zip(words, got)) > 0


def test_known_new_and_long_words_in_a_block(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "GROUP", 300)
    monkeypatch.setattr(bpe, "MEMO", 60)
    e, r = bpe.Encoder(queries.vocabulary()), random.Random(32)
    words = ["the", " of", "<|endoftext|>", " ", "\n", "'s", "öl", "𝒳y", "\ufffd", "y" * 70, "z" * (bpe.SHORT - 1), ""]
    words += [" " + "".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(50)]
    for n in (0, 1, 5, 40):
        texts = ["".join(r.choice(words) for _ in range(n)) for _ in range(40)] + [None, "x" * (bpe.BLOCK + 9) + " the"]
        got = [np.frombuffer(b"".join(x), "<u4").tolist() for x in e.many(texts)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(e.memo) <= 30 and len(e.old) <= 30


def scorer_by_hand():
    count = collections.Counter()
    for w in ["the", "stupid", "idiot", "cretin", "ass", "assume", "stop", "star", "cat", "call", "rap", "crash", "class"] * 3:
        x = "^^" + w + "."
        count.update(x[i : i + 3] for i in range(len(x) - 2))
    terms = {"stupid": 0.9, "idiot": 0.9, "creti": 0.9, "ass$": 0.9}
    return toxicity.Scorer(terms, count, {t: 5.0 for t in terms} | {"as$": 4.0, "assume$": 7.0})


def test_look_alikes_at_the_ends_of_tokens():
    s = scorer_by_hand()
    toxic = ["$tupid", "!diot", "|diot", "(retin", "$+up!d", "@55", "a$$", "@$$", "($tupid)", "stupid!!!", "(idiot!)", "$$tupid", "$ + u p ! d", "@ s s", "( r e t i n", "s.t.u.p.i.d!", "idi0t.", "|d|0t!"]
    clean = ["as", "455", "$455", "(455)", "+1455", "pass", "assume!", "(rap)", "(all", "$ave", "asset", "class!", "a!", "4 5 5", "$5.50", "(as)", "!!!", "$$$", "||"]
    assert [t for t in toxic if s.score(f"so {t} it") < 0.7] == []
    assert [t for t in clean if s.score(f"so {t} it") >= 0.7] == []


def test_the_canonical_form_decides_as_decoding_all_does():
    s, plain = scorer_by_hand(), scorer_by_hand()
    plain.any = re.compile("")  # each token with traces is decoded
    r = random.Random(21)
    for _ in range(3000):
        t = "".join(r.choice("astupid$!|(@015+.-") for _ in range(r.randint(1, 8)))
        assert s.found(f"x {t} y") == plain.found(f"x {t} y"), t


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
    assert {r.doc_id for r in p.STAGES[-1][1](spark, docs, d).collect()} == {r.doc_id for r in docs.collect()}
    assert json.dumps([n for n, _ in p.STAGES]) == '["toxicity", "quality", "near_dedup", "secrets", "packing"]'


def test_minhash_bitmap_loses_no_candidate(spark):
    docs = spark.range(-500, 5000).selectExpr("id as doc_id", "'t' as text")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    some = minhash.likely(docs, ids)
    assert some.join(ids, "doc_id", "left_semi").count() == ids.count()
    assert some.count() < ids.count() * 1.1
    assert minhash.likely(docs, ids.limit(0)).count() == 0


def test_near_duplicate_plans_are_small_for_the_driver(docs, rows, monkeypatch):
    seen, stored = {}, minhash.stored

    def watched(df, name, path=None):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = max(seen.get(name, 0), len(re.findall(r"\bExchange|\bBroadcastExchange", plan)))
        return stored(df, name, path)

    monkeypatch.setattr(minhash, "stored", watched)
    got = minhash.link(docs, 80).collect()
    assert len(got) == len(rows) and sum(not x.kept for x in got if x.doc_id is not None) > 40
    assert {"stars", "links", "sets"} <= set(seen)
    assert max(seen.values()) <= 12, seen


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2002, 2001), (2001, 2002), (3000, 3000)]
    got = {x.id: x.comp for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {2001: 2001, 2002: 2001}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_between_80_and_85_percent(spark):
    import corpus_pipeline

    r = random.Random(12)
    rows, want = [], []
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(0, 400, 2):
        a = [f"{i}w{k}" for k in range(r.randint(100, 300))]
        b = list(a)
        share = 1.0
        while share >= 0.85:
            b[r.randrange(len(b))] = f"v{r.random()}"
            share = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        want += [i] if share >= 0.8 else [i, i + 1]
    assert len(want) < 250
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_copies(spark, docs, "").collect()) == want
    assert minhash.dedup(docs).count() == len(rows)


def test_near_duplicate_bounds_follow_the_threshold():
    assert minhash.plan(85) == 24
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.plan(percent) <= 1e-6


def test_an_earlier_band_had_a_bucket_for_the_pair():
    a = minhash.sketch(np.arange(1, 200, dtype=np.uint64))
    b = a.copy()
    b[3] ^= np.uint64(1 << 40)  # a collision of the 16 bits that are kept
    b[7] ^= np.uint64(1)
    same = (a.astype("<u2") == b.astype("<u2")).reshape(-1, minhash.ROWS).all(axis=1)
    assert ((minhash.bands(a) == minhash.bands(b)) == same).all() and same[0] and not same[1]


def test_toxicity_reads_single_doubles_and_short_words(spark):
    r = random.Random(13)
    rows = []
    for i in range(900):
        words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(words + ([["moronic"], ["vug"], ["zembly", "zemkit", "zempor"]][i % 3] if i % 5 == 0 else []))))
    disguised = ["so mooronic", "so moronnic", "so v|_|g vu9", "so v u g ,", "so v.u.g", "so vuuug", "so vugg", "so z3mbly", "so zeembly", "so zemmkit"]
    clean = ["so hoorse", "so seeen 4 5 5", "so 4.0 a.b x@y.de", "so v u", "to and 9 9 9 v", "so snoot three assess"]
    table = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(disguised)] + [(2000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.classify(table, y).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(900))
    assert [t for i, t in enumerate(disguised) if not got[1000 + i]] == []
    assert [t for i, t in enumerate(clean) if got[2000 + i]] == []


def test_personal_data_context_left_of_spaced_seeds(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(9))
    rows = [(i, f"{word()} tel: +1 (619) 555-{i:04d} {word()}") for i in range(40)]
    rows += [(100 + i, f"{word()} {word()} card-no {c} {word()}") for i, c in enumerate(["4111 1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111-1111 1111-1111"] * 20)]
    rows += [(200, "xa tel: 0619/555000 xb"), (201, "xc card-no AB99/1234 xd"), (202, "xe tel: 9x3 xf"), (203, "xg 9x3 xh 77/123456 xi")]
    got = {x.doc_id: x for x in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(s.start, s.end) for s in got[i].spans if s.kind == 4] for i in range(200, 204)] == [[(8, 19)], [(11, 20)], [(8, 11)], []]
    assert not any(got[i].base for i in range(200, 204))


def test_personal_data_words_around_whole_matches(spark):
    texts = ["a tel: +1 (619) 555-0001, and b", "ab (+1 (619) 555-0001) +1 (619) 555-0002", "+1 (619) 555-0001", "x" * 70000 + " +1 (619) 555-0001\n", "A b\n+1 (619) 555-0001 c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pii.pieces(F.col("t"), pii.PATTERNS["phone"], True).alias("p")).collect()
    assert [[(m.left[:9], m.right) for m in x.p] for x in got] == [[("tel:", "and")], [("ab", "+1"), ("555-0001)", "")], [("", "")], [("x" * 9, "")], [("b", "c")]]


def test_personal_data_patterns_do_not_depend_on_other_seeds(spark):
    logs = spark.range(1000, 41000).selectExpr("id as doc_id", "concat('host 10.0.', id % 250, '.7 up') as text")
    rows = [(i, f"w{i}x tel: +1 (619) 555-{i:04d} y{i}z") for i in range(12)] + [(50, "w tel: 0619/555000 y")]
    docs = logs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [s.kind for s in pii.scan(docs).where("doc_id = 50").first().spans] == [4]


def test_personal_data_found_identifiers_induce_patterns(spark):
    r = random.Random(15)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(9))
    rows = [(i, f"{word()} tel: +1 (619) 555-{i:04d} {word()}") for i in range(60)]
    rows += [(100 + i, f"{word()} tel: {i}00/77{i}55 kunde {word()}") for i in range(12)]  # first hop, by "tel:"
    rows += [(200, f"{word()} x9/443 kunde {word()}"), (201, f"{word()} x9/443 other {word()}"), (202, f"{word()} z4-88812 {word()}")]
    got = {x.doc_id: [s.kind for s in x.spans] for x in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == [4] for i in range(12))
    # Second hop: no seed stands by "kunde", but what was found does; the name then holds anywhere.
    assert got[200] == [4] and got[201] == [4] and got[202] == []


def test_personal_data_registered_columns(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for i, t in rows:
        found = brute_pii(t)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want[i, *(sum(k == n for _, k, _ in found) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest()] += 1
    got = queries.op7_pii(spark, str(tmp_path))
    assert counted(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
