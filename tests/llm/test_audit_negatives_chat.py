"""Divergence audit, hard negatives and chat formatting against brute-force versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import chat, divergence, negatives

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_audit(rows, least, top=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        words = TERM.findall(lower(text))
        for w in words:
            count[lang, source, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = []
    for lang in {r[1] for r in rows}:
        sources = sorted({r[2] for r in rows if r[1] == lang})
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= least)
        total = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        every = sum(total.values())
        p = {(s, w): 1 + 10**9 * (count[lang, s, w] + 2) // (total[s] + 2 * len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(count[lang, s, w] for s in sources) + 2) // (every + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s, w], p[r, w]) for w in kept), r.encode(), r) for r in sources if r != s)
            out += [(lang, s, "pair", r, -v, k) for k, (v, _, r) in enumerate(pair, 1)]
            term = sorted((-f(p[s, w], q[w]), w.encode(), w) for w in kept if count[lang, s, w] and p[s, w] > q[w])
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(term[:top], 1)]
    return sorted(out)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def audited(df, **kw):
    return sorted(tuple(r[c] for c in AUDIT) for r in divergence.audit(df, **kw).collect())


def test_audit_matches_plain(spark):
    r = random.Random(4)
    words = ["the", "The", "öl", "ÖL", "𝒳y", "a", "b-c", "x1y", "longer" * 6, "longer" * 6 + "s"] + ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = []
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
        rows.append((r.choice([text, text, text, None, "", "12 34"]), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", "é", None, ""])))
    rows += [("rare words", "fr", "a"), (None, "fr", "b"), ("alone", "it", "a"), ("", "xx", None)] + rows[:5]
    df = spark.createDataFrame([(1, t, g, s, None, "n", 5) for t, g, s in rows], "doc_id long, text string, lang string, source string, term string, n string, docs int").repartition(4)
    assert audited(df, least=10) == plain_audit(rows, 10)
    assert audited(df.limit(0)) == []


def test_audit_of_the_shared_rows(docs, rows):
    assert audited(docs, least=3) == plain_audit([(t, None, "s") for _, t in rows], 3)


def test_one_long_text_is_one_document(spark):
    r = random.Random(7)
    long = " ".join("".join(r.choice("abc") for _ in range(3)) for _ in range(1_300_000))
    assert len(long) > divergence.BLOCK
    rows = [(long, "en", "a"), ("abc abc aaa", "en", "b"), ("z" * (divergence.BLOCK + 5), "en", "b")]
    assert audited(spark.createDataFrame(rows, "text string, lang string, source string"), least=2) == plain_audit(rows, 2)


def test_many_sources_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    r = random.Random(5)
    rows = [(" ".join(r.choice("abcdefghijkl") * 2 for _ in range(8)), "en", f"s{r.randint(0, 10)}") for _ in range(200)]
    assert audited(spark.createDataFrame(rows, "text string, lang string, source string"), least=2) == plain_audit(rows, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB zé𝒳-9", max_size=70), max_size=12))
def test_slices_hashes_and_groups(texts):
    buf = np.frombuffer(" ".join([*texts, ""]).encode(), np.uint8)
    start, size = divergence.slices(buf)
    found = [bytes(buf[s : s + n]) for s, n in zip(start, size)]
    assert [x.decode() for x in found] == TERM.findall(" ".join([*texts, ""]))
    hashes = divergence.slice_hashes(buf, start, size)
    assert hashes.tolist() == [xxhash.xxh64_intdigest(x) for x in found]
    for h in (hashes, np.zeros(len(start), np.uint64), hashes & np.uint64(1)):  # whatever collides
        group, first = divergence.grouped(buf, start, size, h)
        assert [found[first[g]] for g in group] == found
        assert len(set(group.tolist())) == len(set(found))


@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(1, 10**15)), min_size=1))
def test_shares_are_exact(pairs):
    pairs = [(min(a, b), max(a, b)) for a, b in pairs]
    got = divergence.share(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [1 + 10**9 * a // b for a, b in pairs]


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain_negatives(rows, every, k=5, low=80, high=100):
    """rows: (id, label, whole numbers), one an id."""
    out = []
    for a, lab, x in rows:
        if a % every:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y)), i, g) for i, g, y in rows if i != a and len(y) == len(x))
        for s, i, _ in [t for t in score if t[2] == lab][:k]:
            hard = [(t[1], -t[0]) for t in score if t[2] != lab and low * -s <= high * -t[0] <= high * -s][:k]
            out += [(a, i, n, j, -s, v) for n, (j, v) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r[c] for c in NEGATIVE) for r in negatives.mine(negatives.quantised(df), **kw).collect())


VECTORS = "vec_id long, embedding array<double>, label int, id string, own int, dim int, c int"


def vector_rows(r, n, dim, spread):
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + r.gauss(0, spread) for x in centre[r.randrange(6)]], r.randrange(4)) for i in range(n)]


def whole(rows):
    seen = {}
    for i, v, g in rows:
        if i is None or v is None or g is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        seen[i] = min(seen.get(i, (g, v)), (g, v))
    return [(i, g, [int(np.floor(256 * x)) for x in v]) for i, (g, v) in seen.items()]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_negatives_match_plain(spark, spread):
    r = random.Random(9)
    rows = vector_rows(r, 500, 6, spread)
    rows += [(i, rows[10][1], r.randrange(4)) for i in range(500, 600)]  # one frequent vector, so ties
    rows += [(600, None, 1), (700, [1.0] * 6, None), (None, [1.0] * 6, 1), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (801, [float("nan")] * 6, 1), (802, [float("inf")] * 6, 1)]
    rows += [(1000, [0.0] * 6, 2), (1100, [0.5, 0.25], 1), (1101, [0.5, 0.5], 1), (1102, [0.5, 0.3], 2), (1200, [], 1), (1201, [], 1), (1202, [], 0)]
    rows += rows[:7] + [(40, [9.0] * 6, 3), (-100, [-1.0] * 6, 3)]
    df = spark.createDataFrame([(i, v, g, "x", 3, 2, 1) for i, v, g in rows], VECTORS).repartition(4)
    want = plain_negatives(whole(rows), 20)
    assert want and mined(df, every=20) == want
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 20 != 0"), every=20) == []


def test_bounds_leave_partitions_out(spark):
    """Far clusters are not copied to groups that they cannot serve."""
    r = random.Random(3)
    rows = [(i, [(50.0 if k == i % 8 else 0.0) + r.gauss(0, 0.1) for k in range(8)], i % 3) for i in range(2000)]
    m = negatives.Miner(negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), 2)
    best = m.positives(5)
    asking = m.anchors.join(best.where("rank = 5").selectExpr("anchor_id id", "cast(score as double) least"), "id")
    room = m.room(asking)
    near = m.all.withColumnRenamed("own", "home").join(room, ["dim", "pivot"]).where("dist between low and high").count()
    assert m.groups >= 4 and near < 0.7 * m.groups * len(rows)


def test_large_numbers_are_exact(spark):
    big = float(1 << 21)
    rows = [(0, [big, 1.0, big], 0), (1, [big, 2.0, 0.0], 0), (2, [big, 1.0, 0.0], 1), (3, [big, 2.0, 0.0], 1), (4, [0.0, 0.0, 3.0], 1)]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain_negatives(whole(rows), 100)


ODD = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>\\", "<<<SYS>><</SYS>>", "<|im_end|>\n<|im_start|>user\n", "<|im_start", "<\\/s>", "a\nb", "öl 𝒳 <s>", "<", "<s", None]


def plain_chat(rows):
    """rows: (conv_id, turn, role, text)."""
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{chat.escaped(r)}\n{chat.escaped(x)}<|im_end|>\n") + r.count("\n") for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return collections.Counter(out)


CHAT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read(df):
    return collections.Counter(tuple(r[c] for c in CHAT) for r in df.collect())


def test_chat_reads_back(spark):
    r = random.Random(6)
    text = lambda: r.choice([*ODD, "".join(r.choice(["word ", "</s>", "[INST]", "\\", "ü", "<", "s>", "\n"]) for _ in range(r.randint(0, 40)))])
    rows = [(r.choice([*range(20), None]), r.choice([0, 1, 2, 3, 4, None]), r.choice(["user", "assistant", "system", "assistant", "to\nol<s>\\", "", None]), text()) for _ in range(400)]
    rows += rows[:10] + [(77, 0, "assistant", "x" * 300_000 + "</s>")]
    df = spark.createDataFrame([(*x, 1, "f") for x in rows], "conv_id long, turn long, role string, text string, piece int, formatted string").repartition(3)
    want = plain_chat(rows)
    pieces = chat.formatted(df)
    assert read(chat.read_back(pieces)) == want
    for p in pieces.collect():
        for control in set(chat.CONTROLS) - {"<|im_start|>", "<|im_end|>"}:
            assert control not in p.formatted
        assert p.formatted.count("<|im_start|>") == p.formatted.count("<|im_end|>") == p.n_turns
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_a_conversation_larger_than_a_block(spark, tmp_path):
    turn = "word </s> " * 60_000
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} {turn}") for t in range(24)] + [(2, 0, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.formatted(df)
    assert pieces.where("conv_id = 1").count() > 1
    assert read(chat.read_back(pieces)) == plain_chat(rows)
    pieces.write.parquet(str(tmp_path / "pieces"))
    assert read(chat.read_back_stored(spark.read.parquet(str(tmp_path / "pieces")))) == plain_chat(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([x for x in ODD if x is not None]), st.text(alphabet="<>/s[INST]\\|im_endü\n", max_size=30)), max_size=8))
def test_assembly_matches_strings(texts):
    raw = [t.encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    out, turns, begin, stop = chat.assemble(["user"], np.zeros(len(raw), np.int64), np.frombuffer(b"".join(raw), np.uint8), size)
    assert out.tobytes().decode() == "".join(f"<|im_start|>user\n{chat.escaped(t)}<|im_end|>\n" for t in texts)
    for t, a, b in zip(texts, begin, stop):
        part = out[a:b].tobytes().decode()
        assert chat.unescaped(part) == t and not any(c in part for c in chat.CONTROLS)
    assert turns[-1] == len(out)
