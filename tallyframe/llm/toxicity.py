"""Toxicity by noisy-channel deobfuscation.

Written tokens are taken as noisy copies of words: letters swapped for look-alike signs, letters
repeated, separators put between letters. For a token with such traces (one doubled letter is
enough), and for a run of single signs with separators between, a lattice holds for each sign the
letters it may stand for, and whether it may be dropped or end a word, each at a channel cost; a
look-alike at either end of a token may also be its punctuation. The
Viterbi path through the lattice under a character language model, with back-pointers, is the
restored text. The language model is the cheaper of two: character trigrams, and a lexicon
of learned terms and of the words like them, so a known word is preferred to a chain of likely
letters. The document is scored by the terms (word beginnings) that its text has as written
or restored; their share of toxic documents was learned from labels:
``score = 1 - prod(1 - p(term))`` over distinct terms.

No channel changes a text's canonical form (:func:`canonical`: signs that can stand for each other
are one, runs are one sign, separators are gone), but for punctuation at its ends. So a token whose
canonical form holds no term's needs no decoding, which decides most of them; the result is that of
decoding all (:meth:`Scorer.traced`). A token that reads as a number is one, and is not decoded.

Training (:func:`fit`) uses every labelled document of the training folds; documents with the same
two min-hashes of 4-word shingles count once, so a group of copies is one witness. They are counted
where they lie. What reaches the driver is the terms (each is in a hundredth of the toxic documents),
the words of the lexicon that save anything, the trigrams of one alphabet.

Edge cases: a null or empty text has no terms and gets the base score; repeated rows each get a
row; without labels, or with one class only, every text gets the base score; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, docs_of, fold, freed, labelled, mix, stored, word_hashes
from .minhash import likely

#: The letters that a sign may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SWAP, DROP, AGAIN, KEEP, PART = 1.0, 0.4, 0.2, 2.5, 0.0  # channel costs, in nats
BASE = 0.02  # score of a text without terms
MEMO = 100_000  # tokens remembered by a worker
_EDGE = ".,;:!?\"'()[]{}#%&*-$_|<>~`"
_BARE = "".join(c for c in _EDGE if c not in LOOKALIKE)  # punctuation that stands for no letter
POINT = {c: AGAIN if c in "!|(" else KEEP for c in _EDGE if c in LOOKALIKE}  # cost of being punctuation; $ seldom is
_NUMBER = re.compile(r"[^\w@]*\d[\d\W]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?:(?<=\s)|^)[\w@$!|+(€£](?:[ .\-_*][\w@$!|+(€£]){2,}(?=[\s.,;:!?]|$)")


def _classes() -> dict[str, str]:
    """Each letter and sign to one sign of all that can stand for each other."""
    of: dict[str, str] = {}
    for sign, letters in LOOKALIKE.items():
        same = {of.get(x, x) for x in (sign, *letters)}
        chief = min(same)
        of |= {x: chief for x in [*of, sign, *letters] if of.get(x, x) in same}
    return of


_CLASS = _classes()


class _Table(dict):
    """For ``str.translate``: a letter or look-alike to its class, any other sign to nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = _CLASS.get(c, c if c.isalpha() else "")
        return self[code]


_TABLE = _Table()


def canonical(text: str) -> str:
    """What lower-case text and all its disguises have in common."""
    return _RUN.sub(r"\1", text.translate(_TABLE))


class CharModel:
    """Character trigrams with add-k smoothing; ``^`` opens a word and ``.`` closes it."""

    def __init__(self, counts: dict[str, int], letters: int = 40):
        self.tri = counts
        self.bi: dict[str, int] = {}
        for g, n in counts.items():
            self.bi[g[:2]] = self.bi.get(g[:2], 0) + n
        self.letters = letters
        self.memo: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        c = self.memo.get(gram)
        if c is None:
            self.memo[gram] = c = -math.log((self.tri.get(gram, 0) + 0.05) / (self.bi.get(gram[:2], 0) + 0.05 * self.letters))
        return c

    def word(self, word: str) -> float:
        """Cost of a word's letters, its end left open."""
        w = "^^" + word
        return sum(self.cost(w[i : i + 3]) for i in range(len(word)))


class Scorer:
    """Learned terms, the lexicon (word beginnings, or with ``$`` whole words, with their cost) and the character model."""

    def __init__(self, terms: dict[str, float], trigrams: dict[str, int], lexicon: dict[str, float]):
        self.terms, self.trigrams, self.lexicon = terms, trigrams, lexicon
        self.model = CharModel(trigrams)
        self.sizes = sorted({len(t) for t in terms})
        forms = {canonical(t.rstrip("$")) for t in terms} - {""}
        # A form that another one begins is found with it.
        forms = {f for f in forms if not any(f[:n] in forms for n in range(1, len(f)))}
        self.any = re.compile("|".join(map(re.escape, sorted(forms))) or r"(?!)")
        # What the lexicon saves at each beginning, beyond what the letters before have saved.
        saved = {t: max(0.0, self.model.word(t.rstrip("$")) + (self.model.cost(("^^" + t)[-3:-1] + ".") if t[-1] == "$" else 0.0) - c) for t, c in lexicon.items()}
        self.gain: dict[str, float] = {}
        for t in lexicon:
            for n in range(1, len(t) + 1):
                head = t[:n]
                self.gain[head] = max((saved.get(head[:k], 0.0) for k in range(1, n + 1)), default=0.0)
        self.memo: dict[str, tuple[str, ...]] = {}

    def begin(self, word: str) -> list[str]:
        return [t for n in self.sizes if (t := word[:n]) in self.terms and len(t) == n] + ([word + "$"] if word + "$" in self.terms else [])

    def restore(self, text: str) -> str:
        """The Viterbi path of lower-case ``text``: words with blanks between."""
        cost, gain = self.model.cost, self.gain
        # (last two letters, beginning in the lexicon or None) -> cost and what was emitted, as a chain
        paths: dict[tuple[str, str | None], tuple[float, tuple | None]] = {("^^", ""): (0.0, None)}
        n = len(text)
        first, last_at = n - len(text.lstrip(_EDGE)), len(text.rstrip(_EDGE))
        for i, sign in enumerate(text):
            again = i > 0 and text[i - 1] == sign
            triple = again and (i > 1 and text[i - 2] == sign or i + 1 < n and text[i + 1] == sign)
            if sign.isalpha():
                options = [(sign, KEEP if triple else 0.0)]
                if again:
                    options.append(("", AGAIN if triple else KEEP))
            elif sign in LOOKALIKE:
                # A sign that comes again is swapped as the one before was.
                options = [(x, KEEP + SWAP if triple else AGAIN if again else SWAP) for x in LOOKALIKE[sign]]
                if again:
                    options.append(("", AGAIN if triple else KEEP))
                if sign in POINT and (i < first or i >= last_at):
                    options.append(("", POINT[sign]))
            else:
                options = [("", DROP), (" ", PART)]
            new: dict[tuple[str, str | None], tuple[float, tuple | None]] = {}
            for (last, head), (total, chain) in paths.items():
                for letter, extra in options:
                    c = total + extra
                    if letter == " ":
                        if last == "^^":
                            continue
                        c += cost(last + ".") - self._ended(head)
                        key, link = ("^^", ""), (" ", chain)
                    elif letter:
                        c += cost(last + letter)
                        longer = None if head is None else head + letter
                        if longer is not None and longer in gain:
                            c -= gain[longer] - gain.get(head, 0.0)
                        else:
                            longer = None
                        key, link = (last[1] + letter, longer), (letter, chain)
                    else:
                        key, link = (last, head), chain
                    old = new.get(key)
                    if old is None or c < old[0]:
                        new[key] = (c, link)
            paths = new
        best = min(((c + (cost(last + ".") - self._ended(head) if last != "^^" else 0.0), last, head or "", chain) for (last, head), (c, chain) in paths.items()), key=lambda x: x[:3])
        out, chain = [], best[3]
        while chain is not None:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))

    def _ended(self, head: str | None) -> float:
        """What the end of a word of the lexicon saves."""
        return 0.0 if head is None else max(0.0, self.gain.get(head + "$", 0.0) - self.gain.get(head, 0.0))

    def restored(self, text: str) -> list[str]:
        return [t for w in self.restore(text).split() for t in self.begin(w)]

    def traced(self, raw: str) -> str | None:
        """What is to be decoded of a token, in lower case: None if it has no traces of the channels."""
        x = raw.strip(_BARE).lower()
        if _NUMBER.fullmatch(x) or not any(c.isalpha() or c in LOOKALIKE for c in x):
            return None
        if x.isalpha():
            return x if _TWICE.search(x) else None
        return x

    def of_token(self, raw: str) -> tuple[str, ...]:
        core = raw.strip(_EDGE).lower()
        found = self.begin(core) if core.isalpha() else [t for w in _LETTERS.findall(core) for t in self.begin(w)]
        x = self.traced(raw)
        # A word of letters begins with its first; before others, look-alikes may be punctuation.
        if x is not None and (self.any.match if x.isalpha() else self.any.search)(canonical(x)):
            found += self.restored(x)
        return tuple(dict.fromkeys(found))

    def found(self, text: str | None) -> set[str]:
        """The distinct terms of the text as written and as restored."""
        if not isinstance(text, str) or not text:
            return set()
        out: set[str] = set()
        memo = self.memo
        for w in set(text.split()):
            if (hit := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = hit = self.of_token(w)
            if hit:
                out.update(hit)
        for m in _SPACED.finditer(text):
            x = m[0].lower()
            if not _NUMBER.fullmatch(x) and self.any.search(canonical(x)):
                out.update(self.restored(x))
        return out

    def score(self, text: str | None) -> float:
        clean = 1.0 - BASE
        for t in sorted(self.found(text)):
            clean *= 1.0 - self.terms[t]
        return 1.0 - clean


def _witnesses(rows: DataFrame) -> DataFrame:
    """y and the distinct lower-case words of rows (doc_id, text, y); documents with the same two min-hashes of 4-word shingles are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            h, n = word_hashes(texts)
            one, two, at = [], [], 0
            for doc, size in zip(b.column("doc_id").to_pylist(), n.tolist()):
                x = h[at : at + size]
                at += size
                with np.errstate(over="ignore"):
                    g = x if size < 4 else mix(mix(mix(x[:-3]) + x[1:-2]) + x[2:-1]) + x[3:]
                    h1, h2 = (mix(g), mix(g ^ np.uint64(0xC2B2AE3D27D4EB4F))) if size else (g, g)
                # A text without words is like no other.
                one.append(int(h1.min().astype(np.int64)) if size else doc)
                two.append(int(h2.min().astype(np.int64)) if size else doc)
            words = [sorted(set(_LETTERS.findall(t.lower()))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), b.column("y"), pa.array(words, pa.list_(pa.string()))],
                ["doc_id", "one", "two", "y", "words"],
            )

    out = rows.mapInArrow(run, "doc_id long, one long, two long, y int, words array<string>")
    return out.groupBy("one", "two").agg(F.max(F.struct("y", "doc_id", "words")).alias("w")).select("w.y", "w.words")


def _heads(words: list[str]) -> set[str]:
    """The beginnings of 4 to 9 letters of longer words, and the others whole with ``$``."""
    return {h for w in words for h in ([w[:k] for k in range(4, min(len(w), 9) + 1)] if len(w) > 4 else (w + "$",))}


def _counted(train: DataFrame) -> DataFrame:
    """kind, key, a, n: of each distinct beginning (``head``) and word, and of all texts, how many toxic documents and documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        n = {"head": Counter(), "word": Counter(), "text": Counter()}
        a = {kind: Counter() for kind in n}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, counts in n.items():
                keys = list(counts)
                for i in range(0, len(keys), BATCH):
                    some = keys[i : i + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(some)), pa.array(some, pa.string()), pa.array([a[kind][k] for k in some], pa.int64()), pa.array([counts[k] for k in some], pa.int64())],
                        ["kind", "key", "a", "n"],
                    )
                counts.clear()
                a[kind].clear()

        for b in batches:
            for y, words in zip(b.column("y").to_pylist(), b.column("words")):
                words = words.as_py()
                for kind, keys in (("head", _heads(words)), ("word", words), ("text", [""])):
                    n[kind].update(keys)
                    if y:
                        # Labels are 0 or 1; any other number weighs as it is.
                        a[kind].update(keys if y == 1 else dict.fromkeys(keys, y))
                # What is held is bounded; the parts are added up below.
                if len(n["head"]) + len(n["word"]) > MEMO:
                    yield from out()
        yield from out()

    return train.mapInArrow(run, "kind string, key string, a long, n long").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Scorer:
    """Learn terms, lexicon and trigrams from all labelled documents of the training folds."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col(label).isNotNull() & (fold(3) != 1))
    counts = stored(_counted(_witnesses(labelled(likely(docs_of(docs), ids), labels, label))), "toxicity")
    kind = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)))
    frequent = (F.col("kind") == "head") & (F.col("n") >= 3)
    total, toxic, size, known = (x or 0 for x in counts.agg(kind("text", "n"), kind("text", "a"), kind("word", "n"), F.count(F.when(frequent, 1))).first())
    # So many toxic documents that not one of the frequent terms should reach them by chance.
    chance = math.ceil(math.log(2 * max(1, known)) / -math.log(toxic / total)) if 0 < toxic < total else 3
    n = {r.key: (r.a, r.n) for r in counts.where(frequent & (F.col("a") >= max(3, 0.01 * toxic, chance)) & (F.col("a") >= 0.9 * F.col("n"))).collect()}
    # A beginning is kept unless one letter more tells as much.
    longer = {t[:-1]: n[t][0] for t in sorted(n, key=lambda t: n[t][0]) if t[-1] != "$"}
    terms = {t: min(0.999, (a + 0.25) / (k + 1)) for t, (a, k) in n.items() if longer.get(t, 0) < 0.9 * a}
    lexicon = {t: -math.log(n[t][1] / size) for t in terms}
    words = counts.where("kind = 'word'")
    trigrams = (
        words.select(F.concat(F.lit("^^"), "key", F.lit(".")).alias("w"), "n")
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda k: F.substr("w", k, F.lit(3)))).alias("g"), "n")
        .where(F.col("g").rlike(r"^[a-zß-ÿ^]{2}[a-zß-ÿ.]$"))
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    grams = {r.g: r.n for r in trigrams}
    # Other words that a term's disguise could be, if they cost less than their letters: others save nothing.
    forms = tuple(sorted({canonical(t.rstrip("$")) for t in terms} - {""}))
    if forms:
        model, begun = CharModel(grams), tuple(terms)

        @F.udf("boolean")
        def saves(w, n):
            return canonical(w).startswith(forms) and not w.startswith(begun) and model.word(w) + model.cost(("^^" + w)[-2:] + ".") > -math.log(n / size)

        lexicon |= {r.key + "$": -math.log(r.n / size) for r in words.where("n >= 3").where(saves("key", "n")).collect()}
    return Scorer(terms, grams, lexicon)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of every text."""
    parts = scorer.terms, scorer.trigrams, scorer.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        s = Scorer(*parts)
        for b in batches:
            out = [s.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns kept, that score below the threshold."""
    scorer = fit(docs, labels)
    parts = scorer.terms, scorer.trigrams, scorer.lexicon
    ready: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        if not ready:
            freed()
            ready.append(Scorer(*parts))
        return text.map(ready[0].score).astype("float64")

    return docs.where(scored("text") < threshold)
