"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

The base patterns give seed entities. Every identifier-like token (one with a digit or an @) that
meets none is an instance, and the word before and the word after it, or after the whole of a seed, are its
lexical patterns. Tokens under ``NAME`` characters are too common to be the same thing wherever they
stand, so those are one instance by the two words around them, longer ones by their written form. A
pattern's support is how often it stands by a seed or by a trusted instance, its confidence that
support over all its occurrences in the corpus; an instance's confidence is one minus the product of
its patterns' doubts. Instances of high confidence are discovered, added as spans of kind
``context``, and are seeds of the next turn: what stands by them induces patterns in turn. Support,
and so confidence, only grows, and the turns end when one discovers nothing new.

Patterns with a support of ``LEAST`` are scored, however many they are; patterns, instances and
their edges meet in shuffle joins, in which frequent keys are dealt over ``SALT`` tasks.

The patterns below are the contract's, written with possessive loops and with starts only where
a match can start, so that a long run costs no more than its length; they find the same matches.

Edge cases: a null text counts as empty and has no spans; repeated rows each get a row; a null
doc_id is kept; positions are code points, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_of, stored

KINDS = ("email", "ip", "card", "phone", "context")
#: What each kind's candidates look like.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that does not match has none of the kind.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
BYTE = r"^0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])?$"
LEAST, SALT = 3, 16
BLOCK = 256  # matches whose places are summed together
NAME = 6  # characters from which a written form stands for one thing
SURE = 0.8
_SPAN = "array<struct<start: int, end: int, value: string, left: string, right: string>>"


def pieces(text: Column, pattern: str, context: bool = False) -> Column:
    """gap, value of the leftmost non-overlapping matches, gap being the length of the text between; with ``context`` also the words around."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    if context:
        # The text between, the match, and the text after it, side by side, with the match and text before and after those.
        none = F.array(F.lit(""))
        zipped = F.arrays_zip(between.alias("0"), found.alias("1"), F.slice(between, 2, 1 << 30).alias("2"), F.concat(none, between).alias("3"), F.concat(none, found).alias("4"), F.slice(found, 2, 1 << 30).alias("5"), F.slice(between, 3, 1 << 30).alias("6"))
        text_of = lambda *c: F.concat(*(F.coalesce(x, F.lit("")) for x in c))
        word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
        # The word before and the word after the white-space tokens that the match lies in.
        left = lambda x: word(F.when(x["0"].rlike(r"\s\S++\s"), x["0"]).otherwise(text_of(x["3"], x["4"], x["0"])), r"(?<!\S)(\S++)\s++\S*+\z")
        right = lambda x: word(F.when(x["2"].rlike(r"\s\S++\s"), x["2"]).otherwise(text_of(x["2"], x["5"], x["6"])), r"^\S*+\s++(\S++)")
    else:
        zipped = F.arrays_zip(between.alias("0"), found.alias("1"))
        left = right = lambda x: F.lit("")
    each = F.transform(zipped, lambda x: F.struct(F.length(x["0"]).alias("gap"), x["1"].alias("value"), left(x).alias("left"), right(x).alias("right")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def placed(column: str) -> Column:
    """:func:`pieces` in a stored column with start and end: sums within blocks, so the cost grows with the matches alone."""
    z = F.col(column)
    width = lambda x: x["gap"] + F.length(x["value"])
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + width(x))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(z) / BLOCK).cast("int") - 1)), lambda k: F.slice(z, k * BLOCK + 1, BLOCK))
    piece = "struct<gap: int, value: string, left: string, right: string>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at: int, b: array<{piece}>>>").alias("out"))
    begun = F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), b.alias("b")))).alias("out")), lambda a: a["out"])

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct((a["at"] + width(x)).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.flatten(F.transform(begun, lambda s: F.aggregate(s["b"], F.struct(s["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"])))


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of 10."""
    each = F.transform(F.reverse(F.split(digits, "(?<=.)(?=.)")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(BYTE))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans() -> Column:
    """start, kind (its place in KINDS), end, left, right of the base matches, in order, from the stored pieces of each kind."""

    def spans(i: int, kind: str) -> Column:
        found = F.filter(placed(kind), lambda m: valid(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["left"].alias("left"), m["right"].alias("right")))

    return F.array_sort(F.concat(*(spans(i, kind) for i, kind in enumerate(KINDS[:4]))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sides(rows: DataFrame, *columns: str) -> DataFrame:
    """side, word of each pattern beside rows with left and right."""
    sides = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))).alias("p")
    return rows.select(*columns, sides).select(*columns, "p.side", "p.word").where("word <> ''")


def _salted(many: DataFrame, by: str, one: DataFrame, on: list[str]) -> DataFrame:
    """``many`` joined to ``one``, which has each key once; a frequent key's rows are dealt over ``SALT`` tasks by ``by``."""
    each = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(one.select("*", each), [*on, "salt"]).drop("salt")


def discovered(instances: DataFrame, seeds: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, mark, start, end of instances that trusted patterns found.

    ``instances``: doc_id, mark, start, end, value, left, right of tokens outside seeds; ``seeds``: left, right; ``words``: the corpus, a row (word) each.
    """
    # An instance's name; one with white space in it is of the words around.
    name = F.when(F.length("value") >= NAME, F.col("value")).otherwise(F.concat(F.lit(" "), "left", F.lit(" "), "right"))
    instances = instances.withColumn("value", name)
    # An edge of the graph is a pattern, an instance and how often they meet.
    edges = stored(_sides(instances, "value").groupBy("value", "side", "word").agg(F.count("*").alias("n")), "edges")
    sure = stored(_sides(seeds).groupBy("side", "word").agg(F.count("*").alias("sure")), "sure")
    each = words.groupBy("word").agg(F.count("*").alias("uses"))
    # Not a semi-join: that would be moved below the count, and every word of the corpus shuffled.
    uses = stored(each.join(edges.select("word").unionByName(sure.select("word")).distinct(), "word"), "uses")
    trusted, known = edges.select("value").limit(0), 0
    while True:
        # What the seeds and the instances found so far stand by; a name has one edge a pattern at most.
        told = edges.join(trusted, "value").groupBy("side", "word").agg(F.sum("n").alias("sure"))
        support = sure.unionByName(told).groupBy("side", "word").agg(F.sum("sure").alias("sure")).where(F.col("sure") >= LEAST)
        scored = support.join(uses, "word").select("side", "word", (F.col("sure") / (F.col("uses") + 1)).alias("score"))
        met = _salted(edges, "value", scored, ["side", "word"])
        trust = met.groupBy("value").agg((1 - F.product(1 - F.least("score", F.lit(0.999)))).alias("trust"))
        trusted = stored(trust.where(F.col("trust") >= SURE).select("value"), "trusted")
        before, known = known, trusted.count()
        if known == before:
            return _salted(instances, "start", trusted, ["value"]).select("doc_id", "mark", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind, end) and spans (the same with discovered ones) of every text."""
    text = docs_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<gap: int, value: string, left: string, right: string>>")
    t = F.col("text")
    cut = [F.when(t.rlike(HINTS[k]), pieces(t, PATTERNS[k], True)).otherwise(none).alias(k) for k in KINDS[:4]]
    cut.append(F.when(t.rlike("[0-9@]"), pieces(t, TOKEN, True)).otherwise(none).alias("tokens"))
    found = stored(text.select("doc_id", F.xxhash64("text").alias("mark"), *cut), "pieces")
    found = stored(found.select("doc_id", "mark", base_spans().alias("seeds"), placed("tokens").alias("tokens")), "found")
    seeds = found.select(F.explode("seeds").alias("s")).select("s.left", "s.right")
    bare = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = found.select("doc_id", "mark", bare.alias("base"), "tokens")
    each = found.select("doc_id", "mark", "base", F.explode("tokens").alias("t"))
    inside = F.exists("base", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))
    instances = each.where(~inside).select("doc_id", "mark", "t.start", "t.end", "t.value", "t.left", "t.right")
    words = text.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    more = discovered(instances, seeds, words).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.col("start"), F.lit(KINDS.index("context")).alias("kind"), F.col("end"))).alias("more"))
    a, b = found.select("doc_id", "mark", "base").alias("a"), more.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return both.select("a.doc_id", "a.base", F.when(F.col("b.more").isNull(), F.col("a.base")).otherwise(F.array_sort(F.concat("a.base", "b.more"))).alias("spans"))
