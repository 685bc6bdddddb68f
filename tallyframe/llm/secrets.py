"""Secret scanning over an incremental ledger of content-addressed blobs.

Every text (a version of a path, here a document id) is addressed by the SHA-256 of its bytes.
The ledger (:class:`Ledger`), a stored table, has a row for each (blob, rule version) already
scanned, with what was found. A run scans only the pairs the ledger lacks, each blob once however
many paths hold it, appends them, and joins the findings back to all paths. Rules are versioned: a
new rule set scans all blobs again, an old one nothing.

Edge cases: a null text counts as empty and has no findings; repeated rows each get a row;
findings are code point offsets, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, hot_join, small_batches


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    hint: str = ""  # a text without it has no match

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))


#: The rules and their order. The first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, as [0-9a-f]+ of 24 or more
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=".eyJ"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: long, end: long>>"
LEDGER = f"blob binary, rules string, spans {SPANS}"


def version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    out = []
    for order, (rule, pattern) in enumerate(rules):
        if rule.hint in text:
            out += [(m.start(), order, m.end(), rule.kind) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def blob_id() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of rows (blob, text)."""

    def run(batches):
        ready = [(r, r.compiled()) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in find(t or "", ready)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(spans, kind)], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob binary, spans {SPANS}")


class Ledger:
    """The ledger as a Parquet table (blob, rules, spans) in a folder that all executors share.

    Rows are only appended; a run that fails before its append is done leaves the table as it was.
    Rows appended twice, by runs at the same time, count once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def known(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, spans of the blobs that these rules have scanned."""
        return self.rows().where(F.col("rules") == version(rules)).select("blob", "spans").groupBy("blob").agg(F.first("spans").alias("spans"))

    def add(self, found: DataFrame, rules: tuple[Rule, ...]) -> None:
        found.select("blob", F.lit(version(rules)).alias("rules"), "spans").write.mode("append").parquet(self.path)


def update(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan those blobs of ``paths`` (blob, text) that the ledger lacks for these rules, append them to it, and give blob, spans of all it knows."""
    unseen = paths.groupBy("blob").agg(F.first("text").alias("text")).join(ledger.known(rules), "blob", "left_anti")
    ledger.add(scan_blobs(unseen, rules), rules)
    return ledger.known(rules)


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans of every path; the ledger gains the pairs of blob and rule version that it lacked."""
    paths = docs_of(docs).withColumn("blob", blob_id())
    found = update(paths, ledger, rules)
    return hot_join(paths.select("doc_id", "blob"), found, ["blob"], "doc_id").select("doc_id", "blob", "spans")


def joined(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def masked(text: str, spans: list, mark: str) -> str:
    """The text with each of the spans, in order of their starts, replaced; overlapping spans are one."""
    parts, at = [], 0
    for s in spans:
        start, end = s["start"], s["end"]
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, ledger: Ledger, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns kept whatever their names, with the spans of ``text`` that :func:`scan` finds replaced by ``mark``.

    Blobs without findings have no row on the join's other side.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else masked(t, x, mark) for t, x in zip(text, spans)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).withColumn("blob", blob_id())
    found = update(rows.select("blob", "text"), ledger, rules).where(F.size("spans") > 0)
    out = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    out = hot_join(out, found, ["blob"], "spread", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean("text", "spans"))
    return out.withColumn("text", text).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
