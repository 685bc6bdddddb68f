"""Statement files: from bytes to records, formats and ledger rows.

One row a file comes in (``path``, ``content``); decoding and splitting into records is a function
of one file, run in tasks; everything after is by DataFrame expressions over its records.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text

# Delimiters that are tried, records that are looked at.
DELIMITERS = [",", ";", "\t", "|"]
LOOKED_AT = 25

HELD = 5000  # records handed over at once

RECORDS = "path string, record int, line int, raw string, cells array<string>"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def kind(content: Column) -> Column:
    """pdf, csv or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 8192))
    nul = head.rlike("^(?:..)*?00")
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "unknown").when(head.startswith("255044462D"), "pdf").when(nul, "unknown").otherwise("csv")


def decode(content: bytes) -> str:
    """Strict UTF-8, else Windows-1252, whose five free bytes are control characters."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in content)


@functools.cache
def _cell_pattern(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    return re.compile(rf'(?:^|{d})(?:(?!")([^{d}]*)|"((?:[^"]++|"")*+)(?:"|$)([^{d}]*))')


def _cells(record: str, delimiter: str) -> list[str]:
    """A quote opens a quoted part at the start of a cell only; two quotes inside are one."""
    if '"' not in record:
        return record.split(delimiter)
    return [bare or quoted.replace('""', '"') + rest for bare, quoted, rest in _cell_pattern(delimiter).findall(record)]


def records(found: DataFrame, delimiter: str | None) -> DataFrame:
    """path, record, line, raw, cells: the records of every file, blank ones too; ``delimiter`` None: each file's own (column delimiter).

    Line breaks inside quotes belong to the cell; ``line`` is the physical line of the start. A
    file's records come one after the other, in order.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        frame = lambda: pd.DataFrame(rows, columns=["path", "record", "line", "raw", "cells"])
        for batch in batches:
            for path, content, own in zip(batch["path"], batch["content"], batch["delimiter"]):
                line = 1
                for n, (raw, end) in enumerate(_split(decode(bytes(content or b"")).removeprefix("\ufeff"), own)):
                    rows.append((path, n, line, raw, _cells(raw, own)))
                    line += len(re.findall(r"\r\n|\n|\r", raw + end))
                    if len(rows) >= HELD:
                        yield frame()
                        rows = []
        yield frame()

    own = F.col("delimiter") if delimiter is None else F.lit(delimiter).alias("delimiter")
    return found.select("path", "content", own).mapInPandas(split, RECORDS)


def filled(rows: DataFrame) -> DataFrame:
    """Records with a cell that is not blank."""
    return rows.where(F.exists("cells", lambda c: F.trim(c) != ""))


@functools.cache
def _record_pattern(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]++|"")*+(?:"[^{d}\r\n]*|$)|(?!")[^{d}\r\n]*)'
    return re.compile(rf"({cell}(?:{d}{cell})*)(\r\n|\n|\r|$)")


def _split(whole: str, delimiter: str) -> Iterator[tuple[str, str]]:
    """(text, its line break) of each record; line breaks inside quotes belong to the record."""
    one, at = _record_pattern(delimiter), 0
    while at < len(whole):
        m = one.match(whole, at)
        yield m.group(1), m.group(2)
        at = m.end()


def _judged(content: bytes) -> tuple[str, int, float] | None:
    """(delimiter, fields, confidence) of one file, from its first records that are not blank under each delimiter."""
    whole, best = decode(content).removeprefix("\ufeff"), None
    for place, d in enumerate(DELIMITERS):
        cells = (_cells(raw, d) for raw, _ in _split(whole, d))
        widths = Counter(len(c) for c in itertools.islice((c for c in cells if any(x.strip(" ") for x in c)), LOOKED_AT))
        if not widths:
            continue
        fields, n = max(widths.items(), key=lambda w: (w[1], w[0]))
        judged = (n / widths.total(), fields, -place)
        if fields >= 2 and (best is None or judged > best):
            best = judged
    return best and (DELIMITERS[-best[2]], best[1], best[0])


def delimiters(found: DataFrame) -> DataFrame:
    """path, delimiter, fields, confidence: the delimiter under which most of a file's first records have the same number of fields.

    A file is read and decoded once; under each delimiter it is split no further than those records. No shuffle.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(path, *j) for path, content in zip(batch["path"], batch["content"]) if (j := _judged(bytes(content or b"")))]
            yield pd.DataFrame(told, columns=["path", "delimiter", "fields", "confidence"])

    return found.select("path", "content").mapInPandas(judge, "path string, delimiter string, fields int, confidence double")


def header(rows: DataFrame) -> DataFrame:
    """path, record, cells, width of each file's header: the first record of the usual width of which under half the filled cells look like numbers.

    Records of one cell are prose and have no say in the width.
    """
    some = filled(rows).withColumn("fields", F.size("cells")).where("fields >= 2")
    width = some.groupBy("path", "fields").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "fields")).alias("w")).select("path", F.col("w.fields").alias("fields"))
    full = F.filter("cells", lambda c: F.trim(c) != "")
    numbers = F.filter(full, lambda c: F.trim(c).rlike(r"^[-+$(]?[0-9.,/\\-]+\)?$"))
    of = some.join(width, ["path", "fields"]).where(F.size(numbers) * 2 < F.size(full))
    return of.groupBy("path").agg(F.min(F.struct("record", "cells", "fields")).alias("h")).select("path", "h.record", "h.cells", F.col("h.fields").alias("width"))


def tokens(cells: Column) -> Column:
    """Header cells as they are compared: lower case, letters, digits and single spaces."""
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "^﻿", ""))), r"\s+", " "), "[^a-z0-9 ]", "")))


def signature(cells: Column) -> Column:
    return F.sha2(F.array_join(tokens(cells), "|"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard over the non-empty header tokens; two empty headers are alike."""
    x, y = (F.array_distinct(F.filter(tokens(c), lambda t: t != "")) for c in (a, b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def ledger_rows(rows: DataFrame, profile: dict) -> DataFrame:
    """path, row_index, line, date, description, cents, balance_cents, pending, error of each record below the header.

    ``profile``: date_format, columns (role to header name, or to a place from 0 on:
    transaction_date, posted_date, description, and amount or debit and credit; balance and status
    if any), invert, pending (status values), skip_lines (records that are not blank above the
    header), has_header. A record that cannot be read has an error, which says why, and null values;
    of a file that lacks a column that the profile names, every row has the error ``column``.
    """
    names = profile["columns"]
    skip, headed = profile.get("skip_lines"), profile.get("has_header", True)
    data = filled(rows)
    if skip is not None or not headed:
        # The place among the records that are not blank.
        data = data.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("record")) - 1).where(F.col("place") >= (skip or 0))
        if headed:
            top = data.where(F.col("place") == (skip or 0)).select("path", F.col("record").alias("top"), tokens(F.col("cells")).alias("names"))
            data = data.join(top, "path").where("record > top")
        else:
            data = data.withColumn("names", F.array().cast("array<string>"))
        data = data.drop("place")
    else:
        top = header(rows).select("path", F.col("record").alias("top"), tokens(F.col("cells")).alias("names"))
        data = data.join(top, "path").where("record > top")
    data = data.withColumn("row_index", F.row_number().over(Window.partitionBy("path").orderBy("record")) - 1)

    def place(role: str) -> Column:
        """From 1 on; 0 where a named column is not there."""
        if isinstance(names[role], int):
            return F.lit(names[role] + 1)
        return F.array_position("names", F.element_at(tokens(F.array(F.lit(names[role]))), 1)).cast("int")

    def cell(role: str) -> Column:
        if role not in names:
            return F.lit(None).cast("string")
        c = F.when(place(role) > 0, F.trim(F.get("cells", place(role) - 1)))
        return F.when(c != "", c)

    missing = F.lit(False)
    for role in names:
        missing = missing | (place(role) == 0)
    return _typed(data, profile, cell, missing)


def _typed(data: DataFrame, profile: dict, cell: Callable[[str], Column], missing: Column) -> DataFrame:
    """Ledger rows of path, row_index, line and the texts that ``cell`` gives for a role."""
    names = profile["columns"]
    date = dates.effective(dates.parse(cell("transaction_date"), profile["date_format"]), dates.parse(cell("posted_date"), profile["date_format"]))
    if "amount" in names:
        amount = money.parse(cell("amount"))
    else:
        debit, credit = cell("debit"), cell("credit")
        amount = F.when(debit.isNotNull() | credit.isNotNull(), F.when(credit.isNull(), 0).otherwise(F.abs(money.parse(credit))) - F.when(debit.isNull(), 0).otherwise(F.abs(money.parse(debit))))
    balance = money.parse(cell("balance"))
    if profile.get("invert"):
        amount, balance = -amount, -balance
    pending = F.coalesce(F.lower(cell("status")).isin(*profile.get("pending", [])), F.lit(False)) if profile.get("pending") else F.lit(False)
    out = data.select("path", "row_index", "line", missing.alias("missing"), date.alias("date"), F.coalesce(cell("description"), F.lit("")).alias("description"), amount.alias("cents"), balance.alias("balance_cents"), pending.alias("pending"))
    out = out.withColumn("error", F.when(F.col("missing"), "column").when(F.col("date").isNull(), "date").when(F.col("cents").isNull(), "amount"))
    return out.drop("missing")


#: Characters of a file up to which its records are kept, so that it is split once; a larger one is split twice.
KEPT = 4_000_000
_NUMBER = re.compile(r"[-+$(]?[0-9.,/\\-]+\)?(?:\r\n|[\n\r\u0085\u2028\u2029])?")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _token(cell: str) -> str:
    """:func:`tokens` of one cell."""
    return re.sub("[^a-z0-9 ]", "", _BLANKS.sub(" ", cell.removeprefix("\ufeff").strip(" ").lower())).strip(" ")


def _lines(whole: str, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """(line, cells) of the records that are not blank."""
    line = 1
    for raw, end in _split(whole, delimiter):
        cells = _cells(raw, delimiter)
        if any(c.strip(" ") for c in cells):
            yield line, cells
        line += len(re.findall(r"\r\n|\n|\r", raw + end)) if '"' in raw else len(end) > 0


def _below(whole: str, delimiter: str, skip: int | None, headed: bool) -> tuple[list[str], Iterator[tuple[int, list[str]]]] | None:
    """(header cells, the records below) of one file, by the rules of :func:`header` and :func:`ledger_rows`; None without a header."""
    found = list(_lines(whole, delimiter)) if len(whole) <= KEPT else None
    every = lambda: iter(found) if found is not None else _lines(whole, delimiter)
    if skip is not None or not headed:
        rest = itertools.islice(every(), skip or 0, None)
        if not headed:
            return [], rest
        top = next(rest, None)
        return top and (top[1], rest)
    widths = Counter(len(c) for _, c in every() if len(c) >= 2)
    if not widths:
        return None
    width = max(widths.items(), key=lambda w: (w[1], w[0]))[0]
    rest = every()
    for _, cells in rest:
        full = [c.strip(" ") for c in cells if c.strip(" ")]
        if len(cells) == width and sum(_NUMBER.fullmatch(c) is not None for c in full) * 2 < len(full):
            return cells, rest
    return None


def read(found: DataFrame, delimiter: str, profile: dict) -> DataFrame:
    """:func:`ledger_rows` of files (path, content) straight from their bytes: a task finds a file's header and the cells of each role, and nothing is shuffled."""
    names, skip, headed = profile["columns"], profile.get("skip_lines"), profile.get("has_header", True)
    roles = list(names)
    kinds = pa.schema([("path", pa.string()), ("row_index", pa.int32()), ("line", pa.int32()), ("missing", pa.bool_()), *((f"role_{r}", pa.string()) for r in roles)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds.types)], schema=kinds)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                got = _below(decode(content or b"").removeprefix("\ufeff"), delimiter, skip, headed)
                if got is None:
                    continue
                told = [_token(c) for c in got[0]]
                wanted = [names[r] if isinstance(names[r], int) else told.index(t) if (t := _token(names[r])) in told else -1 for r in roles]
                missing = -1 in wanted
                for n, (line, cells) in enumerate(got[1]):
                    rows.append((path, n, line, missing, *((cells[k].strip(" ") or None) if 0 <= k < len(cells) else None for k in wanted)))
                    if len(rows) >= HELD:
                        yield batch_of()
                        rows = []
        yield batch_of()

    ddl = "path string, row_index int, line int, missing boolean" + "".join(f", role_{r} string" for r in roles)
    data = found.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(split, ddl)
    return _typed(data, profile, lambda role: F.col(f"role_{role}") if role in names else F.lit(None).cast("string"), F.col("missing"))


def warnings(rows: DataFrame) -> DataFrame:
    """path, row_index, warning of ledger rows; a repeat of an earlier row points at its first."""
    by = Window.partitionBy("path", "date", "cents", text.collapse(F.col("description"))).orderBy("row_index")
    marked = rows.withColumn("first", F.when(F.col("error").isNull(), F.first("row_index").over(by)))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), "unparsed_row"),
            F.when(F.col("description") == "", "empty_description"),
            F.when(F.col("cents") == 0, "zero_amount"),
            F.when(F.col("pending"), "pending_row"),
            F.when(F.col("first") < F.col("row_index"), F.concat(F.lit("repeats:"), F.col("first").cast("string"))),
        )
    )
    return marked.select("path", "row_index", F.explode(kinds).alias("warning"))


def balance_check(rows: DataFrame, key: str = "path", order: str = "row_index") -> DataFrame:
    """key, status, direction, checked, failures: whether each balance is the one of the row before plus the amount, in file order or backwards.

    Only rows without an error count; of two neighbours, both must have a balance to be checked.
    """
    r = rows.where("error is null") if "error" in rows.columns else rows
    by = Window.partitionBy(key).orderBy(order)
    step = F.col("balance_cents") - F.lag("balance_cents").over(by)
    back = F.col("balance_cents") - F.lead("balance_cents").over(by)
    r = r.withColumns({"up": (step != F.col("cents")).cast("int"), "down": (back != F.col("cents")).cast("int")})
    return _balance_told(r.groupBy(key).agg(F.count("balance_cents").alias("n"), F.count("up").alias("checked"), F.sum("up").alias("up"), F.sum("down").alias("down")), key)


def _balance_told(g: DataFrame, key: str) -> DataFrame:
    least, enough = F.least("up", "down"), F.col("n") >= 2
    ok = (F.col("checked") > 0) & (least == 0)
    status = F.when(~enough, "unavailable").when(ok, "reconciled").otherwise("mismatch")
    direction = F.when(F.coalesce(F.col("up") <= F.col("down"), F.lit(True)), "ascending").otherwise("descending")
    return g.select(key, status.alias("status"), F.when(enough, direction).alias("direction"), F.when(enough, F.col("checked")).alias("checked"), F.when(enough, F.coalesce(least, F.lit(0).cast("long"))).alias("failures"))


def balance_check_in_order(rows: DataFrame) -> DataFrame:
    """:func:`balance_check` of rows as :func:`read` leaves them, a file's together and in order: no shuffle, no sort."""
    kinds = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("n", "checked", "up", "down"))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, open_counts = None, (0, False, 0), np.zeros(4, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            path = b.column("path")
            cents, balance = (pc.fill_null(b.column(c), 0).to_numpy() for c in ("cents", "balance_cents"))
            there = pc.is_valid(b.column("balance_cents")).to_numpy(zero_copy_only=False)
            same = np.empty(b.num_rows, bool)  # as the row before
            same[0] = last is not None and path[0].as_py() == last
            same[1:] = pc.equal(path.slice(1), path.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            old = [np.concatenate(([x], y[:-1])) for x, y in zip(before, (balance, there, cents))]
            both = same & there & old[1].astype(bool)
            step = balance - old[0]
            counts = np.stack([there, both, both & (step != cents), both & (-step != old[2])]).astype(np.int64)
            starts = np.flatnonzero(~same)
            names, sums = [], np.zeros((4, 0), np.int64)
            if len(starts):
                open_counts += counts[:, : starts[0]].sum(1)
                sums = np.add.reduceat(counts, starts, axis=1)
                sums = np.concatenate((open_counts[:, None], sums), axis=1)
                names = [last, *path.take(pa.array(starts)).to_pylist()]
                last, open_counts = names.pop(), sums[:, -1].copy()
                sums = sums[:, :-1]
                if names[0] is None:
                    names, sums = names[1:], sums[:, 1:]
            else:
                open_counts += counts.sum(1)
            before = (balance[-1], there[-1], cents[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, sums)], schema=kinds)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), *(pa.array([x]) for x in open_counts)], schema=kinds)

    told = rows.select("path", "cents", "balance_cents", "error").mapInArrow(lambda batches: check(b.filter(pc.is_null(b.column("error"))) for b in batches), "path string, n long, checked long, up long, down long")
    return _balance_told(told, "path")


def sign_check(rows: DataFrame, key: str = "path", account_type: str | None = "checking") -> DataFrame:
    """key of deposit accounts most of whose balances, of three at least, are below zero; none for other accounts, whose balances are debts."""
    if account_type not in ("checking", "savings"):
        return rows.select(key).limit(0)
    g = rows.where("balance_cents <> 0").groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col("balance_cents") < 0).cast("int")).alias("below"))
    return g.where("n >= 3 and below * 2 > n").select(key)


def period(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, start, end of the rows that could be read."""
    return rows.where("error is null").groupBy(key).agg(F.min("date").alias("start"), F.max("date").alias("end"))


def detected(found: DataFrame, profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """path, delimiter, state, skip_lines, profile, similarity of each file against ``profiles`` (profile, signature, tokens).

    ``matched`` has the profile of the same signature; ``needs_mapping`` a row for each profile that is alike enough, the most alike first,
    or one without; ``undetectable`` has no delimiter or header. Files and profiles meet on shared header words.
    """
    guess = delimiters(found).select("path", "delimiter")
    each = header(records(found.select("path", "content").join(guess, "path"), None)).join(guess, "path")
    heads = found.select("path").join(each, "path", "left").withColumn("signature", F.when(F.col("cells").isNotNull(), signature(F.col("cells"))))
    hit = heads.join(profiles.select("profile", "signature"), "signature")
    rest = heads.where("cells is not null").join(hit.select("path"), "path", "left_anti")
    word = rest.select("path", "cells", F.explode(F.array_distinct(tokens(F.col("cells")))).alias("word")).where("word <> ''")
    near = word.join(profiles.select("profile", "tokens", F.explode(F.array_distinct("tokens")).alias("word")), "word").select("path", "cells", "profile", "tokens").distinct()
    near = near.withColumn("similarity", likeness(F.col("cells"), F.col("tokens"))).where(F.col("similarity") >= least).select("path", "profile", "similarity")
    out = hit.select("path", "delimiter", F.lit("matched").alias("state"), "record", "profile", F.lit(1.0).alias("similarity"))
    out = out.unionByName(rest.join(near, "path", "left").select("path", "delimiter", F.lit("needs_mapping").alias("state"), "record", "profile", "similarity"))
    none = heads.where("cells is null").select("path", F.lit(None).cast("string").alias("delimiter"), F.lit("undetectable").alias("state"), F.lit(None).cast("int").alias("record"), F.lit(None).cast("string").alias("profile"), F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(none)


def confidence(content: Column, detected_state: Column) -> Column:
    """How sure the CSV reader is of a file: 0 for what is no text, 0.1 for text, 0.6 where a profile matches."""
    return F.when(kind(content) != "csv", 0.0).when(detected_state == "matched", 0.6).otherwise(0.1)
