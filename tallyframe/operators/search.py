"""Searches over a ledger, with parameters, a page and a total; patches of what a search finds; export."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transfers import keyword, words

#: Columns to sort by; each order ends in the id.
ORDERS = {"date_desc": ("date", True), "date_asc": ("date", False), "amount_desc": ("cents", True), "amount_asc": ("cents", False)}


@dataclass(frozen=True)
class Query:
    """All conditions that are given must hold; transfers and excluded rows are hidden unless asked for."""

    accounts: list | None = None
    merchants: list | None = None
    categories: list | None = None
    descriptors: list | None = None
    start: str | None = None  # a date range counts with both ends only
    end: str | None = None
    least: int | None = None
    most: int | None = None
    pending: bool | None = None
    has_finding: bool | None = None
    text: str | None = None
    transfers: bool = False
    excluded: bool = False
    order: str = "date_desc"
    limit: int = 100
    offset: int = 0
    extra: dict[str, Any] = field(default_factory=dict)


def matching(ledger: DataFrame, q: Query, evidence: DataFrame | None = None) -> DataFrame:
    """The rows that a query finds; its text is found literally, whatever its case, in either form of the descriptor."""
    out = ledger
    for column, values in (("account", q.accounts), ("merchant", q.merchants), ("category", q.categories), ("normalized", q.descriptors)):
        if values is not None:
            out = out.where(F.col(column).isin(values))
    if q.start is not None and q.end is not None:
        out = out.where(F.col("date").between(q.start, q.end))
    if q.least is not None:
        out = out.where(F.col("cents") >= q.least)
    if q.most is not None:
        out = out.where(F.col("cents") <= q.most)
    if q.pending is not None:
        out = out.where(F.col("pending") == q.pending)
    if q.text:
        part = F.lit(q.text.lower())
        out = out.where(F.lower(F.coalesce("raw", F.lit(""))).contains(part) | F.lower(F.coalesce("normalized", F.lit(""))).contains(part))
    if not q.transfers:
        out = out.where("not transfer")
    if not q.excluded:
        out = out.where("not excluded")
    if q.has_finding is not None and evidence is not None:
        out = out.join(evidence.select(F.col("transaction").alias("id")).distinct(), "id", "left_semi" if q.has_finding else "left_anti")
    return out


def page(ledger: DataFrame, q: Query, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a page of 1 to 1000 rows in order; the total)."""
    found = matching(ledger, q, evidence)
    column, down = ORDERS[q.order]
    rows = found.orderBy(F.desc(column) if down else F.asc(column), "id").offset(q.offset).limit(max(1, min(1000, q.limit)))
    return rows, found.agg(F.count("*").alias("total"))


def descriptors(ledger: DataFrame, q: Query) -> DataFrame:
    """normalized, n of what a query finds."""
    return matching(ledger, q).groupBy("normalized").agg(F.count("*").alias("n"))


def patched(ledger: DataFrame, q: Query, patch: dict[str, Any]) -> DataFrame:
    """The ledger with the named columns set in the rows that a query finds; an empty patch changes nothing."""
    if not patch:
        return ledger
    hit = ledger.join(matching(ledger, q).select("id", F.lit(True).alias("hit")), "id", "left")
    value = lambda c: F.when(F.col("hit"), F.lit(patch[c]).cast(ledger.schema[c].dataType)).otherwise(F.col(c))
    return hit.withColumns({c: value(c) for c in patch}).select(*ledger.columns)


def unlinked_by_account(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """account, n of debits that read as a transfer and have no link."""
    rows = ledger.where("cents < 0").where(keyword(words(ledger))).join(links.select(F.col("debit").alias("id")), "id", "left_anti")
    return rows.groupBy("account").agg(F.count("*").alias("n"))


def csv_cell(c: Column) -> Column:
    """Quoted only where it holds a quote, a comma or a line break."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(t, '"', '""'), F.lit('"'))).otherwise(t)


def csv_lines(ledger: DataFrame) -> DataFrame:
    """id, line: the rows as lines of a CSV file, by date."""
    return ledger.select("date", "id", F.concat_ws(",", *(csv_cell(F.col(c)) for c in ledger.columns)).alias("line")).orderBy("date", "id").select("id", "line")


def export(ledger: DataFrame, folder: str, kind: str = "csv") -> None:
    """All rows by date, as JSON or as CSV lines with a header in each file's first line."""
    rows = ledger.orderBy("date", "id")
    if kind == "json":
        rows.write.mode("overwrite").json(folder)
    else:
        rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def spend_by_category(ledger: DataFrame) -> DataFrame:
    return ledger.where("cents < 0 and not transfer and not excluded").groupBy("category").agg(F.count("*").alias("n"), (-F.sum("cents")).alias("cents"))


def top_merchants(ledger: DataFrame, k: int = 10) -> DataFrame:
    g = ledger.where("cents < 0 and not transfer and not excluded").groupBy("merchant").agg(F.count("*").alias("n"), (-F.sum("cents")).alias("cents"))
    return g.orderBy(F.desc("cents"), "merchant").limit(k)


def movers(ledger: DataFrame) -> DataFrame:
    """category, month, cents, change against the month before in which the category has rows."""
    from pyspark.sql import Window

    g = ledger.where("cents < 0 and not transfer and not excluded").groupBy("category", F.trunc("date", "month").alias("month")).agg((-F.sum("cents")).alias("cents"))
    return g.withColumn("change", F.col("cents") - F.lag("cents").over(Window.partitionBy("category").orderBy("month")))
