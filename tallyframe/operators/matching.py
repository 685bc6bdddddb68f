"""Joins that pair ledger rows: transfers, bags of rows, near duplicates. :mod:`walks` makes them one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(day: Column, days: int) -> Column:
    """A date's span of ``days`` days, by number: it stands in join keys beside an amount that many rows may share."""
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)


def _buckets(first: Column, last: Column, days: int) -> Column:
    """The spans that a range of dates meets."""
    return F.explode(F.sequence(_bucket(first, days), _bucket(last, days)))


def transfer_candidates(ledger: DataFrame, early: int = 1, late: int = 7, carried: Sequence[str] = ()) -> DataFrame:
    """debit, credit, cents, gap: equal to the cent, other account, credit from a day before to a week after.

    ``carried``: columns that come along, as d_... and c_... of either side. Only rows are shuffled,
    pairs leave the join as they are made.
    """
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in carried]
    d = ledger.where("cents < 0").select(F.col("id").alias("debit"), F.col("account").alias("da"), F.col("date").alias("dd"), (-F.col("cents")).alias("cents"), *side("d"))
    c = ledger.where("cents > 0").select(F.col("id").alias("credit"), F.col("account").alias("ca"), F.col("date").alias("cd"), "cents", *side("c"))
    d = d.withColumn("span", _buckets(F.date_sub("dd", early), F.date_add("dd", late), 8))
    gap = F.datediff("cd", "dd")
    pairs = d.join(c.withColumn("span", _bucket("cd", 8)), ["cents", "span"])
    return pairs.where((F.col("da") != F.col("ca")) & gap.between(-early, late)).select("debit", "credit", "cents", gap.alias("gap"), *(f"{p}_{c}" for p in "dc" for c in carried))


def bag_difference(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """What a merge inserts for each key: incoming beyond existing, as counts."""
    a = existing.groupBy(*keys).agg(F.count("*").alias("stored"))
    b = incoming.groupBy(*keys).agg(F.count("*").alias("incoming"))
    return b.join(a, list(keys), "left").withColumn("inserts", F.col("incoming") - F.coalesce("stored", F.lit(0))).where("inserts > 0").select(*keys, "incoming", "inserts")


def near_duplicates(existing: DataFrame, incoming: DataFrame, days: int = 3, cents: int = 200, percent: int = 3) -> DataFrame:
    """account, key, incoming, existing, off: rows (id, account, key, date, cents) alike in account and key, but not in date and amount, within the bounds."""
    a = existing.select(F.col("id").alias("existing"), "account", "key", F.col("date").alias("ad"), F.col("cents").alias("ac"))
    b = incoming.select(F.col("id").alias("incoming"), "account", "key", F.col("date").alias("bd"), F.col("cents").alias("bc"))
    off = F.col("bc") - F.col("ac")
    near = (F.abs(F.datediff("bd", "ad")) <= days) & ((F.abs(off) <= cents) | (F.abs(off) * 100 <= percent * F.abs("ac")))
    other = (F.col("ad") != F.col("bd")) | (off != 0)
    a = a.withColumn("span", _bucket("ad", 2 * days + 1))
    b = b.withColumn("span", _buckets(F.date_sub("bd", days), F.date_add("bd", days), 2 * days + 1))
    return b.join(a, ["account", "key", "span"]).where(near & other).select("account", "key", "incoming", "existing", off.alias("off"))


def refund_candidates(ledger: DataFrame, days: int = 90) -> DataFrame:
    """debit, credit, gap: opposite amounts at one account and merchant, the credit up to ``days`` after."""
    d = ledger.where("cents < 0").select(F.col("id").alias("debit"), "account", "merchant", (-F.col("cents")).alias("cents"), F.col("date").alias("dd"))
    c = ledger.where("cents > 0").select(F.col("id").alias("credit"), "account", "merchant", "cents", F.col("date").alias("cd"))
    gap = F.datediff("cd", "dd")
    d = d.withColumn("span", _buckets(F.col("dd"), F.date_add("dd", days), days + 1))
    c = c.withColumn("span", _bucket("cd", days + 1))
    return d.join(c, ["account", "merchant", "cents", "span"]).where(gap.between(0, days)).select("debit", "credit", gap.alias("gap"))


def common_months(ledger: DataFrame) -> DataFrame:
    """month of every calendar month in which all accounts have rows."""
    each = ledger.select("account", F.trunc("date", "month").alias("month")).distinct()
    accounts = ledger.agg(F.count_distinct("account").alias("accounts"))
    months = each.groupBy("month").agg(F.count("*").alias("accounts"))
    return months.join(F.broadcast(accounts), "accounts").select("month")
