"""Fees: which rows are fees, reversals netted one to one, one finding for each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import half_up
from .rules import spend
from .walks import queued

#: Words of a fee, in this order; phrases that are none; words that take a fee back; avoidable kinds.
KEYWORDS = ["INTEREST CHARGE", "CASH ADVANCE FEE", "LATE FEE", "ANNUAL MEMBERSHIP FEE", "OVERDRAFT", "NSF", "RETURNED ITEM", "FOREIGN TRANSACTION", "ATM FEE", "MONTHLY MAINTENANCE", "MINIMUM BALANCE"]
NOT_FEES = ["INTEREST CHECKING", "INTEREST EARNED"]
UNDONE = ["REFUND", "REVERSAL", "CREDIT", "WAIVED", "ADJUSTMENT"]
AVOIDABLE = ["MONTHLY MAINTENANCE", "MINIMUM BALANCE"]
CATEGORY = "fee category"  # what a fee is called that only its category tells


def phrase(text: Column, words: str) -> Column:
    """Whether the first occurrence of ``words`` stands as whole words."""
    at = F.instr(text, words)
    before = (at == 1) | ~F.substr(text, at - 1, F.lit(1)).rlike("[A-Z0-9]")
    after = ~F.substr(text, at + len(words), F.lit(1)).rlike("[A-Z0-9]")
    return (at > 0) & before & after


def fees(ledger: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """id, account, date, x, keyword of the eligible rows that are fees; keyword is null where the category alone says so."""
    text = F.col("normalized")
    rows = spend(ledger)
    for words in NOT_FEES:
        rows = rows.where(~text.contains(words))
    for words in UNDONE:
        rows = rows.where(~phrase(text, words))
    found = F.coalesce(*(F.when(phrase(text, k), F.lit(k)) for k in KEYWORDS))
    rows = rows.withColumn("keyword", found)
    if categories is not None:
        rows = rows.join(categories.select("category", "kind"), "category", "left")
    else:
        rows = rows.withColumn("kind", F.lit(None).cast("string"))
    return rows.where("keyword is not null or kind = 'fee'").select("id", "account", "date", "x", "keyword")


def reversals(found: DataFrame, ledger: DataFrame, days: int = 60) -> DataFrame:
    """debit, credit: each fee, by date, takes the earliest equal credit of its account within ``days`` after."""
    c = ledger.where("cents > 0 and not pending and not excluded").select("id", "account", F.col("cents").alias("x"), F.col("date").alias("day"))
    return queued(found.select("account", "x", "id", F.col("date").alias("day")), c, days, ["account", "x"])


def findings(found: DataFrame, netted: DataFrame) -> DataFrame:
    """account, n, total, months, annual, avoidable, impact, kind, confidence, breakdown of the fees that were not reversed.

    A fee is avoidable if its own keyword is, and comes twice at the account.
    """
    left = found.join(netted.select(F.col("debit").alias("id")), "id", "left_anti")
    name = F.coalesce("keyword", F.lit(CATEGORY))
    each = left.groupBy("account", name.alias("name")).agg(F.count("*").alias("n"), F.sum("x").alias("cents"), F.min("date").alias("a"), F.max("date").alias("b"))
    g = each.groupBy("account").agg(
        F.sum("n").alias("n"), F.sum("cents").alias("total"), F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.col("name") != CATEGORY).alias("by_word"),
        F.coalesce(F.sum(F.when(F.col("name").isin(AVOIDABLE) & (F.col("n") >= 2), F.col("cents"))), F.lit(0)).alias("avoidable"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("n", "cents"))))).alias("breakdown"),
    )
    months = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a") + 1
    g = g.withColumn("months", months)
    yearly = lambda c: half_up(F.col(c) * 12 / F.col("months"))
    saves = F.col("avoidable") > 0
    return g.select("account", "n", "total", "months", yearly("total").alias("annual"), "avoidable", F.when(saves, yearly("avoidable")).otherwise(yearly("total")).alias("impact"), F.when(saves, "savings").otherwise("visibility").alias("kind"), F.when(F.col("by_word"), 0.95).otherwise(0.75).alias("confidence"), "breakdown")
