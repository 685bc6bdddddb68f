"""Trends of categories over covered months, without what a single series makes up; the largest are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up
from . import rules
from .walks import held

#: A series' share of a category beyond which the category is the series' own, findings of each kind a run.
SHARE, TOP = 0.8, 5


def charges(found: DataFrame) -> DataFrame:
    """series, id of every charge of every series."""
    return found.select("series", F.explode("charges").alias("id"))


def dominated(ledger: DataFrame, members: DataFrame, share: float = SHARE) -> DataFrame:
    """category: a single series (``members``: series, id) makes up more than ``share`` of its eligible spend, over all months.

    Summed by series and category, then the largest of each category: no task holds a category's rows.
    """
    rows = ledger.where("category is not null").withColumn("id", F.col("id").cast("string"))
    own = rows.select("id", "category", "cents").join(members.select("series", F.col("id").cast("string").alias("id")), "id")
    own = own.groupBy("category", "series").agg(F.sum(F.abs("cents")).alias("own")).groupBy("category").agg(F.max("own").alias("own"))
    whole = rules.spend(rows).groupBy("category").agg(F.sum("x").alias("whole"))
    return own.join(whole, "category").where(F.col("own") / F.col("whole") > share).select("category")


def trends(ledger: DataFrame, months: DataFrame, categories: DataFrame, members: DataFrame, top: int | None = TOP) -> DataFrame:
    """kind (spike, climb), category, month, impact (a year's cents), place: the ``top`` of each kind by impact, ties by category, then month.

    ``months`` (month) are those proven complete in every account; without any there are no trends.
    ``categories``: category, kind; only those of kind spend take part, and none that one series makes up.
    A spike happened once and counts its excess; a climb stays and counts twelve times its rise, told in its last month.
    """
    rows = ledger.where("category is not null").join(categories.where("kind = 'spend'").select("category").distinct(), "category", "left_semi")
    rows = rows.join(dominated(ledger, members), "category", "left_anti")
    # A row a category and month, read by both rules and stored for them.
    totals = held(rules.monthly(rows, "category", months))
    spikes = rules.spikes(rows, "category", totals=totals).select(F.lit("spike").alias("kind"), F.col("grp").alias("category"), "month", half_up(F.col("total") - F.col("before")).alias("impact"))
    climbs = rules.climbs(rows, "category", totals=totals).select(F.lit("climb").alias("kind"), F.col("grp").alias("category"), F.col("last_month").alias("month"), (F.col("rise") * 12).alias("impact"))
    # Few rows a category: those that met a rule.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.abs("impact")), "category", "month"))
    out = spikes.unionByName(climbs).withColumn("place", place)
    return out if top is None else out.where(F.col("place") <= top)
