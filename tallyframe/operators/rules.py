"""Analysis rules over a ledger (id, date, cents, ...), each a plan of DataFrame operations.

Only rows that leave money and are not pending take part (:func:`spend`). Thresholds are
parameters; their defaults are the fixed values of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up


def spend(ledger: DataFrame) -> DataFrame:
    """The eligible rows, with their magnitude x: money out, not pending, excluded, transferred or refunded, as far as the ledger tells."""
    rows = ledger.where("cents < 0")
    for flag in ("pending", "excluded", "transfer"):
        if flag in ledger.columns:
            rows = rows.where(~F.col(flag))
    if "refund_pair" in ledger.columns:
        rows = rows.where("refund_pair is null")
    return rows.withColumn("x", -F.col("cents"))


#: Cells of a group whose values are ranked, and the distinct values from which on a group has more than one.
CELLS, ALONE = 256, 4096


def ranked(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """keys, n, name: the exact ``p``-quantile of each group, linear between ranks, whatever the group's size.

    Rows are first counted by value. A group of many values is dealt to cells whose borders are
    approximate quantiles of its distinct values, so cells hold about equally many however the values
    are spread; the cells' counts tell which of them hold the two ranks next to the quantile, and only
    these cells' values are ranked. Borders decide balance alone: the result is exact for any borders.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    borders = F.percentile_approx("v", [k / CELLS for k in range(1, CELLS)], 4 * CELLS)
    ends = counts.groupBy(*keys).agg(F.sum("m").alias("n"), F.when(F.count("*") > ALONE, borders).alias("borders"))
    cell = F.when(F.col("borders").isNull(), 0).otherwise(F.size(F.filter("borders", lambda b: b < F.col("v"))))
    # Null keys are a group of their own.
    same = lambda a, b, on: a.join(b.withColumnsRenamed({k: f"{k}__" for k in on}), [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in on]).drop(*(f"{k}__" for k in on))
    placed = same(counts, ends, keys).withColumn("cell", cell).drop("borders")
    at = (F.col("n") - 1) * p
    cells = placed.groupBy(*keys, "cell").agg(F.sum("m").alias("held"), F.first("n").alias("n"))
    cells = cells.withColumn("before", F.sum("held").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("held"))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("held"))
    cells = cells.where(holds(F.floor(at)) | holds(F.ceil(at))).select(*keys, "cell", "before")
    within = F.sum("m").over(Window.partitionBy(*keys, "cell").orderBy("v"))
    upto = same(placed, cells, [*keys, "cell"]).withColumn("upto", F.col("before") + within)
    # The quantile lies between the values of two neighbouring ranks.
    hit = lambda k: (F.col("upto") - F.col("m") <= k) & (k < F.col("upto"))
    pick = upto.where(hit(F.floor(at)) | hit(F.ceil(at))).groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("n").alias("n"))
    part = at - F.floor(at)
    return pick.select(*keys, "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias(name))


def robust(rows: DataFrame, key: str, value: str = "x") -> DataFrame:
    """key, n, med, mad: exact median and median absolute deviation."""
    med = ranked(rows, [key], value, 0.5, "med")
    off = ranked(rows.join(med, key).withColumn("off", F.abs(F.col(value) - F.col("med"))), [key], "off", 0.5, "mad")
    return med.join(off.drop("n"), key)


def outliers(ledger: DataFrame, key: str, least: int, excess: int = 2500, z: float = 3.5, times: float = 3.0) -> DataFrame:
    """id, grp, cents, impact, confidence of rows far above their group's median."""
    rows = spend(ledger)
    s = rows.join(robust(rows, key).where(F.col("n") >= least), key)
    score = 0.6745 * (F.col("x") - F.col("med")) / F.when(F.col("mad") > 0, F.col("mad"))
    s = s.withColumn("z", score).where(F.col("x") - F.col("med") >= excess)
    flagged = s.where(F.when(F.col("mad") == 0, F.col("x") > times * F.col("med")).otherwise(F.abs("z") > z))
    confidence = F.when(F.col("mad") == 0, 0.7).otherwise(F.least(F.lit(0.9), 0.6 + (F.abs("z") - z) * 0.05))
    return flagged.select("id", F.col(key).alias("grp"), "cents", half_up(F.col("x") - F.col("med")).alias("impact"), confidence.alias("confidence"))


def yearly(ledger: DataFrame, least: int = 50, floor: int = 20000, top: int = 10, charges: DataFrame | None = None) -> DataFrame:
    """year, place, id, cents: the largest rows at or above the year's 99th percentile; ``charges`` (id) of series are no part of either."""
    rows = spend(ledger).withColumn("year", F.year("date"))
    if charges is not None:
        rows = rows.join(charges.select(F.col("id").cast(ledger.schema["id"].dataType)), "id", "left_anti")
    p = ranked(rows, ["year"], "x", 0.99, "p99").where(F.col("n") >= least)
    big = rows.join(p, "year").where((F.col("x") >= floor) & (F.col("x") >= F.col("p99")))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("x"), "id"))
    return big.withColumn("place", place).where(F.col("place") <= top).select("year", "place", "id", "cents")


def windows(ledger: DataFrame, charges: DataFrame) -> DataFrame:
    """year, n, impact: one finding a year of its largest rows beside the series, by what they come to."""
    return yearly(ledger, charges=charges).groupBy("year").agg(F.count("*").alias("n"), (-F.sum("cents")).alias("impact"))


def whole_months(ledger: DataFrame) -> DataFrame:
    """month: those that the ledger covers from the first day to the last; its edge months are covered in part only."""
    ends = ledger.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first = F.when(F.col("a") == F.trunc("a", "month"), F.col("a")).otherwise(F.add_months(F.trunc("a", "month"), 1))
    last = F.when(F.col("b") == F.last_day("b"), F.trunc("b", "month")).otherwise(F.add_months(F.trunc("b", "month"), -1))
    return ends.select(first.alias("first"), last.alias("last")).where("first <= last").select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))


def monthly(ledger: DataFrame, key: str, months: DataFrame | None = None) -> DataFrame:
    """key, month, total: spend by calendar month, zero-filled over ``months`` (month), else over the ledger's whole months."""
    rows = spend(ledger).withColumn("month", F.trunc("date", "month"))
    months = whole_months(ledger) if months is None else months.select("month").distinct()
    # A row a month for each key: the calendar, one row of at most 12 months a year, is joined to each.
    calendar = months.agg(F.collect_list("month").alias("months")).withColumn("one", F.lit(1))
    spine = rows.select(key, F.lit(1).alias("one")).distinct().join(F.broadcast(calendar), "one").select(key, F.explode("months").alias("month"))
    sums = rows.groupBy(key, "month").agg(F.sum("x").alias("total"))
    return spine.join(sums, [key, "month"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def spikes(ledger: DataFrame, key: str, excess: int = 7500, share: float = 0.4, totals: DataFrame | None = None) -> DataFrame:
    """key, month, total, before: months well above the mean of the three before; the first of each month of the year counts.

    ``totals`` are those of :func:`monthly`, else the ledger's. The three before are the last three of
    its months, whether or not the calendar has others between.
    """
    m = monthly(ledger, key) if totals is None else totals
    by = Window.partitionBy(key).orderBy("month").rowsBetween(-3, -1)
    m = m.withColumns({"before": F.avg("total").over(by), "low": F.min("total").over(by), "k": F.count("*").over(by)})
    hit = m.where((F.col("k") == 3) & (F.col("low") > 0) & (F.col("total") - F.col("before") > excess) & (F.col("total") - F.col("before") > share * F.col("before")))
    once = F.row_number().over(Window.partitionBy(key, F.month("month")).orderBy("month"))
    return hit.withColumn("turn", once).where("turn = 1").select(F.col(key).alias("grp"), "month", "total", "before")


def climbs(ledger: DataFrame, key: str, steps: int = 3, rise: int = 5000, share: float = 0.25, totals: DataFrame | None = None) -> DataFrame:
    """grp, first_month, last_month, rise: maximal runs of rising months, well beyond the usual change."""
    by = Window.partitionBy(key).orderBy("month")
    m = (monthly(ledger, key) if totals is None else totals).withColumn("delta", F.col("total") - F.lag("total").over(by))
    # A group has one value a month at most, so a task can hold it.
    med = m.groupBy(key).agg(F.median("delta").alias("med"))
    usual = m.join(med, key).groupBy(key).agg(F.median(F.abs(F.col("delta") - F.col("med"))).alias("mad"))
    m = m.withColumn("island", F.sum(F.when(F.col("delta") > 0, 0).otherwise(1)).over(by))
    runs = m.groupBy(key, "island").agg(F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.min("total").alias("low"), F.max("total").alias("high"))
    runs = runs.where(F.col("n") >= steps + 1).join(usual, key).withColumn("rise", F.col("high") - F.col("low"))
    ok = (F.col("low") > 0) & (F.col("rise") > rise) & (F.col("rise") > share * F.col("low")) & (F.col("rise") > 2 * F.col("mad"))
    return runs.where(ok).select(F.col(key).alias("grp"), "first_month", "last_month", "rise")


def micro(ledger: DataFrame, per_month: float = 8, most: int = 1500, least_months: int = 3, share: float = 0.8, covered: DataFrame | None = None) -> DataFrame:
    """kind (merchant, category), grp, n, monthly, annual: frequent small spend; a category that one qualified merchant makes up is left out."""
    months = whole_months(ledger) if covered is None else covered.select("month").distinct()
    rows = spend(ledger).withColumn("month", F.trunc("date", "month")).join(F.broadcast(months), "month")
    n = months.agg(F.count("*").alias("months")).withColumn("one", F.lit(1))

    def frequent(key: str) -> DataFrame:
        rank = ranked(rows.where(F.col(key).isNotNull()), [key], "x", 0.5, "med")
        g = rows.groupBy(key).agg(F.sum("x").alias("total"), F.lit(1).alias("one")).join(rank, key).join(F.broadcast(n), "one")
        return g.where((F.col("months") >= least_months) & (F.col("n") / F.col("months") >= per_month) & (F.col("med") <= most))

    by_merchant, by_category = frequent("merchant"), frequent("category")
    own = rows.join(by_merchant.select("merchant"), "merchant", "left_semi").groupBy("category", "merchant").agg(F.sum("x").alias("own")).groupBy("category").agg(F.max("own").alias("own"))
    by_category = by_category.join(own, "category", "left").where(F.coalesce("own", F.lit(0)) <= share * F.col("total"))
    each = half_up(F.col("total") / F.col("months"))
    show = lambda g, key: g.select(F.lit(key).alias("kind"), F.col(key).cast("string").alias("grp"), "n", each.alias("monthly"), (each * 12).alias("annual"))
    return show(by_merchant, "merchant").unionByName(show(by_category, "category"))


#: Days of each cadence, tolerance, turns a year.
CADENCES = [(7.0, 2.0, 52.18), (14.0, 2.0, 26.09), (28.0, 2.0, 13.04), (30.44, 4.0, 12.0), (91.3, 7.0, 4.0), (182.6, 12.0, 2.0), (365.25, 20.0, 1.0)]


def cadences(ledger: DataFrame, key: str, least: int = 3) -> DataFrame:
    """grp, days, score: the cadence that all gaps between a group's rows fit, up to three turns at once."""
    by = Window.partitionBy(key).orderBy("date", "id")
    gaps = spend(ledger).withColumn("gap", F.datediff("date", F.lag("date").over(by))).where("gap is not null")
    fits = gaps.withColumn("c", F.explode(F.array(*(F.struct(F.lit(d).alias("days"), F.lit(t).alias("tol")) for d, t, _ in CADENCES))))
    fits = fits.withColumn("k", F.floor(F.col("gap") / F.col("c.days") + 0.5))
    g = fits.groupBy(key, "c.days", "c.tol").agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.avg("k").alias("turns"),
        F.median(F.abs(F.col("gap") - F.col("k") * F.col("c.days"))).alias("score"), F.min("gap").alias("shortest"), F.max("gap").alias("longest"),
    )
    ok = g.where((F.col("n") + 1 >= least) & (F.col("low") >= 1) & (F.col("high") <= 3) & (F.col("score") <= F.col("tol")))
    # Four weeks against a month: four weeks only on strict evidence, and both before any other.
    by = Window.partitionBy(key)
    both = (F.max((F.col("days") == 28.0).cast("int")).over(by) == 1) & (F.max((F.col("days") == 30.44).cast("int")).over(by) == 1)
    strict = (F.col("shortest") >= 27) & (F.col("longest") <= 29) & (F.col("n") + 1 >= 6)
    wins = F.when(both, F.col("days") == F.when(strict, 28.0).otherwise(30.44)).otherwise(F.lit(True))
    ok = ok.withColumn("wins", wins).where("wins")
    place = F.row_number().over(by.orderBy("score", "turns", "days"))
    return ok.withColumn("place", place).where("place = 1").select(F.col(key).alias("grp"), "days", "score")
