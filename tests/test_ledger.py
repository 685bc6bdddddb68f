import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import money, text
from tallyframe.operators import matching, rules


@pytest.mark.parametrize(
    "raw, cents",
    [("12.50", 1250), ("-3", -300), ("(1,234.05)", -123405), ("$9.9", 990), ("USD 7", 700), ("1,23", None), ("5-", -500), ("(-2.00)", 200), ("", None), ("abc", None), ("1,000,000.10", 100000010), ("--5", None), ("12.", None)],
)
def test_money(spark, raw, cents):
    assert spark.range(1).select(money.parse(F.lit(raw))).first()[0] == cents


def test_show(spark):
    assert [r[0] for r in spark.createDataFrame([(-123405,), (7,), (0,)], "c long").select(money.show(F.col("c"))).collect()] == ["-$1,234.05", "$0.07", "$0.00"]


def test_collapse(spark):
    assert spark.range(1).select(text.collapse(F.lit("  Café  déjà-vu #12 Łódź "))).first()[0] == "CAFE DEJA VU 12 ODZ"


def test_outlier_of_a_known_group(spark):
    rows = [(i, -c, 1) for i, c in enumerate([2300, 2400, 2200, 2350, 2450, 41200])]
    got = rules.outliers(spark.createDataFrame(rows, "id long, cents long, merchant long"), "merchant", 5).collect()
    assert [(r.id, r.impact, r.confidence) for r in got] == [(5, 41200 - 2375, 0.9)]


@pytest.mark.parametrize("gaps, days", [([30, 61], 30.44), ([30, 91], 30.44), ([28] * 4, 30.44), ([14, 14, 14], 14.0), ([10, 47, 3], None), ([28] * 6, 28.0)])
def test_cadence(spark, gaps, days):
    at, rows = 0, [(0, -100, 1)]
    for g in gaps:
        at += g
        rows.append((at, -100, 1))
    d = spark.createDataFrame(rows, "id long, cents long, m long").withColumn("date", F.expr("date_add(date'2024-01-01', cast(id as int))"))
    assert [r.days for r in rules.cadences(d, "m").collect()] == ([] if days is None else [days])
