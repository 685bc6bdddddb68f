"""One analysis over a snapshot: the findings of the single rules, one schema, the row guard."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import coverage, fees, findings, rules, run, series, trends

DAY = datetime.date
ROWS = "id string, account string, date date, cents long, normalized string, merchant string, category string, pending boolean, transfer boolean, excluded boolean, refund_pair string"


def ledger(spark):
    row = lambda i, day, cents, text, merchant, category, pending=False: (i, "a", day, -cents, text, merchant, category, pending, False, False, None)
    month = lambda k, day=5: DAY(2025 + (k // 12), k % 12 + 1, day)
    rows = [row(f"n{k}", month(k), 1500 if k < 8 else 1900, "STREAM", "n", "video") for k in range(14)]
    rows += [row(f"m{k}", month(k, 20), 900, "OTHER STREAM", "m", "video") for k in range(14)]
    rows += [row(f"q{k}", month(k, 9), 1000, "GYM TRIAL", "q", "sport") for k in range(4)]  # stopped
    rows += [row(f"f{k}", month(k, 28), 1200, "MONTHLY MAINTENANCE", None, "bank") for k in range(3)] + [row("f9", month(3, 28), 3500, "LATE FEE", None, "bank")]
    rows += [row(f"g{k}", month(k % 14, 1 + k // 14), 2000 + k, "MARKET", "g", "food") for k in range(56)] + [row("big", month(6, 16), 90000, "MARKET", "g", "food"), row("p", month(7, 16), 90000, "MARKET", "g", "food", True)]
    rows += [row(f"s{k}", month(k % 14, 1 + k // 14), 400, "KIOSK", "s", "snack") for k in range(14 * 12)]
    return spark.createDataFrame(rows, ROWS)


def tables(spark):
    merchants = spark.createDataFrame([(m, m in "nm", False, "video" if m in "nm" else None) for m in "nmqgs"], "merchant string, known boolean, transfer_kind boolean, overlap_group string")
    accounts = spark.createDataFrame([("a",)], "account string")
    categories = spark.createDataFrame([("bank", "fee", None), ("video", "spend", "video"), ("food", "spend", None), ("snack", "saving", None)], "category string, kind string, overlap_group string")
    imports = spark.createDataFrame([("a", DAY(2025, 1, 1), DAY(2026, 2, 28), "committed"), ("a", DAY(2026, 3, 1), DAY(2026, 9, 30), "staged")], "account string, start date, end date, status string")
    return merchants, accounts, categories, imports


def found(df):
    return sorted((r.rule, r.subject, r.impact, round(r.confidence, 9), r.kind) for r in df.collect())


def test_a_run_is_the_single_rules(spark):
    rows = ledger(spark)
    merchants, accounts, categories, imports = tables(spark)
    s = run.snapshot(rows.withColumn("raw", F.lit("more columns")), merchants, accounts, categories, imports)
    assert (s.rows, s.warning) == (rows.count(), "ok")
    by_rule = run.findings_by_rule(s)
    assert list(by_rule) == run.RULES
    ends = coverage.coverage_end(imports)
    own = series.series(rows, merchants, ends)
    pick = lambda df, rule, subject, impact, kind, sure=F.col("confidence"): df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), impact.cast("long").alias("impact"), sure.cast("double").alias("confidence"), kind.alias("kind"))
    see, save = F.lit("visibility"), F.lit("savings")
    creep = series.price_creep(own)
    fee = fees.fees(rows, categories)
    left = fees.findings(fee, fees.reversals(fee, rows))
    single = {
        "recurrence.v1": pick(series.portfolio(own), "recurrence.v1", "subject", F.col("annual"), see),
        "price_creep.v1": pick(creep, "price_creep.v1", "series", F.col("impact"), save),
        "duplicate.v1": pick(series.overlaps(own, merchants, rows, categories), "duplicate.v1", "overlap_group", F.col("annual"), see),
        "trial.v1": pick(series.trials(own, rows, creep.where("first_material")), "trial.v1", "series", F.col("impact"), see),
        "lapsed.v1": pick(series.lapsed(own, ends), "lapsed.v1", "series", F.lit(0), see),
        "fees.v1": pick(left, "fees.v1", "account", F.col("impact"), F.col("kind")),
        "outlier.v1": pick(rules.outliers(rows, "merchant", 5), "outlier.v1", "id", F.col("impact"), see).unionByName(
            pick(rules.windows(rows, trends.charges(own)), "outlier.v1", "year", F.col("impact"), see, F.lit(0.9))
        ),
        "micro.v1": pick(rules.micro(rows), "micro.v1", "grp", F.col("annual"), see, F.lit(0.9)),
    }
    for rule, df in single.items():
        want = found(df)
        assert want and found(by_rule[rule]) == want, rule
    assert ("outlier.v1", "2025", 90000, 0.9, "visibility") in found(by_rule["outlier.v1"])  # the year's largest row is in no series
    covered = coverage.fully_covered(imports, accounts)
    moved = trends.trends(rows, covered, categories, trends.charges(own))
    assert len(found(by_rule["trend.v1"])) == moved.count() and {r.category for r in moved.collect()} == {"food"}  # snacks are no spend, video is one series' own
    assert {r.subject for r in by_rule["trend.v1"].collect()} >= {"food:spike:2025-07"}
    assert [r.impact for r in by_rule["fees.v1"].collect()] == [3600 * 12 // 4]  # the three maintenance fees, over four months
    every = run.union(by_rule)
    assert every.columns == run.FINDING and every.count() == sum(f.count() for f in by_rule.values())
    got, _ = run.analyze(s)
    want, _ = findings.emitted(every)
    assert found(got) == found(want) and found(got)
    assert any(r[0] == "lapsed.v1" and r[2] == 0 for r in found(got))  # exempt from the least impact


def test_the_row_guard(spark):
    rows, rest = ledger(spark), tables(spark)
    assert run.snapshot(rows, *rest, warn=10).warning == "warn"
    with pytest.raises(ValueError):
        run.snapshot(rows, *rest, refuse=100)
    empty = run.snapshot(rows.limit(0), *rest)
    assert empty.rows == 0 and run.union(run.findings_by_rule(empty)).count() == 0
