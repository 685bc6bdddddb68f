"""Greedy walks in each of their forms against a plain walk."""

import datetime
import random

import pytest

from tallyframe.operators import matching, walks

PAIRS = "debit long, credit long, far long, cents long"


def plain(rows):
    want, used_a, used_b = set(), set(), set()
    for far, a, b in sorted((r[2], r[0], r[1]) for r in rows):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    return want


def taken(df):
    rows = [(x.debit, x.credit) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_pairs(seed, keys=3):
    r = random.Random(seed)
    pairs = {(r.randrange(25) + 1000 * k, r.randrange(25) + 1000 * k): k for k in range(keys) for _ in range(120)}  # a debit and a credit may share a number
    return [(a, b, r.randrange(4), k) for (a, b), k in pairs.items()]


@pytest.mark.parametrize("within, most", [(["cents"], 10**6), (None, 10**6), (["cents"], 100), (["cents"], 1), (None, 5)])
def test_assignment_equals_the_greedy_walk(spark, within, most):
    """By key, by component, and in rounds."""
    rows = random_pairs(4)
    df = spark.createDataFrame(rows, PAIRS)
    got = walks.assign(df, "far", within=within, most=most)
    assert got.columns == df.columns or set(got.columns) == set(df.columns)
    assert taken(got) == plain(rows)
    assert walks.assign(df.limit(0), "far", within=within, most=most).count() == 0


def chain(n):
    """Each fee prefers the credit that the one before it takes."""
    return [(i, j, j, 1) for i in range(n) for j in (i - 1, i) if j >= 0]


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_long_chain_costs_what_a_short_one_does(spark):
    cost = {}
    for n in (10, 1000):
        rows = chain(n)
        df = spark.createDataFrame(rows, PAIRS)
        got, cost[n] = jobs(spark, f"chain{n}", lambda df=df: taken(walks.assign(df, "far", within=["cents"])))
        assert got == plain(rows) and len(got) == n
    assert cost[1000] == cost[10]


def test_components_of_chains_and_stars(spark):
    rows = [(d, c) for d, c, _, _ in chain(300)] + [(5000 + i, 6000) for i in range(40)] + [(7000, 7000)]
    got = {r.debit: r.component for r in walks.components(spark.createDataFrame(rows, "debit long, credit long")).collect()}
    assert len(set(got[i] for i in range(300))) == 1 and len(set(got[5000 + i] for i in range(40))) == 1
    assert len(set(got.values())) == 3 and len(got) == 341


def test_the_queue_equals_the_walk(spark):
    r = random.Random(6)
    day = lambda k: datetime.date(2026, 1, 1) + datetime.timedelta(k)
    asking = [(i, r.choice("ab"), r.choice([100, 200]), r.randint(0, 150)) for i in range(120)]
    offered = [(i, r.choice("abc"), r.choice([100, 200]), r.randint(0, 200)) for i in range(90)]
    want, used = set(), set()
    for d, i, a, x in sorted((d, i, a, x) for i, a, x, d in asking):
        near = [(e, j) for j, b, y, e in offered if (b, y) == (a, x) and j not in used and d <= e <= d + 20]
        if near:
            used.add(min(near)[1])
            want.add((i, min(near)[1]))
    frame = lambda rows: spark.createDataFrame([(i, a, x, day(d)) for i, a, x, d in rows], "id long, account string, x long, day date").repartition(3)
    assert want and taken(walks.queued(frame(asking), frame(offered), 20, ["account", "x"])) == want
    assert walks.queued(frame(asking).limit(0), frame(offered), 20, ["account", "x"]).count() == 0


def test_equal_amounts_of_one_key_need_no_pairs(spark):
    """3,000 fees of one amount and as many credits: nine million pairs."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id"), F.lit("a").alias("account"), F.lit(5).alias("x"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"))
    got = taken(walks.queued(rows, rows.withColumn("day", F.date_add("day", 1)), 60, ["account", "x"]))
    assert len(got) == 3000 and got == {(i, i) for i in range(3000)}


def test_near_duplicates_keep_their_key(spark):
    rows = spark.createDataFrame([(1, "a", "k", datetime.date(2026, 1, 5), -500)], "id long, account string, key string, date date, cents long")
    new = rows.selectExpr("id + 10 as id", "account", "key", "date_add(date, 2) as date", "cents - 10 as cents")
    assert [tuple(r) for r in matching.near_duplicates(rows, new).collect()] == [("a", "k", 11, 1, -10)]


def test_a_key_stays_in_one_task_after_a_join_by_it(spark):
    """Spark may leave out a shuffle by the key of a join, then read the join's input where it lies."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 10).cast("string").alias("owner"), "id")
        both = rows.groupBy("owner").agg(F.max("id").alias("most")).where("most > 5").select("owner")
        got = walks.gathered(rows.join(both, "owner", "left_semi"), ["owner"], [], lambda own: [{"owner": own[0]["owner"], "n": len(own)}], "owner string, n int").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.owner, r.n) for r in got) == [(str(k), 400) for k in range(10)]


def test_cells_are_walked_as_their_rows(spark):
    """Against the plain walk over all rows' pairs: cells of several rows, competing within and across cells."""
    r = random.Random(8)
    cells = [(k, 100 * k + j, j % 2) for k in range(3) for j in range(12)]  # key, cell, side
    rows = [(k, c, 10_000 * side + r.randrange(10**6) * 100_000 + c) for k, c, side in cells for _ in range(r.randint(1, 9))]
    pairs = [(a, b, r.randrange(3), k) for k, a, s in cells for q, b, t in cells if k == q and s == 0 and t == 1 and r.random() < 0.6]
    ids = {}
    for _, c, i in rows:
        ids.setdefault(c, []).append(i)
    want = plain([(d, e, far, 0) for a, b, far, _ in pairs for d in ids[a] for e in ids[b]])
    got = walks.assign_cells(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame([(k, c, i) for k, c, i in rows], "cents long, cell long, id long").repartition(3), "cents", ["far"])
    assert got.columns == ["debit", "credit", "far", "cents"] and len(want) > 20 and taken(got) == want
