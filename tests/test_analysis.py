import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import merchants, money, text
from tallyframe.operators import aliases, coverage, fees, findings, imports, rules, search, series, store, transfers, trends
from tallyframe.sources import profiles, statements

DAY = datetime.date


def months(n, cents, first=1, day=5, year=2025, merchant="m", start=0):
    out = []
    for k in range(n):
        m = first - 1 + k
        out.append((f"{merchant}{start}{cents}{day}-{k}", "a", DAY(year + m // 12, m % 12 + 1, day), -cents, merchant, False, False, False, None))
    return out


LEDGER = "id string, account string, date date, cents long, merchant string, pending boolean, excluded boolean, transfer boolean, refund_pair string"


def found(spark, rows, known=False, kind=False, end=None, **config):
    ledger = spark.createDataFrame(rows, LEDGER)
    m = spark.createDataFrame([("m", known, kind), ("n", known, kind)], "merchant string, known boolean, transfer_kind boolean")
    c = spark.createDataFrame([("a", end)], "account string, coverage_end date")
    return sorted(series.series(ledger, m, c, **config).collect(), key=lambda r: (r.first_cents, r.first_seen))


def test_recurring_series(spark):
    [s] = found(spark, months(12, 1325, day=7))
    assert (s.cadence, s.per_year, s.n, s.current_cents, s.basis) == ("monthly", 12.0, 12, 1325, "fitted") and s.confidence >= 0.8
    [s] = found(spark, months(8, 775) + months(8, 1250, 9))  # a new price is no new series
    assert s.n == 16 and [(x.from_cents, x.to_cents, x.delta_cents, x.confirmed) for x in s.steps] == [(775, 1250, 475, True)] and s.concurrent == []
    [s] = found(spark, months(8, 775) + months(1, 1250, 9))
    assert (s.steps[-1].held, s.steps[-1].confirmed) == (1, False)
    a, b = found(spark, months(10, 875) + months(10, 2150, day=21))  # two plans at once
    assert a.concurrent == [b.series] and b.concurrent == [a.series] and a.component == b.component
    three = found(spark, months(9, 600) + months(9, 1400, day=15) + months(9, 3000, day=25))
    assert len({s.component for s in three}) == 1 and len(three) == 3
    assert found(spark, months(6, 1000) + months(6, 1400, 7), step_cents=100_000)[0].steps == []
    assert found(spark, []) == []


def test_confidence_of_series(spark):
    day = lambda m, d, c: (f"x{m}", "a", DAY(2025, m, d), -c, "m", False, False, False, None)
    [s] = found(spark, [day(1, 6, 2000), day(2, 5, 2070), day(3, 11, 1930)])
    assert 0.35 <= s.confidence < 0.55
    assert found(spark, months(3, 1325))[0].confidence <= 0.70
    year = [("a1", "a", DAY(2025, 3, 4), -8800, "m", False, False, False, None), ("a2", "a", DAY(2026, 3, 1), -8800, "m", False, False, False, None)]
    [s] = found(spark, year)
    assert (s.cadence, s.basis) == ("annual", "annual_pair") and 0.55 <= s.confidence < 0.80
    [s] = found(spark, year[:1], known=True)
    assert s.basis == "single_charge" and 0.35 <= s.confidence < 0.55
    assert found(spark, year[:1]) == []


def test_status_and_inputs_of_series(spark):
    assert [found(spark, months(6, 900), end=e)[0].status for e in (DAY(2025, 6, 30), DAY(2025, 7, 25), None)] == ["active", "lapsed", "active"]
    odd = [("p", True, False, False, None), ("e", False, True, False, None), ("t", False, False, True, None), ("r", False, False, False, "pair")]
    rows = months(6, 900) + [(i, "a", DAY(2025, 7 + k, 5), -900, "m", *flags) for k, (i, *flags) in enumerate(odd)] + [("c", "a", DAY(2025, 11, 5), 900, "m", False, False, False, None), ("z", "a", DAY(2025, 12, 5), -900, None, False, False, False, None)]
    assert found(spark, rows)[0].n == 6
    assert found(spark, months(12, 50000), kind=True) == []


def test_rules_on_series(spark):
    ledger = spark.createDataFrame(months(8, 899) + months(8, 1549, 9) + months(12, 700, merchant="n"), LEDGER).withColumns({"raw": F.lit("SHOP"), "category": F.lit("c")})
    m = spark.createDataFrame([("m", True, False, "video"), ("n", True, False, None)], "merchant string, known boolean, transfer_kind boolean, overlap_group string")
    c = spark.createDataFrame([("a", DAY(2026, 4, 30))], "account string, coverage_end date")
    s = series.series(ledger, m, c).persist()
    assert [(r.impact, r.steps, r.first_material) for r in series.price_creep(s).collect()] == [(650 * 12, 1, True)]
    assert [(r.active, r.lapsed, r.annual, r.monthly) for r in series.portfolio(s).collect()] == [(1, 1, 1549 * 12, 1549)]
    assert [r.days for r in series.lapsed(s, c).collect()] == [146]
    assert series.duplicates(s).count() == 0
    # A merchant without a group has the one most of its charges have.
    kinds = spark.createDataFrame([("c", "video")], "category string, overlap_group string")
    live = s.withColumn("status", F.lit("active"))
    assert [(r.overlap_group, r.n, r.annual) for r in series.overlaps(live, m, ledger, kinds).collect()] == [("video", 2, (1549 + 700) * 12)]
    marked = ledger.withColumn("normalized", F.when(F.col("merchant") == "n", "N FREE TRIAL OVER").otherwise("TRIALS")).withColumn("raw", F.lit("FREE TRIAL"))
    none = s.select("series").limit(0)
    got = series.trials(s, marked, none).collect()
    assert [(r.points, r.early) for r in got] == [(2, True)]  # a step alone is one point; the marker is a whole word


def test_fees(spark):
    rows = [(1, "LATE FEE 22", 2500, DAY(2026, 1, 3)), (2, "ATM FEE", 300, DAY(2026, 1, 9)), (3, "MONTHLY MAINTENANCE", 1200, DAY(2026, 1, 31)), (4, "MONTHLY MAINTENANCE", 1200, DAY(2026, 3, 1)), (5, "LATE FEES", 99, DAY(2026, 1, 1)), (6, "ATM FEE REFUND", 300, DAY(2026, 1, 1)), (7, "INTEREST CHECKING", 5, DAY(2026, 1, 1)), (8, "CHATM FEE THEN ATM FEE", 7, DAY(2026, 1, 1)), (9, "BANK", 450, DAY(2026, 2, 2))]
    back = [(20, "CREDIT", -2500, DAY(2026, 2, 1)), (21, "CREDIT", -2500, DAY(2026, 2, 2)), (22, "CREDIT", -300, DAY(2026, 4, 1))]
    ledger = spark.createDataFrame([(i, "a", d, -c, t, False, False, "f" if t == "BANK" else "x") for i, t, c, d in rows + back], "id long, account string, date date, cents long, normalized string, pending boolean, excluded boolean, category string")
    kinds = spark.createDataFrame([("f", "fee")], "category string, kind string")
    f = fees.fees(ledger, kinds)
    assert {(r.id, r.keyword) for r in f.collect()} == {(1, "LATE FEE"), (2, "ATM FEE"), (3, "MONTHLY MAINTENANCE"), (4, "MONTHLY MAINTENANCE"), (9, None)}
    netted = fees.reversals(f, ledger)
    assert [(r.debit, r.credit) for r in netted.collect()] == [(1, 20)]
    [r] = fees.findings(f, netted).collect()
    assert (r.n, r.total, r.months, r.annual, r.avoidable, r.impact, r.kind, r.confidence) == (4, 3150, 3, 12600, 2400, 9600, "savings", 0.95)
    assert {k: tuple(v) for k, v in r.breakdown.items()} == {"ATM FEE": (1, 300), "MONTHLY MAINTENANCE": (2, 2400), "fee category": (1, 450)}


def test_avoidable_fees_are_counted_by_keyword(spark):
    """One maintenance and one balance fee save nothing; of two and one, the two do."""
    def finding(words):
        rows = [(i, "a", DAY(2026, 1, 1 + i), -x, t, False, False, "x") for i, (t, x) in enumerate(words)]
        f = fees.fees(spark.createDataFrame(rows, "id long, account string, date date, cents long, normalized string, pending boolean, excluded boolean, category string"))
        [r] = fees.findings(f, f.select(F.col("id").alias("debit")).limit(0)).collect()
        return r.kind, r.avoidable, r.impact

    one, low = ("MONTHLY MAINTENANCE", 1200), ("MINIMUM BALANCE", 1500)
    assert finding([one, low]) == ("visibility", 0, 2700 * 12)
    assert finding([one, low, one]) == ("savings", 2400, 2400 * 12)


def test_refunds_go_by_the_order_of_new_rows(spark):
    def pairs(rows, new=None):
        ledger = spark.createDataFrame([(i, "a", DAY(2026, 1, 1) + datetime.timedelta(d), x, m, False, None) for i, d, x, m in rows], "id long, account string, date date, cents long, merchant string, pending boolean, refund_pair string")
        inserted = None if new is None else spark.createDataFrame([(i, k) for k, i in enumerate(new)], "id long, row long")
        return sorted((r.debit, r.credit, r.gap) for r in imports.refunds(ledger, inserted).collect())

    rows = [(1, 0, -500, "m"), (2, 4, -500, "m"), (3, 5, 500, "m")]
    assert pairs(rows) == [(1, 3, 5)] and pairs(rows, [3]) == [(2, 3, 1)] and pairs(rows, [2]) == [(2, 3, 1)]
    assert pairs(rows, []) == []  # stored rows start no pair
    assert pairs([(1, 0, -500, "m"), (2, 91, 500, "m"), (3, 90, 500, "n"), (4, 0, -500, None), (5, 1, 500, None)]) == []
    r = random.Random(8)
    many = [(i, r.randint(0, 200), r.choice([-1, 1]) * r.choice([300, 500]), r.choice("mn")) for i in range(150)]
    new = r.sample(range(150), 90)
    free, want = {i: (d, x, m) for i, d, x, m in many}, []
    for i in new:
        if i in free:
            d, x, m = free[i]
            near = [(abs(e - d), j) for j, (e, y, n) in free.items() if y == -x and n == m and 0 <= (e - d if x < 0 else d - e) <= 90]
            if near:
                gap, j = min(near)
                want.append((i, j, gap) if x < 0 else (j, i, gap))
                del free[i], free[j]
    assert pairs(many, new) == sorted(want)


TRANSFERS = "id long, account string, date date, cents long, normalized string, raw string, merchant string, pending boolean, excluded boolean, refund_pair string"


def test_transfer_scores(spark):
    day = DAY(2026, 1, 25)
    rows = [(1, "chk", day, -50000, "ONLINE PMT CARDINAL CARD", "Online Pmt Cardinal Card XXXX9012", None, False, False, None), (2, "card", day, 50000, "PAYMENT THANK YOU", "payment thank you", None, False, False, None), (3, "chk", day, -700, "SHOP", "SHOP", "m", False, False, None), (4, "card", DAY(2026, 2, 1), 700, "BACK", "BACK", None, False, False, None), (5, "card", day, 50000, "X", "X", None, True, False, None)]
    ledger = spark.createDataFrame(rows, TRANSFERS)
    accounts = spark.createDataFrame([("chk", "checking", None, "4821"), ("card", "credit_card", "Cardinal Bank", "9012")], "account string, account_type string, institution string, last4 string")
    pairs = transfers.candidates(ledger)
    got = {(r.debit, r.credit): (r.score, [x.signal for x in r.reasons]) for r in transfers.scored(pairs, ledger, accounts).collect()}
    assert got == {(1, 2): (8, ["keyword_both_sides", "counterparty_last4", "credit_card_institution", "close_date_gap"]), (3, 4): (0, [])}
    rule = spark.createDataFrame([("r2", "SHO", "chk", "card"), ("r1", "SHOP", "chk", "card")], "rule string, pattern string, debit_account string, credit_account string")
    spend = spark.createDataFrame([(3,)], "id long")
    s = transfers.scored(pairs, ledger, accounts, rule, spend, spark.createDataFrame([("m", "chk")], "merchant string, account string"))
    assert {(r.debit): (r.score, r.rule) for r in s.collect()} == {1: (8, None), 3: (-1, "r1")}
    assert [(r.debit, r.state) for r in transfers.matched(transfers.scored(pairs, ledger, accounts), ledger).collect()] == [(1, "auto")]
    assert [r.id for r in transfers.unmatched(ledger, pairs.limit(0)).collect()] == [1]
    assert transfers.candidates(ledger, spark.createDataFrame([(1, 2)], "debit long, credit long")).count() == 1
    links = spark.createDataFrame([(1, 2, "proposed", 3), (9, 2, "proposed", 2)], "debit long, credit long, state string, score int")
    assert {r.state for r in transfers.decide(links, 2, "proposed", "confirmed").collect()} == {"confirmed"}


def plain_partial(rows, used, text_score):
    """rows: (id, account, date, cents, text); one owner's walk, credit by credit."""
    used, out = set(used), {}
    for c in sorted((r for r in rows if r[3] > 0 and r[0] not in used), key=lambda r: (-r[3], r[0])):
        gap = lambda d: abs((c[2] - d[2]).days)
        pool = [d for d in rows if d[3] < 0 and d[0] not in used and d[1] != c[1] and -d[3] < c[3] and -1 <= (c[2] - d[2]).days <= 7]
        pool = sorted(pool, key=lambda d: (gap(d), d[0]))[: transfers.POOL]
        hit = next((s for n in (2, 3) for s in itertools.combinations(pool, n) if -sum(d[3] for d in s) == c[3]), None)
        if hit is None or len({d[1] for d in hit}) > 1:
            continue
        score = text_score(hit, c) + (1 if max(map(gap, hit)) <= 3 else 0)
        if score >= 2:
            out[c[0]] = (sorted(d[0] for d in hit), score)
            used |= {d[0] for d in hit}
    return out


def test_partial_payments_equal_the_walk(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), DAY(2026, 1, r.randint(1, 28)), -r.randint(1, 9) * 100, r.choice(["AUTOPAY 9012", "XFER", "SHOP", "CARDINAL ONLINE PMT"])) for i in range(90)]
    rows += [(100 + i, "c", DAY(2026, 1, r.randint(5, 28)), r.randint(5, 18) * 100, r.choice(["PAYMENT THANK YOU", "SHOP", "XFER 4821"])) for i in range(40)]

    def text_score(hit, c):
        key = lambda x: any(k in x[4] for k in transfers.KEYWORDS)
        last4 = any("9012" in d[4] for d in hit) or hit[0][1] == "a" and "4821" in c[4]
        return 3 * (all(map(key, hit)) and key(c)) + 2 * last4 + 2 * any("CARDINAL" in d[4] for d in hit) - 2 * any(x[0] % 10 == 0 for x in (*hit, c))

    want = plain_partial(rows, {0, 100}, text_score)
    frame = lambda rows: spark.createDataFrame([(i, a, day, x, t, t.lower(), None, False, False, None, o) for i, a, day, x, t, o in rows], TRANSFERS + ", who int")
    ledger = frame([(*x, 1) for x in rows] + [(x[0] + 1000, *x[1:], 2) for x in rows])
    accounts = spark.createDataFrame([("a", "checking", None, "4821"), ("b", "checking", "", ""), ("c", "credit_card", "Cardinal Bank", "9012")], "account string, account_type string, institution string, last4 string")
    used = spark.createDataFrame([(0,), (100,), (1000,), (1100,)], "id long")
    spending = spark.createDataFrame([(i,) for i in range(0, 2000, 10)], "id long")
    got = transfers.partial_payments(ledger, used, accounts, None, spending, owner="who").collect()
    assert len(want) > 4 and {x.credit: (sorted(x.debits), x.score) for x in got if x.owner == "1"} == want
    assert {x.credit - 1000: (sorted(i - 1000 for i in x.debits), x.score) for x in got if x.owner == "2"} == want
    rule = spark.createDataFrame([("r", "SHOP", "a", "c")], "rule string, pattern string, debit_account string, credit_account string")
    few = frame([(1, "a", DAY(2026, 1, 1), -300, "SHOP 1", 1), (2, "a", DAY(2026, 1, 9), -400, "SHOP 2", 1), (3, "c", DAY(2026, 1, 8), 700, "x", 1)])
    assert transfers.partial_payments(few, used, accounts, rule).select("credit", "score", "gap").collect() == [(3, 3, 7)]
    assert transfers.partial_payments(few, used, accounts).count() == 0  # no signal, no proposal
    assert transfers.partial_payments(few.limit(0), used, accounts).count() == 0

def many_equal_rows(spark, n=1200):
    """A ledger in which few amounts, days, accounts and texts make many rows alike."""
    r = random.Random(9)
    text = lambda: r.choice(["AUTOPAY 9012", "XFER 4821", "SHOP", "CARDINAL ONLINE PMT"])
    rows = [(i, r.choice("ab"), DAY(2026, 1, r.randint(1, 9)), -r.choice([500, 700]), text(), "m", r.choice([None, "chk"]), i % 31 == 0, False, None) for i in range(n)]
    rows += [(n + i, r.choice("cb"), DAY(2026, 1, r.randint(1, 9)), r.choice([500, 700]), text(), "m", None, False, False, None) for i in range(n)]
    rows = [(i, a, day, x, t, t.lower(), m, p, e, f) for i, a, day, x, t, m, _, p, e, f in rows]
    r.shuffle(rows)
    accounts = spark.createDataFrame([("a", "checking", None, "4821"), ("b", "checking", "", ""), ("c", "credit_card", "Cardinal Bank", "9012")], "account string, account_type string, institution string, last4 string")
    rules = spark.createDataFrame([("r2", "SHOP", "a", "c"), ("r1", "SH", "a", "c"), ("r3", "XFER", "b", "c")], "rule string, pattern string, debit_account string, credit_account string")
    spending = spark.createDataFrame([(i,) for i in range(0, 2 * n, 10)], "id long")
    series = spark.createDataFrame([("m", "b")], "merchant string, account string")
    return spark.createDataFrame(rows, TRANSFERS), (accounts, rules, spending, series)


def test_equal_rows_are_matched_without_their_pairs(spark, monkeypatch):
    ledger, known = many_equal_rows(spark, 300)
    pairs = transfers.candidates(ledger)
    all_pairs = transfers.scored(pairs, ledger, *known)
    seen, real = [], transfers.assign_cells
    monkeypatch.setattr(transfers, "assign_cells", lambda p, *a: seen.append(p.count()) or real(p, *a))
    got = transfers.matched_candidates(ledger, *known)
    want = transfers.matched(all_pairs, ledger)
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())
    assert plain(got) == plain(want) and len(plain(got)) > 100
    assert seen[0] * 2 < all_pairs.count()
    assert plain(transfers.scored_candidates(ledger, *known)) == plain(all_pairs)


def test_scores_of_candidates_shuffle_no_pairs(spark):
    """The pairs leave the join that makes them; before, they were joined with their debits, then their credits."""
    ledger, known = many_equal_rows(spark, 30)
    plan = transfers.scored_candidates(ledger, *known)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Inner")]
    assert "Join" not in top and "Aggregate" not in top and "gap" not in plan[plan.index("Join Inner") + 1 :].split("explode")[-1]


def test_large_amounts_add_up(spark):
    assert transfers._subset([2**62, 2**61, 2**62 - 1], 2**62 + 2**61 - 1, ["a"] * 3) == [1, 2]
    assert transfers._subset([3, 3, 3, 6], 6, ["a", "b", "a", "a"]) is None and transfers._subset([4, 1, 2, 3], 7, ["a"] * 4) == [0, 3]
    assert transfers._subset([], 5, []) is None and transfers._subset([1, 1, 3], 5, ["a"] * 3) == [0, 1, 2]


def test_an_empty_institution_names_nothing(spark):
    t = spark.createDataFrame([("", "PAY X"), (None, "PAY X"), ("The Bank", "THE BANK"), ("Cardinal Bank", "PAY CARDINAL-CARD"), ("Cardinal Bank", "CARDINALS"), ("Of And", "PAY")], "institution string, text string")
    got = [r[0] for r in t.select(transfers.names_institution(F.col("text"), F.col("institution"))).collect()]
    assert got == [False, False, True, True, False, False]
    assert got == [transfers._institution(r.text, r.institution) for r in t.collect()]


BAG = "id long, account string, key string, date date, cents long, pending boolean, row long, occurrence long, merchant string, refund_pair string"


def test_imports_converge(spark):
    row = lambda i, key, n, occurrence=None, cents=-500, day=5, pending=False: (i, "a", key, DAY(2026, 1, day), cents, pending, n, occurrence, "m", None)
    old = spark.createDataFrame([row(1, "k", 0, 1), row(2, "q", 1, 0, -1000, 5, True)], BAG)
    new = spark.createDataFrame([row(10, "k", 0), row(11, "k", 1), row(12, "k", 2), row(13, "q", 3, None, -1010, 7)], BAG)
    plan = {r.id: (r.action, r.existing, r.occurrence) for r in imports.merge_plan(old, new).collect()}
    assert plan == {10: ("merge", 1, None), 11: ("insert", None, 2), 12: ("insert", None, 3), 13: ("merge", 2, None)}
    other = spark.createDataFrame([row(20, "q", 0, None, -1010, 7), row(21, "q", 1, None, -1020, 8), row(22, "q", 2, None, -1030, 6)], BAG)
    stored = spark.createDataFrame([row(2, "q", 1, 0, -1000, 5, True)], BAG)
    claimed = imports.claims(stored, other)
    assert [(r.incoming, r.existing, r.resolution) for r in claimed.collect()] == [(20, 2, "replace")]
    asked = spark.createDataFrame([(20, 9, "skip")], "incoming long, existing long, resolution string")
    assert imports.resolved(claimed, asked).first().resolution == "replace"  # it names another row
    asked = spark.createDataFrame([(20, 2, "skip")], "incoming long, existing long, resolution string")
    assert imports.resolved(claimed, asked).first().resolution == "skip"
    assert {r.id: r.disposition for r in imports.review(old, new).collect()} == {10: "duplicate", 11: "insert", 12: "insert", 13: "duplicate"}
    sources = spark.createDataFrame([(1, "x", 0), (2, "x", 1)], "transaction long, import string, row long")
    none = spark.createDataFrame([], "incoming long, existing long, resolution string")
    ledger, after, gone = imports.commit(old, new, none, sources, "y")
    assert sorted(r.id for r in ledger.collect()) == [1, 2, 11, 12] and gone.count() == 0
    again, _, _ = imports.commit(ledger.checkpoint(), new, none, after, "y")
    assert sorted(r.id for r in again.collect()) == [1, 2, 11, 12]  # a second import of the same file changes nothing
    left, stands, dead = imports.without_import(ledger, after, "y")
    assert sorted(r.id for r in left.collect()) == [1, 2] and sorted(r.entity_id for r in dead.collect()) == ["11", "12"] and stands.count() == 2


def test_staging_and_refusals(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    told, staged = imports.stage(files, spark.createDataFrame([], "path string, sha string, size int"))
    assert {r.path: r.created for r in told.collect()} == {"a": True, "b": False, "c": True} and staged.count() == 2
    assert not any(r.created for r in imports.stage(files, staged)[0].collect())
    rows = spark.createDataFrame([("a", 0, "r"), ("b", 0, "r")], "path string, row_index int, raw string")
    state = spark.createDataFrame([("a", "staged"), ("b", "committed")], "path string, status string")
    new = spark.createDataFrame([("a", 0, "n"), ("a", 1, "n")], rows.schema)
    after, dead = imports.restage(rows, state, "a", new)
    assert sorted((r.path, r.raw) for r in after.collect()) == [("a", "n"), ("a", "n"), ("b", "r")] and dead.count() == 1
    after, dead = imports.restage(rows, state, "b", spark.createDataFrame([("b", 0, "n")], rows.schema))
    assert sorted((r.path, r.raw) for r in after.collect()) == [("a", "r"), ("b", "r")] and dead.count() == 0
    plan = spark.createDataFrame([(0, False, False, 1), (0, True, False, 1), (5, False, False, 2)], "cents long, pending boolean, zero_allowed boolean, key_version int")
    assert {(r.reason, r.n) for r in imports.refusals(plan).collect()} == {("zero_amount", 1), ("mixed_key_versions", 2)}
    accounts = spark.createDataFrame([("a1", "Harbor Savings", "0042", "savings"), ("a2", "Northgate", "1111", "checking"), ("a3", "Other", "2222", "checking")], "account string, display_name string, last4 string, account_type string")
    files = spark.createDataFrame([("x/export-0042-northgate.csv", None), ("x/NORTHGATE jan.csv", None), ("x/y.csv", "savings"), ("x/z.csv", "checking")], "path string, hint string")
    assert {r.path[2:]: r.account for r in imports.suggested_account(files, accounts).collect()} == {"export-0042-northgate.csv": "a1", "NORTHGATE jan.csv": "a2", "y.csv": "a1", "z.csv": None}


def test_aliases(spark):
    known = spark.createDataFrame([("NETFLIX", "seeded", "prefix", 1.0, "seed"), ("NETFLIX COM", "ruled", "exact", 1.0, "rule"), ("BLUE BOTTLE COFFEE", "blue", "fuzzy", 0.9, "user")], aliases.ALIASES)
    rows = spark.createDataFrame([("netflix com",), ("BLUE BOTTLE COFFE",), ("CORNER SHOP #12",), ("",), ("Zelle to Ann",)], "raw string")
    got = {r.raw: (r.key, r.merchant, r.provisional, r.person) for r in aliases.normalized(rows, known).collect()}
    assert got["netflix com"][1] == "seeded"  # the source counts before the kind of match
    assert got["BLUE BOTTLE COFFE"][1] == "blue" and got[""] == ("", None, None, False)
    assert got["CORNER SHOP #12"][1:] == (None, "CORNER SHOP", False) and got["Zelle to Ann"][3]
    shops, after = aliases.provisional(aliases.normalized(rows, known), spark.createDataFrame([("m", "ZELLE TO ANN")], "merchant string, name string"), known)
    assert sorted(r.name for r in shops.collect()) == ["CORNER SHOP", "ZELLE TO ANN"] and after.where("source = 'rule'").count() == 2
    assert aliases.seeds(spark).count() == 24 and aliases.seed_merchants(spark).count() == 16
    person = lambda raw, known=(): spark.range(1).select(merchants.to_person(F.lit(raw), list(known))).first()[0]
    assert [person("PAYPAL *"), person("PAYPAL *CORNER SHOP", ["CORNER SHOP"]), person("pp*someone", ["CORNER SHOP"]), person("VENMO x"), person("SHOP")] == [True, False, True, True, False]


def test_findings(spark):
    rows = [("r", i, 3000 + i, 0.9, "savings", False, False) for i in range(30)] + [("r", 90, 99999, 0.95, "savings", True, False), ("q", 91, 100, 0.6, "visibility", False, True), ("q", 92, 99999, 0.3, "savings", False, False), ("q", 93, 100, 0.6, "savings", False, False)]
    f = spark.createDataFrame(rows, "rule string, subject long, impact long, confidence double, kind string, llm boolean, exempt boolean")
    kept, more = findings.emitted(f)
    assert kept.count() == 26 and kept.where("subject = 90").first().band == "medium" and kept.where("rule = 'q'").first().subject == 91
    assert [tuple(r) for r in more.collect()] == [("r", 6, 3006)]
    assert findings.headline(kept).first()[0] == 99999 + sum(3000 + i for i in range(6, 30))
    state = spark.createDataFrame([(1, "dismissed", None, "h", None), (2, "snoozed", None, None, None)], "id long, state string, until date, dismissed_hash string, dismissed_config string")
    after = findings.with_state(state.limit(0), state, F.lit("2026-01-01").cast("date"))
    assert after.where("id = 2").first().until == DAY(2026, 4, 1)
    assert len(spark.range(1).select(findings.evidence_hash(F.lit("r"), F.lit("s"), F.lit(1250), F.lit(None), F.lit("active"))).first()[0]) == 32
    pairs = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "finding long, transaction long")
    assert [tuple(r) for r in findings.evidence_of(pairs, spark.createDataFrame([(5,)], "id long")).collect()] == [(1, 5)]
    a, b = findings.changed_since(F.lit("new"))
    joined = state.withColumn("evidence_hash", F.lit("other"))
    assert [tuple(r) for r in joined.select(a, b).collect()] == [(True, False), (False, False)]


def test_search_text_is_literal_and_an_empty_patch_writes_nothing(spark):
    row = lambda i, raw, transfer=False: (i, "a", DAY(2026, 1, 1), -100, "m", "c", raw, raw.upper(), False, False, transfer)
    ledger = spark.createDataFrame([row(1, "50% off"), row(2, "50 off"), row(3, "a_b"), row(4, "50% moved", True)], "id long, account string, date date, cents long, merchant string, category string, raw string, normalized string, pending boolean, excluded boolean, transfer boolean")
    assert [r.id for r in search.page(ledger, search.Query(text="50%"))[0].collect()] == [1]
    assert search.page(ledger, search.Query(text="OFF", start="2026-01-02"))[1].first()[0] == 2  # a range counts with both ends only
    assert search.patched(ledger, search.Query(), {}) is ledger
    assert {r.id: r.category for r in search.patched(ledger, search.Query(text="a_"), {"category": "new"}).collect()} == {1: "c", 2: "c", 3: "new", 4: "c"}


def test_coverage_and_configuration(spark):
    i = spark.createDataFrame([("a", DAY(2026, 1, 1), DAY(2026, 2, 28), "committed"), ("a", DAY(2026, 3, 1), DAY(2026, 3, 15), "committed"), ("a", DAY(2026, 3, 16), DAY(2026, 3, 31), "committed"), ("b", DAY(2026, 2, 1), DAY(2026, 2, 28), "staged")], "account string, start date, end date, status string")
    assert sorted(r.month.month for r in coverage.covered_months(i).collect()) == [1, 2]  # one import must span the month
    assert coverage.fully_covered(i, i.select("account").distinct()).count() == 0  # an account without coverage leaves none
    assert coverage.coverage_end(i).first().coverage_end == DAY(2026, 3, 31)
    late = spark.createDataFrame([("a", DAY(2026, 5, 3))], "account string, date date")
    assert [r.state for r in coverage.bar(i, late).orderBy("month").collect()] == ["covered", "covered", "partial", "missing", "partial"]
    base = {"x": {"a": 1, "b": 12.0}, "y": {"c": [1, 2]}}
    assert coverage.resolved(base, {"x": {"a": 2}}) == {"x": {"a": 2, "b": 12.0}, "y": {"c": [1, 2]}}
    assert coverage.config_hash(base) == coverage.config_hash(json.loads('{"y": {"c": [1, 2]}, "x": {"b": 12, "a": 1}}')) and len(coverage.config_hash(base)) == 16
    assert [coverage.guard(10), coverage.guard(300_000), coverage.guard(2_000_000, refuse=None)] == ["ok", "warn", "warn"]
    with pytest.raises(ValueError):
        coverage.guard(1_000_001)


def test_store_swaps_whole_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        s.tables("t")
    s.swap({"t": spark.range(3)})
    s.swap({"t": s.tables("t")["t"].where("id > 0")})
    assert sorted(r.id for r in s.tables("t")["t"].collect()) == [1, 2]
    s.backup(str(tmp_path / "b"), "t")
    assert store.Store(spark, str(tmp_path / "b")).tables("t")["t"].count() == 2
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], store.SETTINGS)
    assert sorted(map(tuple, store.settings_after(kv, spark.createDataFrame([("b", "3")], store.SETTINGS)).collect())) == [("a", "1"), ("b", "3")]


def test_header_is_not_outvoted_by_prose(spark):
    body = "Northgate Bank\n1 Main St\nTown\nState\nCountry\nDate,Description,Amount\n01/02/2026,a,-1.00\n01/03/2026,b,-2.00\n"
    files = spark.createDataFrame([("f", bytearray(body.encode())), ("n", bytearray(b"1,2\n3,4\n"))], "path string, content binary")
    assert [(r.path, r.record) for r in statements.header(statements.records(files, ",")).collect()] == [("f", 5)]
    body = "Northgate Bank\n" + body[body.index("Date") :]
    files = spark.createDataFrame([("f", bytearray(body.encode())), ("n", bytearray(b"1,2\n3,4\n"))], "path string, content binary")
    p = spark.createDataFrame([("own", "x", ["date", "description", "amount", "balance"])], "profile string, signature string, tokens array<string>")
    got = {r.path: (r.state, r.profile, r.similarity) for r in statements.detected(files, p).collect()}
    assert got == {"f": ("needs_mapping", "own", 0.75), "n": ("undetectable", None, None)}
    same = p.withColumn("signature", statements.signature(F.array(F.lit(" DATE"), F.lit("Description"), F.lit("Amount"))))
    assert [(r.state, r.profile) for r in statements.detected(files, same).where("path = 'f'").collect()] == [("matched", "own")]


def test_profiles_skip_lines_and_missing_columns(spark, tmp_path):
    rows = statements.records(spark.createDataFrame([("f", bytearray(b"x,y,z\n\n01/02/2026,a,-1.00\n01/03/2026,b,-2.00\n"))], "path string, content binary"), ",")
    bare = {"date_format": "MM/DD/YYYY", "columns": {"transaction_date": 0, "description": 1, "amount": 2}, "skip_lines": 1, "has_header": False}
    assert [(r.row_index, r.cents, r.error) for r in statements.ledger_rows(rows, bare).orderBy("row_index").collect()] == [(0, -100, None), (1, -200, None)]
    named = {**bare, "columns": {"transaction_date": "Date", "description": "y", "amount": "z"}, "skip_lines": 0, "has_header": True}
    assert {r.error for r in statements.ledger_rows(rows, named).collect()} == {"column"}
    two = {"date_format": "MM/DD/YYYY", "columns": {"transaction_date": 0, "description": 1, "debit": 2, "credit": 3}, "has_header": False, "invert": True}
    split = statements.records(spark.createDataFrame([("f", bytearray(b"01/02/2026,a,5.00,\n01/03/2026,b,,7.25\n01/03/2026,c,,\n"))], "path string, content binary"), ",")
    assert [r.cents for r in statements.ledger_rows(split, two).orderBy("row_index").collect()] == [500, -725, None]
    assert profiles.checked(bare)[0] == [] and profiles.checked({**bare, "columns": {"description": 1, "amount": 2, "debit": 3}, "date_format": "nope", "delimiter": "ab", "currency": "EUR"})[0][0] == "a date is needed"
    (tmp_path / "a.json").write_text(json.dumps({"name": "own", "header": ["Date", "Text"], **bare}))
    (tmp_path / "b.json").write_text("{")
    got = profiles.loaded(spark, str(tmp_path))
    assert got.count() == 2 and got.where("problem is not null").count() == 1 and list(profiles.valid(got)) == ["own"]


def test_balances_with_gaps(spark):
    check = lambda rows: tuple(statements.balance_check(spark.createDataFrame([("f", i, c, b, e) for i, (c, b, e) in enumerate(rows)], "path string, row_index int, cents long, balance_cents long, error string")).first())
    assert check([(100, 1000, None), (50, None, None), (25, 1075, None), (5, 1080, None)]) == ("f", "reconciled", "ascending", 1, 0)
    assert check([(100, 1000, None), (50, None, None), (25, 1075, None)]) == ("f", "mismatch", "ascending", 0, 0)  # no pair was checked
    assert check([(-5, 1000, None), (5, 1005, None), (7, 1000, None)])[1:3] == ("reconciled", "descending")
    assert check([(5, 1005, None), (9, 1, "date"), (-5, 1000, None), (1, 1006, None)])[1] == "mismatch"
    rows = spark.createDataFrame([("f", -1), ("f", -2), ("f", 3)], "path string, balance_cents long")
    assert statements.sign_check(rows).count() == 1 and statements.sign_check(rows, account_type="credit_card").count() == 0


def test_exact_quantiles(spark):
    r = random.Random(5)
    for values in ([3], [5, 5, 5], [r.randrange(-50, 50) for _ in range(101)], [10**12, 1, 2, 3], [r.randrange(10**6) for _ in range(1000)]):
        df = spark.createDataFrame([("g", v) for v in values], "k string, x long")
        for p in (0.0, 0.5, 0.99, 1.0):
            want = df.groupBy("k").agg(F.percentile("x", p).alias("q")).first().q
            assert abs(rules.ranked(df, ["k"], "x", p, "q").first().q - want) < 1e-9 * max(1, abs(want))


def test_quantiles_of_many_values_with_one_far_away(spark, monkeypatch):
    monkeypatch.setattr(rules, "ALONE", 50)
    r = random.Random(9)
    rows = [("far", v) for v in [*range(5000), 10**15]] + [("few", r.randrange(9)) for _ in range(3000)] + [("wide", r.randrange(-(10**9), 10**9)) for _ in range(5000)] + [(None, 4), (None, 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x long")
    want = {r.k: r for r in df.where("x is not null").groupBy("k").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.99).alias("b"), F.count("*").alias("n")).collect()}
    for p, name in ((0.5, "a"), (0.99, "b")):
        got = {r.k: (r.q, r.n) for r in rules.ranked(df, ["k"], "x", p, "q").collect()}
        assert set(got) == set(want) and all(abs(q - want[k][name]) <= 1e-9 * max(1, abs(q)) and n == want[k].n for k, (q, n) in got.items())


def test_trends_over_covered_months(spark):
    day = DAY
    months = [day(2025, m, 1) for m in (1, 2, 3, 5, 6)]  # April is not covered
    cents = {"a": [100, 100, 100, 9000, 100], "b": [100, 7000, 20000, 30000, 40000], "one": [100, 100, 100, 90000, 100], "out": [100, 100, 100, 90000, 100]}
    rows = [(f"{c}{k}", c, d, -x, False) for c, xs in cents.items() for k, (d, x) in enumerate(zip(months, xs))]
    rows += [("april", "a", day(2025, 4, 9), -80000, False), ("later", "a", day(2025, 6, 9), -90000, True), ("null", None, day(2025, 5, 9), -90000, False)]
    df = spark.createDataFrame(rows, "id string, category string, date date, cents long, pending boolean")
    covered = spark.createDataFrame([(d,) for d in months], "month date")
    kinds = spark.createDataFrame([("a", "spend"), ("b", "spend"), ("one", "spend"), ("out", "transfer")], "category string, kind string")
    members = spark.createDataFrame([("s", ["one3", "one0", "a1"]), ("t", ["a3"])], "series string, charges array<string>")
    of = trends.charges(members)
    assert [r.category for r in trends.dominated(df, of).collect()] == ["one"]  # of a, the largest series is a tenth: April counts
    got = {(r.kind, r.category, str(r.month), r.impact, r.place) for r in trends.trends(df, covered, kinds, of, None).collect()}
    # May's mean before is of January to March; the climb runs over the gap.
    assert got == {("spike", "a", "2025-05-01", 8900, 3), ("spike", "b", "2025-05-01", 20967, 2), ("spike", "b", "2025-06-01", 21000, 1), ("climb", "b", "2025-06-01", 39900 * 12, 1)}
    assert trends.trends(df, covered, kinds, of, 1).count() == 2
    assert trends.trends(df, covered.limit(0), kinds, of).count() == 0 and trends.trends(df.limit(0), covered, kinds, of).count() == 0


def test_largest_of_a_year_beside_series(spark):
    rows = [(str(k), DAY(2025, 1 + k % 12, 3), -(1000 + k), False) for k in range(60)] + [("rent", DAY(2025, 2, 1), -99999, False), ("tv", DAY(2025, 3, 1), -50000, False)]
    df = spark.createDataFrame(rows, "id string, date date, cents long, pending boolean")
    series_of = spark.createDataFrame([("s", "rent")], "series string, id string")
    assert [tuple(r) for r in rules.windows(df, series_of).collect()] == [(2025, 1, 50000)]
    assert [tuple(r) for r in rules.windows(df, series_of.limit(0)).collect()] == [(2025, 1, 99999)]
    assert rules.windows(df.where("id <> 'tv'").limit(49), series_of).count() == 0


def test_folds_and_amounts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.collapse(F.lit("PHỞ Ế ậ"))) == "PHO E A"
    assert one(money.parse(F.lit("usd 7"))) == 700 and one(money.parse(F.lit("(5)-"))) is None
    assert [one(money.problem(F.lit(x))) for x in ("", "12", "abc", "99999999999999999")] == ["empty", None, "not an amount", "too large"]


def test_a_confirmed_single_debit_teaches_a_rule_once(spark):
    rows = spark.createDataFrame([(1, "a", "XFER TO 0042"), (2, "b", "DEPOSIT"), (3, "a", "XFER TO 0043"), (4, "b", "DEPOSIT"), (5, "a", "PMT"), (6, "a", "PMT"), (7, "b", "DEPOSIT")], "id long, account string, raw string")
    links = spark.createDataFrame([(1, 2, "proposed"), (3, 4, "proposed"), (5, 7, "proposed"), (6, 7, "proposed"), (1, 7, "auto")], "debit long, credit long, state string")
    none = spark.createDataFrame([], "rule string, pattern string, debit_account string, credit_account string")
    chosen = spark.createDataFrame([(2,), (4,), (7,)], "credit long")
    after, learned = transfers.confirmed(links, rows, none, chosen)
    assert sorted((r.debit, r.credit, r.state) for r in after.collect()) == [(1, 2, "confirmed"), (1, 7, "auto"), (3, 4, "confirmed"), (5, 7, "confirmed"), (6, 7, "confirmed")]
    assert [(r.pattern, r.debit_account, r.credit_account) for r in learned.collect()] == [("XFER TO", "a", "b")]
    assert transfers.confirmed(links, rows, learned, chosen)[1].count() == 1
