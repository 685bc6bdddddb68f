"""Registered queries on series, fees, transfers, imports, findings, aliases, searches and coverage, and their SQL.

The driver's tables rarely meet these rules' conditions, so ledgers are built from them: each
customer is a merchant with charges of a known cadence, price and number, so that the SQL can state
the result in terms of the customer's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounts, aliases, coverage, fees, findings, imports, rules, run, search, series, store, transfers, trends
from ..operators.walks import held
from ..sources import ledger, statements
from . import statements as statement_plans

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    """SQL that both engines read, over the driver's tables."""
    for t in tables:
        ledger.table(spark, d, t).createOrReplaceTempView(f"tf_{t}")
        text = text.replace(f" {t} ", f" tf_{t} ")
    return spark.sql(text)


# Each customer's charges: a cadence by number modulo 5, 4 to 12 of them, a dearer price from the fourth on for every third.
_N = "(4 + c_custkey % 9)"
_DAYS = "(CASE c_custkey % 5 WHEN 0 THEN 7.0 WHEN 1 THEN 14.0 WHEN 3 THEN 91.3 ELSE 30.44 END)"
_LABEL = "(CASE c_custkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' WHEN 3 THEN 'quarterly' ELSE 'monthly' END)"
_PER_YEAR = "(CASE c_custkey % 5 WHEN 0 THEN 52.18 WHEN 1 THEN 26.09 WHEN 3 THEN 4.0 ELSE 12.0 END)"
_FIRST = "(500 + c_custkey % 40 * 25)"
_NOW = f"({_FIRST} + CASE WHEN c_custkey % 3 = 0 THEN 300 ELSE 0 END)"
_AT = f"(DATE '2023-01-05' + CAST(floor({{k}} * {_DAYS}) AS INT))"
_LAST = _AT.format(k=f"({_N} - 1)")
_END = "DATE '2024-03-31'"
_CHARGES = f"""SELECT c_custkey * 100 + n_nationkey AS id, c_custkey AS merchant, c_nationkey AS account, {_AT.format(k='n_nationkey')} AS date,
-({_FIRST} + CASE WHEN c_custkey % 3 = 0 AND n_nationkey >= 3 THEN 300 ELSE 0 END) AS cents, c_mktsegment AS category, FALSE AS pending, FALSE AS excluded, CAST('SHOP ' || c_custkey || CASE WHEN c_custkey % 4 = 2 THEN ' FREE TRIAL' ELSE '' END AS VARCHAR(40)) AS raw, CASE WHEN c_custkey % 4 = 1 THEN 'SHOP FREE TRIAL' ELSE 'TRIALS SHOP' END AS normalized
FROM customer JOIN nation ON n_nationkey < {_N}"""
_LIVE = f"(date_diff('day', {_LAST}, {_END}) <= 1.5 * {_DAYS})"


def _charges(spark, d) -> DataFrame:
    return _sql(spark, d, _CHARGES.replace("VARCHAR(40)", "STRING"), "customer", "nation")


def _merchants(spark, d) -> DataFrame:
    c = ledger.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("merchant"), F.lit(False).alias("known"), F.lit(False).alias("transfer_kind"), F.concat(F.lit("g"), (F.col("c_custkey") % 7).cast("string")).alias("overlap_group"))


def _covered(spark, d) -> DataFrame:
    return ledger.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("account")).distinct().withColumn("coverage_end", F.lit("2024-03-31").cast("date"))


def _series(spark, d) -> DataFrame:
    """Kept, as the rules on series read it several times."""
    return series.series(_charges(spark, d), _merchants(spark, d), _covered(spark, d)).persist()


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS merchant, {_LABEL} AS cadence, {_N} AS n, {_FIRST} AS first_cents, {_NOW} AS current_cents, DATE '2023-01-05' AS first_seen, {_LAST} AS last_seen, CASE WHEN {_LIVE} THEN 'active' ELSE 'lapsed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS steps, c_custkey % 3 = 0 AND ({_N} > 4 OR c_custkey % 5 = 3) AS confirmed FROM customer")
def r2_recurrence(spark, d):
    s = _series(spark, d)
    confirmed = F.coalesce(F.get("steps", F.lit(0))["confirmed"], F.lit(False))
    return s.select("merchant", "cadence", F.col("n").cast("long").alias("n"), "first_cents", "current_cents", "first_seen", "last_seen", "status", F.size("steps").alias("steps"), confirmed.alias("confirmed"))


@query(f"WITH s AS (SELECT CAST(floor({_NOW} * {_PER_YEAR} + 0.5) AS BIGINT) AS annual, {_LIVE} AS live FROM customer) SELECT 'all' AS subject, count(*) FILTER (live) AS active, count(*) FILTER (NOT live) AS lapsed, CAST(floor(sum(annual) FILTER (live) / 12 + 0.5) AS BIGINT) AS monthly, CAST(sum(annual) FILTER (live) AS BIGINT) AS annual, CAST(0.9 AS DOUBLE) AS confidence FROM s")
def r2_portfolio(spark, d):
    return series.portfolio(_series(spark, d))


@query(f"SELECT CASE WHEN {_LIVE} THEN 'active' ELSE 'lapsed' END AS status, count(*) AS n, CAST(floor(sum({_NOW} * {_PER_YEAR}) + 0.5) AS BIGINT) AS annual, CAST(floor(floor(sum({_NOW} * {_PER_YEAR}) + 0.5) / 12 + 0.5) AS BIGINT) AS monthly FROM customer GROUP BY 1")
def a12_series_totals(spark, d):
    # In decimals, as a sum of doubles depends on its order.
    s = _series(spark, d).withColumn("per_year", F.col("per_year").cast("decimal(6,2)"))
    return series.totals(s)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS merchant, CAST(floor(300 * {_PER_YEAR} + 0.5) AS BIGINT) AS impact, 1 AS steps, TRUE AS first_material FROM customer WHERE c_custkey % 3 = 0")
def r5_price_creep(spark, d):
    s = _series(spark, d)
    return series.price_creep(s).join(s.select("series", "merchant"), "series").select("merchant", "impact", "steps", "first_material")


def _two_plans(spark, d) -> DataFrame:
    """Monthly customers of every fourth number have a second plan, half a month later at three times the price."""
    a = _charges(spark, d).where("merchant % 5 in (2, 4)")
    b = a.where("merchant % 4 = 1").withColumns({"id": F.col("id") + 50, "date": F.date_add("date", 15), "cents": F.col("cents") * 3})
    return a.unionByName(b)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS merchant, CAST(2 AS BIGINT) AS n, CAST({_NOW} * 12 AS BIGINT) AS impact FROM customer WHERE c_custkey % 5 IN (2, 4) AND c_custkey % 4 = 1")
def r3_duplicates(spark, d):
    s = series.series(_two_plans(spark, d), _merchants(spark, d), _covered(spark, d))
    return series.duplicates(s).join(s.select(F.col("series").alias("subject"), "merchant"), "subject").select("merchant", "n", "impact")


@query(f"SELECT 'g' || c_custkey % 7 AS overlap_group, count(*) AS n, CAST(sum(floor({_NOW} * {_PER_YEAR} + 0.5)) AS BIGINT) AS annual, CAST(0.6 AS DOUBLE) AS confidence FROM customer WHERE {_LIVE} GROUP BY 1 HAVING count(*) >= 2")
def r4_overlaps(spark, d):
    return series.overlaps(_series(spark, d), _merchants(spark, d))


@query("SELECT CAST(c_custkey AS VARCHAR) AS merchant, CASE c_custkey % 4 WHEN 0 THEN 3 ELSE 2 END AS points, TRUE AS early, CAST(CASE c_custkey % 4 WHEN 0 THEN 0.375 ELSE 0.35 END AS DOUBLE) AS confidence FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 3 <> 0")
def r6_trials(spark, d):
    rows = _charges(spark, d)
    first = rows.where("id % 100 = 0 and merchant % 4 = 0").withColumns({"id": F.col("id") + 99, "date": F.date_sub("date", 14), "cents": F.lit(-100)})
    s = _series(spark, d)
    reported = series.price_creep(s).where("first_material")
    out = series.trials(s, rows.unionByName(first), reported)
    return out.join(s.select("series", "merchant"), "series").select("merchant", "points", "early", "confidence")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS merchant, CAST(date_diff('day', {_LAST}, {_END}) AS INTEGER) AS days FROM customer WHERE date_diff('day', {_LAST}, {_END}) > 2 * {_DAYS}")
def r7_lapsed(spark, d):
    s = _series(spark, d)
    return series.lapsed(s, _covered(spark, d)).join(s.select("series", "merchant"), "series").select("merchant", "days")


_GAPS = f"SELECT merchant, date_diff('day', lag(date) OVER (PARTITION BY merchant ORDER BY date, id), date) AS gap FROM ({_CHARGES})"


@query(f"""WITH g AS ({_GAPS}), c(days, tol) AS (VALUES (7.0::DOUBLE, 2.0::DOUBLE), (14.0, 2.0), (28.0, 2.0), (30.44, 4.0), (91.3, 7.0), (182.6, 12.0), (365.25, 20.0)),
f AS (SELECT merchant, days, tol, count(*) AS n, min(floor(gap / days + 0.5)) AS low, max(floor(gap / days + 0.5)) AS high, avg(floor(gap / days + 0.5)) AS turns, median(abs(gap - floor(gap / days + 0.5) * days)) AS score, min(gap) AS s, max(gap) AS l FROM g CROSS JOIN c WHERE gap IS NOT NULL GROUP BY ALL),
o AS (SELECT *, bool_or(days = 28) OVER (PARTITION BY merchant) AND bool_or(days = 30.44) OVER (PARTITION BY merchant) AS twin FROM f WHERE n >= 2 AND low >= 1 AND high <= 3 AND score <= tol)
SELECT merchant AS grp, days, score FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY score, turns, days) AS place FROM o WHERE NOT twin OR days = CASE WHEN s >= 27 AND l <= 29 AND n + 1 >= 6 THEN 28 ELSE 30.44 END) WHERE place = 1""")
def r1_cadence(spark, d):
    return rules.cadences(_charges(spark, d), "merchant")


# Small spend: every line item at one of 150 merchants or fewer, some frequented and some not; a third of them are dearer.
_SHOP = "CAST(floor((l_partkey % 150) * (l_partkey % 150) / 150.0) AS BIGINT)"
_SMALL = f"SELECT l_orderkey * 10 + l_linenumber AS id, {_SHOP} AS merchant, CASE WHEN {_SHOP} = 1 THEN 'only' ELSE 'c' || {_SHOP} % 4 END AS category, CAST(l_shipdate AS DATE) AS date, -(300 + (l_orderkey * 37 + l_linenumber * 11) % 1400 + CASE WHEN {_SHOP} % 3 = 0 THEN 900 ELSE 0 END) AS cents FROM lineitem "


@query(f"""WITH r AS (SELECT *, -cents AS x, date_trunc('month', date) AS month FROM ({_SMALL})), e AS (SELECT min(date) AS a, max(date) AS b FROM r),
ends AS (SELECT CAST(CASE WHEN a = date_trunc('month', a) THEN a ELSE date_trunc('month', a) + INTERVAL 1 MONTH END AS DATE) AS f, CAST(CASE WHEN b = last_day(b) THEN date_trunc('month', b) ELSE date_trunc('month', b) - INTERVAL 1 MONTH END AS DATE) AS l FROM e),
months AS (SELECT CAST(unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends), m AS (SELECT count(*) AS months FROM months), s AS (SELECT r.* FROM r JOIN months USING (month)),
a AS (SELECT merchant, count(*) AS n, sum(x) AS total, median(x) AS med, any_value(months) AS months FROM s CROSS JOIN m GROUP BY merchant), am AS (SELECT * FROM a WHERE months >= 3 AND n / months >= 8 AND med <= 1500),
c AS (SELECT category, count(*) AS n, sum(x) AS total, median(x) AS med, any_value(months) AS months FROM s CROSS JOIN m GROUP BY category),
o AS (SELECT category, max(own) AS own FROM (SELECT category, merchant, sum(x) AS own FROM s WHERE merchant IN (SELECT merchant FROM am) GROUP BY ALL) GROUP BY category)
SELECT 'merchant' AS kind, CAST(merchant AS VARCHAR) AS grp, n, CAST(floor(total / months + 0.5) AS BIGINT) AS monthly, CAST(floor(total / months + 0.5) * 12 AS BIGINT) AS annual FROM am
UNION ALL SELECT 'category', category, n, CAST(floor(total / months + 0.5) AS BIGINT), CAST(floor(total / months + 0.5) * 12 AS BIGINT) FROM c LEFT JOIN o USING (category) WHERE months >= 3 AND n / months >= 8 AND med <= 1500 AND coalesce(own, 0) <= 0.8 * total""")
def r13_micro(spark, d):
    return rules.micro(_sql(spark, d, _SMALL, "lineitem"))


# Fees: orders whose descriptors name some.
_WORDS = ["LATE FEE 04", "ATM FEE WITHDRAWAL", "MONTHLY MAINTENANCE", "INTEREST CHECKING PAID", "LATE FEE REVERSAL", "COFFEE SHOP", "OVERDRAFTS R US", "NSF ITEM", "INTEREST CHARGE", "MINIMUM BALANCE CHARGE", "FLATE FEES"]
_WORD = "(CASE o_orderkey % 11 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END)"
_FEES = f"SELECT o_orderkey AS id, o_custkey % 400 AS account, o_custkey AS merchant, CAST(o_orderdate AS DATE) AS date, -CAST(1000 + o_orderkey % 3000 AS BIGINT) AS cents, {_WORD} AS normalized, o_orderstatus = 'P' AS pending, FALSE AS excluded, CASE WHEN o_orderkey % 22 = 5 THEN 'bank' ELSE 'other' END AS category FROM orders"
_FEE_OF = "(CASE " + " ".join(f"WHEN regexp_matches(normalized, '(^|[^A-Z0-9]){k}([^A-Z0-9]|$)') THEN '{k}'" for k in fees.KEYWORDS) + " END)"


def _fee_rows(spark, d):
    rows = _sql(spark, d, _FEES + " ", "orders")
    kinds = spark.createDataFrame([("bank", "fee"), ("other", "spend")], "category string, kind string")
    return rows, fees.fees(rows, kinds)


_FOUND = f"SELECT *, -cents AS x, {_FEE_OF} AS keyword FROM ({_FEES}) WHERE NOT pending AND normalized NOT LIKE '%INTEREST CHECKING%' AND NOT regexp_matches(normalized, '(^|[^A-Z0-9])(REFUND|REVERSAL|CREDIT|WAIVED|ADJUSTMENT)([^A-Z0-9]|$)') AND ({_FEE_OF} IS NOT NULL OR category = 'bank')"


@query(f"SELECT id, x, keyword FROM ({_FOUND})")
def r8_fee_rows(spark, d):
    return _fee_rows(spark, d)[1].select("id", "x", "keyword")


@query(f"""WITH f AS (SELECT *, keyword IN ('MONTHLY MAINTENANCE', 'MINIMUM BALANCE') AND count(*) OVER (PARTITION BY account, keyword) >= 2 AS saves FROM ({_FOUND})),
g AS (SELECT account, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(date_diff('month', min(date), max(date)) + 1 AS INTEGER) AS months, bool_or(keyword IS NOT NULL) AS w, CAST(coalesce(sum(x) FILTER (saves), 0) AS BIGINT) AS avoidable FROM f GROUP BY account)
SELECT account, n, total, months, CAST(floor(total * 12 / months + 0.5) AS BIGINT) AS annual, avoidable, CAST(floor(CASE WHEN avoidable > 0 THEN avoidable ELSE total END * 12 / months + 0.5) AS BIGINT) AS impact, CASE WHEN avoidable > 0 THEN 'savings' ELSE 'visibility' END AS kind, CAST(CASE WHEN w THEN 0.95 ELSE 0.75 END AS DOUBLE) AS confidence FROM g""")
def r8_fees(spark, d):
    rows, found = _fee_rows(spark, d)
    return fees.findings(found, fees.reversals(found, rows)).drop("breakdown")


@query(f"SELECT account, coalesce(keyword, 'fee category') AS name, count(*) AS n, CAST(sum(x) AS BIGINT) AS cents FROM ({_FOUND}) GROUP BY ALL")
def a14_fee_breakdown(spark, d):
    rows, found = _fee_rows(spark, d)
    out = fees.findings(found, fees.reversals(found, rows)).select("account", F.explode("breakdown").alias("name", "b"))
    return out.select("account", "name", "b.n", "b.cents")


@query(None)
def j15_fee_reversals(spark, d):
    rows, found = _fee_rows(spark, d)
    back = rows.where("id % 3 = 0").withColumns({"id": F.col("id") + 10_000_000, "cents": -F.col("cents"), "date": F.date_add("date", 20)})
    return fees.reversals(found, rows.unionByName(back))


# Transfers: events as a ledger whose descriptors name accounts and transfers.
_KINDS = ["click", "purchase", "signup", "view", "refund", "login", "logout", "search"]
_LEDGER = """SELECT event_id AS id, event_type AS account, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) * (CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) AS cents,
CASE event_id % 6 WHEN 0 THEN 'ONLINE PMT CARDINAL CARD' WHEN 1 THEN 'XFER 0042' WHEN 2 THEN 'COFFEE SHOP' WHEN 3 THEN 'TRANSFER TO 0007' WHEN 4 THEN 'Harbor Savings autopay' ELSE 'MARKET 12' END AS raw, user_id AS merchant,
CASE event_id % 6 WHEN 0 THEN 'ONLINE PMT CARDINAL CARD' WHEN 1 THEN 'XFER' WHEN 2 THEN 'COFFEE SHOP' WHEN 3 THEN 'TRANSFER TO' WHEN 4 THEN 'HARBOR SAVINGS AUTOPAY' ELSE 'MARKET' END AS normalized,
event_id % 17 = 0 AS pending, event_id % 19 = 0 AS excluded, event_id % 23 = 0 AS transfer, CAST(NULL AS VARCHAR(9)) AS refund_pair, CAST(user_id % 7 AS VARCHAR(9)) AS category FROM events """
_SIDES = "(SELECT 'signup' AS account, 'credit_card' AS account_type, 'Cardinal Bank' AS institution, '0042' AS last4 UNION ALL SELECT 'view', 'savings', 'Harbor Savings', '0007' UNION ALL SELECT 'purchase', 'checking', 'Northgate', '0042')"


def _ledger(spark, d) -> DataFrame:
    return _sql(spark, d, _LEDGER.replace("VARCHAR(9)", "STRING"), "events")


def _accounts(spark) -> DataFrame:
    return spark.createDataFrame([("signup", "credit_card", "Cardinal Bank", "0042"), ("view", "savings", "Harbor Savings", "0007"), ("purchase", "checking", "Northgate", "0042")], "account string, account_type string, institution string, last4 string")


_KEY = lambda t: "(" + " OR ".join(f"contains({t}, '{k}')" for k in transfers.KEYWORDS) + ")"
_ELIGIBLE = f"SELECT *, normalized || chr(10) || upper(raw) AS text FROM ({_LEDGER}) WHERE cents <> 0 AND NOT pending AND NOT excluded"
_PAIRS = f"SELECT a.id AS debit, b.id AS credit, b.cents, date_diff('day', a.date, b.date) AS gap, a.account AS da, b.account AS ca, a.text AS dt, b.text AS ct, a.normalized AS dn, a.merchant AS dm FROM ({_ELIGIBLE}) a JOIN ({_ELIGIBLE}) b ON -a.cents = b.cents AND a.cents < 0 AND b.cents > 0 AND a.account <> b.account AND date_diff('day', a.date, b.date) BETWEEN -1 AND 7"
_SCORES = f"""SELECT debit, credit, (CASE WHEN {_KEY('dt')} AND {_KEY('ct')} THEN 3 ELSE 0 END) + (CASE WHEN coalesce(contains(dt, cs.last4), FALSE) OR coalesce(contains(ct, ds.last4), FALSE) THEN 2 ELSE 0 END)
+ (CASE WHEN cs.account_type = 'credit_card' AND regexp_matches(dt, '(^|[^A-Z0-9])CARDINAL([^A-Z0-9]|$)') THEN 2 ELSE 0 END) + (CASE WHEN abs(gap) <= 3 THEN 1 ELSE 0 END) + (CASE WHEN ca = 'view' AND da = 'purchase' AND starts_with(dn, 'TRANSFER') THEN 3 ELSE 0 END) - (CASE WHEN dm % 5 = 0 AND da = 'purchase' THEN 2 ELSE 0 END) AS score
FROM ({_PAIRS}) LEFT JOIN {_SIDES} cs ON cs.account = ca LEFT JOIN {_SIDES} ds ON ds.account = da"""


def _scoring(spark, d) -> tuple[DataFrame, ...]:
    """Ledger, accounts, rules, spending and series of the scores."""
    rows = _ledger(spark, d)
    rule = spark.createDataFrame([("r1", "TRANSFER", "purchase", "view")], "rule string, pattern string, debit_account string, credit_account string")
    subscribed = rows.where("merchant % 5 = 0 and account = 'purchase'").select("merchant", "account").distinct()
    return rows, _accounts(spark), rule, None, subscribed


@query(f"SELECT debit, credit, CAST(score AS INTEGER) AS score, CASE WHEN score >= 5 THEN 'auto' WHEN score >= 2 THEN 'proposed' ELSE 'ignored' END AS state FROM ({_SCORES})")
def j3_transfer_scores(spark, d):
    return transfers.scored_candidates(*_scoring(spark, d)).select("debit", "credit", "score", transfers.disposition(F.col("score")).alias("state"))


@query(f"SELECT debit, credit, cents, CAST(gap AS INTEGER) AS gap FROM ({_PAIRS}) WHERE debit % 2 = 0 OR credit % 3 > 0")
def j2_transfer_candidates(spark, d):
    rows = _ledger(spark, d)
    rejected = transfers.candidates(rows).where("debit % 2 = 1 and credit % 3 = 0")
    return transfers.candidates(rows, rejected)


@query(None)
def j6_transfer_assignment(spark, d):
    return transfers.matched_candidates(*_scoring(spark, d)).select("debit", "credit", "score", "state")


@query(None)
def j7_partial_payments(spark, d):
    rows = _ledger(spark, d)
    used = transfers.matched_candidates(*_scoring(spark, d)).select(F.explode(F.array("debit", "credit")).alias("id"))
    out = transfers.partial_payments(rows.withColumn("owner", F.col("merchant") % 20), used, _accounts(spark), owner="owner")
    return out.select("credit", F.array_join(F.transform("debits", lambda x: x.cast("string")), ",").alias("debits"), "score")


@query(f"SELECT id, account, cents FROM ({_ELIGIBLE}) e WHERE cents < 0 AND {_KEY('text')} AND NOT EXISTS (SELECT 1 FROM ({_PAIRS}) p WHERE p.debit = e.id)")
def j9_unmatched_debits(spark, d):
    rows = _ledger(spark, d)
    return transfers.unmatched(rows, transfers.candidates(rows)).select("id", "account", "cents")


@query(f"SELECT account, count(*) AS n FROM (SELECT *, normalized || chr(10) || upper(raw) AS text FROM ({_LEDGER})) e WHERE cents < 0 AND {_KEY('text')} AND NOT EXISTS (SELECT 1 FROM ({_PAIRS}) p WHERE p.debit = e.id) GROUP BY account")
def q3_unlinked_by_account(spark, d):
    rows = _ledger(spark, d)
    return search.unlinked_by_account(rows, transfers.candidates(rows))


@query(r"SELECT id, CASE WHEN length(regexp_replace(raw, '( \S*\d\S*)+$', '')) < 4 THEN raw ELSE regexp_replace(raw, '( \S*\d\S*)+$', '') END AS pattern FROM (" + _LEDGER + ")")
def j10_rule_patterns(spark, d):
    return _ledger(spark, d).select("id", transfers.pattern(F.col("raw")).alias("pattern"))


@query(f"SELECT debit, credit, state FROM (SELECT debit, credit, 'confirmed' AS state FROM ({_PAIRS}) WHERE debit % 50 = 0 UNION ALL SELECT debit, credit, 'rejected' FROM ({_PAIRS}) WHERE debit % 50 = 1 UNION ALL SELECT debit, credit, 'auto' FROM ({_PAIRS}) p WHERE debit % 50 NOT IN (0, 1) AND NOT EXISTS (SELECT 1 FROM ({_PAIRS}) q WHERE q.debit % 50 = 0 AND q.credit = p.credit))")
def q11_machine_links(spark, d):
    pairs = transfers.candidates(_ledger(spark, d)).select("debit", "credit").withColumn("score", F.lit(5))
    state = F.when(F.col("debit") % 50 == 0, "confirmed").when(F.col("debit") % 50 == 1, "rejected")
    old = pairs.withColumn("state", state).where("state is not null").unionByName(pairs.where("debit % 50 = 2").withColumn("state", F.lit("proposed")))
    return transfers.replaced(old, pairs.withColumn("state", F.lit("auto"))).select("debit", "credit", "state")


@query(f"SELECT credit, state, count(DISTINCT debit) AS debits, CAST(sum(cents) AS BIGINT) AS reduction FROM (SELECT *, CASE WHEN credit % 2 = 0 THEN 'auto' ELSE 'proposed' END AS state FROM ({_PAIRS})) WHERE state = 'auto' GROUP BY ALL")
def q13_link_groups(spark, d):
    rows = _ledger(spark, d)
    links = transfers.candidates(rows).withColumns({"state": F.when(F.col("credit") % 2 == 0, "auto").otherwise("proposed"), "score": F.lit(3)})
    return transfers.groups(links, rows, ["auto"]).select("credit", "state", "debits", "reduction")


# Stored links of the pairs, of four states, and the flags that they set; every 23rd row is marked by hand.
_STATE = "CASE WHEN debit % 50 = 0 THEN 'confirmed' WHEN debit % 50 = 1 THEN 'rejected' WHEN debit % 3 = 0 THEN 'auto' ELSE 'proposed' END"
_FLAGS = f"""p AS (SELECT debit, credit FROM ({_PAIRS})), old AS (SELECT *, concat('L', debit, '-', credit) AS link, CAST(debit % 5 AS INTEGER) AS created, {_STATE} AS state FROM p WHERE debit % 3 < 2 OR debit % 50 < 2),
rep AS (SELECT *, first_value(link) OVER (PARTITION BY credit, state ORDER BY created, link) AS pair FROM old),
sides AS (SELECT unnest([debit, credit]) AS id, debit, credit, state, pair FROM rep),
l AS (SELECT e.id, account, date, cents, transfer OR s.id IS NOT NULL AS transfer, s.pair FROM ({_LEDGER}) e LEFT JOIN (SELECT DISTINCT ON (id) id, pair FROM sides WHERE state IN ('auto', 'confirmed') ORDER BY id, credit DESC, debit DESC) s USING (id))"""
_RELINKED = f"""WITH {_FLAGS},
w AS (SELECT p.debit, p.credit, CASE WHEN p.credit % 2 = 0 THEN 'auto' ELSE 'proposed' END AS state, coalesce(o.link, left(sha256(concat(p.debit, '|', p.credit)), 16)) AS link, coalesce(o.created, 9) AS created FROM p LEFT JOIN old o ON o.debit = p.debit AND o.credit = p.credit AND o.state IN ('auto', 'proposed')
WHERE p.credit % 4 <> 3 AND NOT EXISTS (SELECT 1 FROM old x WHERE x.debit = p.debit AND x.credit = p.credit AND x.state IN ('confirmed', 'rejected'))),
wr AS (SELECT *, first_value(link) OVER (PARTITION BY credit, state ORDER BY created, link) AS pair FROM w), ws AS (SELECT unnest([debit, credit]) AS id, * FROM wr),
mr AS (SELECT *, first_value(link) OVER (PARTITION BY credit, state ORDER BY created, link) AS mpair FROM old WHERE state IN ('auto', 'proposed')),
stale AS (SELECT unnest([debit, credit]) AS id, mpair AS pair FROM mr WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.debit = mr.debit AND w.credit = mr.credit)),
clear AS (SELECT id, pair FROM stale UNION SELECT id, pair FROM ws WHERE state = 'proposed'),
flag AS (SELECT DISTINCT ON (id) id, pair FROM ws WHERE state = 'auto' ORDER BY id, credit DESC, debit DESC)"""


def _links(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger with flags, stored links, all pairs)."""
    rows = _ledger(spark, d)
    pairs = held(transfers.candidates(rows).select("debit", "credit").withColumn("score", F.lit(5)))
    old = pairs.where("debit % 3 < 2 or debit % 50 < 2").withColumns({"link": F.expr("concat('L', debit, '-', credit)"), "created": F.expr("cast(debit % 5 as int)"), "state": F.expr(_STATE)}).select(*transfers.LINKS)
    shown = transfers._sides(old.where("state in ('auto', 'confirmed')"), "debit", "credit", F.expr("state = 'confirmed'").alias("sure"))
    last = shown.groupBy("id").agg(F.max(F.struct("credit", "debit", "sure")).alias("last")).select("id", "last.credit", F.expr("if(last.sure, 'confirmed', 'auto')").alias("state"))
    sides = last.join(transfers.group_pairs(old), ["credit", "state"]).select("id", "pair")
    return rows.join(sides, "id", "left").withColumn("transfer", F.col("transfer") | F.col("pair").isNotNull()), old, pairs


def _relinked(spark, d) -> tuple[DataFrame, DataFrame]:
    rows, old, pairs = _links(spark, d)
    return transfers.relinked(rows, old, pairs.where("credit % 4 <> 3").withColumn("state", F.expr("CASE WHEN credit % 2 = 0 THEN 'auto' ELSE 'proposed' END")), F.lit(9))


@query(f"{_RELINKED} SELECT l.id, CASE WHEN f.id IS NOT NULL THEN TRUE WHEN c.id IS NOT NULL THEN FALSE ELSE transfer END AS transfer, CASE WHEN f.id IS NOT NULL THEN f.pair WHEN c.id IS NULL THEN l.pair END AS pair FROM l LEFT JOIN flag f USING (id) LEFT JOIN clear c ON c.id = l.id AND c.pair = l.pair")
def q11_link_flags(spark, d):
    return _relinked(spark, d)[0].select("id", "transfer", "pair")


@query(f"{_RELINKED} SELECT debit, credit, state, link, created FROM old WHERE state IN ('confirmed', 'rejected') UNION ALL SELECT debit, credit, state, link, created FROM w")
def q11_links_kept(spark, d):
    return _relinked(spark, d)[1].select("debit", "credit", "state", "link", "created")


# The account of purchases merged into the one of views; a key's occurrences run against the ids.
_OWN = f"SELECT *, CAST(abs(cents) % 50 AS VARCHAR) AS key, row_number() OVER (PARTITION BY account, abs(cents) % 50 ORDER BY id DESC) - 1 AS occurrence FROM l"
_DOOMED = f"""WITH {_FLAGS}, o AS ({_OWN}), a AS (SELECT id, CASE WHEN account = 'purchase' THEN 'view' ELSE account END AS account FROM l),
doomed AS (SELECT rep.* FROM rep JOIN a x ON x.id = debit JOIN a y ON y.id = credit WHERE x.account = y.account), gone AS (SELECT DISTINCT unnest([debit, credit]) AS id, pair FROM doomed)"""


def _merged(spark, d) -> dict[str, DataFrame]:
    rows, old, _ = _links(spark, d)
    rows = rows.withColumn("key", F.expr("cast(abs(cents) % 50 as string)"))
    rows = rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy("account", "key").orderBy(F.desc("id"))) - 1).cast("long"))
    held = rows.select("account").distinct().withColumns({"currency": F.lit("USD"), "active": F.lit(True)})
    months = rows.groupBy("account", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    rules = rows.select(F.col("account").alias("debit_account"), "normalized").distinct().join(held.select(F.col("account").alias("credit_account")), F.col("debit_account") != F.col("credit_account"))
    return accounts.merged({"ledger": rows, "links": old, "accounts": held, "imports": months, "rules": rules}, "purchase", "view")


@query(f"""{_DOOMED}, base AS (SELECT key, max(occurrence) + 1 AS base FROM o WHERE account = 'view' GROUP BY key)
SELECT o.id, CASE WHEN account = 'purchase' THEN 'view' ELSE account END AS account, CASE WHEN account = 'purchase' THEN coalesce(base, 0) + row_number() OVER (PARTITION BY account, o.key ORDER BY date, o.id) - 1 ELSE occurrence END AS occurrence,
transfer AND g.id IS NULL AS transfer, CASE WHEN g.id IS NULL THEN o.pair END AS pair FROM o LEFT JOIN base USING (key) LEFT JOIN gone g ON g.id = o.id AND g.pair = o.pair""")
def q14_merged_ledger(spark, d):
    return _merged(spark, d)["ledger"].select("id", "account", "occurrence", "transfer", "pair")


@query(f"""{_DOOMED} SELECT 'link' AS kind, link AS name, state AS told FROM old WHERE link NOT IN (SELECT link FROM doomed)
UNION ALL SELECT 'account', account, CASE WHEN account = 'purchase' THEN 'archived' ELSE 'active' END FROM (SELECT DISTINCT account FROM l)
UNION ALL SELECT 'import', CASE WHEN account = 'purchase' THEN 'view' ELSE account END, concat(strftime(date, '%Y-%m'), ' ', count(*)) FROM l GROUP BY account, strftime(date, '%Y-%m')
UNION ALL SELECT 'rule', CASE WHEN d.account = 'purchase' THEN 'view' ELSE d.account END || ' ' || CASE WHEN c.account = 'purchase' THEN 'view' ELSE c.account END, normalized FROM (SELECT DISTINCT account, normalized FROM ({_LEDGER})) d JOIN (SELECT DISTINCT account FROM l) c ON d.account <> c.account AND NOT (d.account IN ('purchase', 'view') AND c.account IN ('purchase', 'view'))""")
def q14_merged_tables(spark, d):
    t = _merged(spark, d)
    row = lambda kind, name, told: (F.lit(kind).alias("kind"), name.alias("name"), told.alias("told"))
    out = t["links"].select(*row("link", F.col("link"), F.col("state")))
    out = out.unionByName(t["accounts"].select(*row("account", F.col("account"), F.when(F.col("active"), "active").otherwise("archived"))))
    out = out.unionByName(t["imports"].select(*row("import", F.col("account"), F.concat_ws(" ", "month", F.col("n").cast("string")))))
    return out.unionByName(t["rules"].select(*row("rule", F.concat_ws(" ", "debit_account", "credit_account"), F.col("normalized"))))


# Imports: line items as stored and incoming rows of an account; a repeated line item has a number of its own.
_BAG = """SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) - 1 AS id,
l_returnflag, l_suppkey AS account, CAST(l_partkey % 40 AS VARCHAR(9)) AS key, CAST(l_shipdate AS DATE) AS date, -CAST(l_quantity * 100 AS BIGINT) AS cents, l_linestatus = 'O' AS pending, l_orderkey AS row FROM lineitem """


def _bag(spark, d):
    rows = _sql(spark, d, _BAG.replace("VARCHAR(9)", "STRING"), "lineitem")
    old = rows.where("l_returnflag = 'N'").withColumn("occurrence", (F.row_number().over(Window.partitionBy("account", "key").orderBy("id")) - 1).cast("long"))
    return old, rows.where("l_returnflag <> 'N'")


_OLD = f"SELECT *, row_number() OVER (PARTITION BY account, key ORDER BY id) AS nth FROM ({_BAG}) WHERE l_returnflag = 'N'"
_NEW = f"SELECT *, row_number() OVER (PARTITION BY account, key ORDER BY row, id) AS nth FROM ({_BAG}) WHERE l_returnflag <> 'N'"


@query(f"SELECT n.id, CASE WHEN o.id IS NULL THEN 'insert' ELSE 'merge' END AS action, o.id AS existing, CASE WHEN o.id IS NULL THEN n.nth - 1 END AS occurrence FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (account, key, nth)")
def j11_merge_plan(spark, d):
    old, new = _bag(spark, d)
    return imports.merge_plan(old, new)


@query(None)
def j12_near_duplicates(spark, d):
    old, new = _bag(spark, d)
    return imports.claims(old, new)


@query(None)
def q17_import_review(spark, d):
    return imports.review(*_bag(spark, d))


@query(None)
def j14_refunds(spark, d):
    rows = _ledger(spark, d).withColumns({"merchant": F.col("merchant") % 50, "account": F.lit("all")})
    return imports.refunds(rows, rows.where("id % 3 <> 0").select("id", (-F.col("id")).alias("row")))


@query("SELECT id FROM (SELECT p_partkey AS id, p_partkey % 3 AS a, p_partkey % 5 AS b FROM part) WHERE NOT (a = 0 AND b <> 0)")
def q15_import_deletion(spark, d):
    rows = ledger.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    sources = rows.where("id % 3 = 0").selectExpr("id as transaction", "'x' as import", "1 as row").unionByName(rows.where("id % 5 = 0").selectExpr("id as transaction", "'y' as import", "2 as row"))
    return imports.without_import(rows, sources, "x")[0]


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'b' ELSE account END AS account, CASE WHEN p_partkey % 4 = 0 THEN coalesce(base, 0) + row_number() OVER (PARTITION BY p_partkey % 4 = 0, key ORDER BY occurrence, p_partkey) - 1 ELSE occurrence END AS occurrence FROM (SELECT *, max(CASE WHEN account = 'b' THEN occurrence + 1 END) OVER (PARTITION BY key) AS base FROM (SELECT p_partkey, p_size AS key, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS account, row_number() OVER (PARTITION BY p_partkey % 4, p_size ORDER BY p_partkey) - 1 AS occurrence FROM part))")
def q14_account_merge(spark, d):
    p = ledger.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("key"), (F.col("p_partkey") % 4).alias("m"))
    rows = p.select("id", "key", F.when(F.col("m") == 0, "a").when(F.col("m") == 1, "b").otherwise("c").alias("account"), (F.row_number().over(Window.partitionBy("m", "key").orderBy("id")) - 1).cast("long").alias("occurrence"))
    return accounts.moved(rows.withColumn("date", F.lit("2024-01-01").cast("date")), "a", "b").select("id", "account", "occurrence")


@query("SELECT CAST(page_id AS VARCHAR) AS path, turn = 1 AND page_id % 10 <> 0 AS created FROM (SELECT page_id, row_number() OVER (PARTITION BY html ORDER BY CAST(page_id AS VARCHAR)) AS turn, max(CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY html) AS known FROM pages) WHERE known = 0 UNION ALL SELECT CAST(page_id AS VARCHAR), FALSE FROM (SELECT page_id, max(CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY html) AS known FROM pages) WHERE known = 1")
def k1_stage(spark, d):
    files = ledger.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    none = spark.createDataFrame([], "path string, sha string, size int")
    _, staged = imports.stage(files.where("cast(path as bigint) % 10 = 0"), none)
    return imports.stage(files, staged)[0].select("path", "created")


# Findings: outliers of events and spikes of orders, with made-up confidence.
_FINDINGS = "SELECT 'rule' || event_id % 3 AS rule, event_id AS subject, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS impact, CAST(event_id % 101 AS DOUBLE) / 100 AS confidence, CASE WHEN event_id % 2 = 0 THEN 'savings' ELSE 'visibility' END AS kind, event_id % 7 = 0 AS llm, event_id % 11 = 0 AS exempt FROM events "
_EMITTED = f"SELECT *, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.55 THEN 'medium' ELSE 'low' END AS band, row_number() OVER (PARTITION BY rule ORDER BY abs(impact) DESC, subject) AS place FROM (SELECT *, CASE WHEN llm THEN least(confidence, 0.79) ELSE confidence END AS c FROM ({_FINDINGS})) WHERE c >= 0.35 AND (exempt OR abs(impact) >= 2500)"


def _findings(spark, d) -> DataFrame:
    return _sql(spark, d, _FINDINGS, "events")


@query(f"SELECT rule, subject, impact, band, CAST(place AS INTEGER) AS place FROM ({_EMITTED}) WHERE place <= 25")
def l3_emission(spark, d):
    return findings.emitted(_findings(spark, d))[0].select("rule", "subject", "impact", "band", "place")


@query(f"SELECT rule, count(*) - 25 AS suppressed, min(abs(impact)) FILTER (place <= 25) AS below_annual FROM ({_EMITTED}) GROUP BY rule HAVING count(*) > 25")
def l3_rollup(spark, d):
    return findings.emitted(_findings(spark, d))[1]


@query(f"SELECT rule, band, count(*) AS n, count(*) FILTER (subject % 4 <> 0) AS unreviewed FROM ({_EMITTED}) GROUP BY GROUPING SETS ((rule), (band), ())")
def a11_finding_counts(spark, d):
    f = findings.emitted(_findings(spark, d), budget=1 << 30)[0].withColumn("id", F.col("subject"))
    return findings.counts(f, f.where("id % 4 = 0").select("id"))


@query(f"SELECT CAST(sum(impact) FILTER (kind = 'savings') AS BIGINT) AS savings FROM ({_EMITTED})")
def a15_savings_headline(spark, d):
    return findings.headline(findings.emitted(_findings(spark, d), budget=1 << 30)[0])


@query(f"SELECT rule, CAST(rule_place AS INTEGER) AS rule_place, total, subject, CAST(row_number() OVER (PARTITION BY rule ORDER BY abs(impact) DESC, subject) AS INTEGER) AS place, impact FROM ({_EMITTED}) JOIN (SELECT rule, CAST(sum(impact) AS BIGINT) AS total, row_number() OVER (ORDER BY abs(sum(impact)) DESC, rule) AS rule_place FROM ({_EMITTED}) GROUP BY rule) USING (rule)")
def a16_finding_cards(spark, d):
    return findings.cards(findings.emitted(_findings(spark, d), budget=1 << 30)[0])


_STATES = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'snoozed' ELSE 'seen' END AS state, CASE WHEN event_id % 3 = 1 THEN DATE '2024-01-01' + CAST(event_id % 60 AS INT) END AS until, CASE WHEN event_id % 2 = 0 THEN 'h0' ELSE 'h1' END AS dismissed_hash, CASE WHEN event_id % 5 = 0 THEN 'old' END AS dismissed_config FROM events WHERE event_id % 2 = 0 OR event_id % 7 = 0"
_HIDDEN = "(coalesce(state = 'dismissed' AND dismissed_hash IS NOT DISTINCT FROM 'h0' AND (dismissed_config IS NULL OR dismissed_config = 'new'), FALSE) OR coalesce(state = 'snoozed' AND until > DATE '2024-02-01', FALSE))"


def _stored(spark, d):
    f = _findings(spark, d).withColumns({"id": F.col("subject"), "status": F.when(F.col("subject") % 13 == 0, "resolved").otherwise("active"), "evidence_hash": F.lit("h0"), "band": findings.band(F.col("confidence"))})
    return f, _sql(spark, d, _STATES.replace("IS NOT DISTINCT FROM", "<=>"), "events")


@query(f"SELECT id, rule, impact FROM (SELECT subject AS id, rule, impact FROM ({_FINDINGS}) f LEFT JOIN ({_STATES}) s ON s.id = f.subject WHERE subject % 13 <> 0 AND rule = 'rule1' AND abs(impact) >= 5000 AND subject IN (SELECT event_id FROM events WHERE event_type = 'purchase') AND NOT {_HIDDEN} ORDER BY rule, abs(impact) DESC, id LIMIT 50 OFFSET 10)")
def q4_finding_search(spark, d):
    f, states = _stored(spark, d)
    evidence = f.select(F.col("id").alias("finding"), F.col("id").alias("transaction"))
    page, _ = findings.search(f, states, evidence, _ledger(spark, d), F.lit("2024-02-01").cast("date"), F.lit("new"), rules=["rule1"], least=5000, accounts=["purchase"], offset=10)
    return page.select("id", "rule", "impact")


@query(f"SELECT subject AS id, {_HIDDEN} AS hidden FROM ({_FINDINGS}) f LEFT JOIN ({_STATES}) s ON s.id = f.subject")
def q5_hidden(spark, d):
    f, states = _stored(spark, d)
    return f.join(states, "id", "left").select("id", findings.hidden(F.lit("2024-02-01").cast("date"), F.lit("new")).alias("hidden"))


@query("SELECT 'k' || event_id AS natural_key, CASE WHEN event_id % 2 = 0 THEN 'active' WHEN event_id % 9 = 0 THEN 'suppressed' ELSE 'resolved' END AS status, CASE WHEN event_id % 3 = 0 THEN 'd0' ELSE 'd1' END AS first_detected, CASE WHEN event_id % 2 = 0 THEN 'r2' ELSE 'r1' END AS last_run FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def q6_apply_run(spark, d):
    f = _findings(spark, d).select(F.concat(F.lit("k"), F.col("subject").cast("string")).alias("natural_key"), F.col("subject").alias("n"), "rule", "subject", "impact", "confidence", "kind", F.lit("h").alias("evidence_hash"))
    old = f.where("n % 3 = 0").select(F.col("natural_key").alias("id"), "natural_key", "rule", "subject", "impact", "confidence", "kind", "evidence_hash", F.when(F.col("n") % 9 == 0, "suppressed").otherwise("active").alias("status"), F.lit("d0").alias("first_detected"), F.lit("r1").alias("last_run"))
    new = f.where("n % 2 = 0").withColumn("status", F.lit("active"))
    return findings.applied(old, new, "r2", F.lit("d1")).select("natural_key", "status", "first_detected", "last_run")


@query(f"SELECT subject, CASE WHEN rule = 'rule2' OR (rule = 'rule0' AND subject % 4 = 1) THEN 'suppressed' ELSE 'active' END AS status FROM ({_FINDINGS})")
def q7_standing_dismissals(spark, d):
    f = _findings(spark, d).withColumn("merchant", F.col("subject") % 4)
    standing = spark.createDataFrame([("rule", "rule2", None), ("merchant", "rule0", 1)], "scope string, rule string, merchant long")
    return findings.standing(f, standing).select("subject", "status")


@query("SELECT c_custkey AS series, c_acctbal AS amount, CASE WHEN c_custkey % 3 = 0 THEN 'mine' END AS user_status FROM customer WHERE c_custkey % 2 = 0")
def q10_replace_series(spark, d):
    c = ledger.table(spark, d, "customer").select(F.col("c_custkey").alias("series"), F.col("c_acctbal").alias("amount"))
    old = c.where("series % 3 = 0").withColumns({"amount": F.lit(0.0), "user_status": F.lit("mine")})
    return findings.upserted(old, c.where("series % 2 = 0"), "series", ["user_status"])[0]


@query("SELECT c_custkey AS series FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def u4_vanished_series(spark, d):
    c = ledger.table(spark, d, "customer").select(F.col("c_custkey").alias("series"))
    return findings.upserted(c.where("series % 3 = 0").withColumn("u", F.lit(1)), c.where("series % 2 = 0"), "series", ["u"])[1]


# Aliases: part names as descriptors.
_ALIASES = "SELECT upper(p_name) AS alias, 'm' || min(p_partkey) AS merchant, 'exact' AS match, 1.0 AS confidence, 'rule' AS source FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 UNION ALL SELECT upper(substr(p_name, 1, 7)), 'p' || min(p_partkey), 'prefix', 1.0, 'seed' FROM part WHERE p_partkey % 5 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT upper(p_type), 'f' || upper(p_type), 'fuzzy', 0.9, 'user' FROM part WHERE p_partkey % 2 = 0"
_TRI = "list_distinct([substr('  ' || trim({0}) || ' ', i, 3) FOR i IN range(1, length('  ' || trim({0}) || ' ') - 1)])"
_HITS = f"""WITH k AS (SELECT DISTINCT upper(p_name) AS key FROM part), a AS ({_ALIASES}),
h AS (SELECT key, a.*, 1.0 AS similarity FROM k JOIN a ON match = 'exact' AND key = alias UNION ALL SELECT key, a.*, 1.0 FROM k JOIN a ON match = 'prefix' AND starts_with(key, alias)
UNION ALL SELECT * FROM (SELECT key, a.*, CASE WHEN key = alias THEN 1.0 ELSE CAST(len(list_intersect({_TRI.format('key')}, {_TRI.format('alias')})) AS DOUBLE) / len(list_distinct(list_concat({_TRI.format('key')}, {_TRI.format('alias')}))) END AS similarity FROM k JOIN a ON match = 'fuzzy') WHERE similarity >= 0.72)
SELECT key, merchant, match, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list_position(['user', 'seed', 'rule', 'llm'], source), list_position(['exact', 'prefix', 'fuzzy'], match), similarity DESC, length(alias) DESC, confidence DESC, merchant) AS place FROM h) WHERE place = 1"""


def _aliases(spark, d) -> DataFrame:
    return _sql(spark, d, _ALIASES + " ", "part").withColumn("confidence", F.col("confidence").cast("double"))


@query(_HITS)
def n9_alias_resolution(spark, d):
    keys = ledger.table(spark, d, "part").select(F.upper("p_name").alias("key"))
    return aliases.resolved(keys, _aliases(spark, d)).select("key", "merchant", "match", "source")


# Names with one letter left out against whole names: a quadratic comparison in the SQL.
_KEYS, _NAMES = "upper(concat(substr(t, 1, CAST(p_partkey % 9 AS INT)), substr(t, CAST(p_partkey % 9 + 2 AS INT))))", "SELECT p_partkey, concat(p_name, ' ', p_brand) AS t FROM part "


@query(f"""WITH k AS (SELECT key, {_TRI.format('key')} AS a FROM (SELECT DISTINCT {_KEYS} AS key FROM ({_NAMES}))), n AS (SELECT alias, {_TRI.format('alias')} AS b FROM (SELECT DISTINCT upper(t) AS alias FROM ({_NAMES}))),
m AS (SELECT key, alias, len(list_intersect(a, b)) AS met, len(a) + len(b) AS every FROM k JOIN n ON len(a) <= 2 * len(b)) SELECT key, alias, CASE WHEN key = alias THEN 1.0 ELSE CAST(met AS DOUBLE) / (every - met) END AS similarity FROM m WHERE key = alias OR CAST(met AS DOUBLE) / (every - met) >= 0.72""")
def n9_fuzzy_join(spark, d):
    t = _sql(spark, d, _NAMES, "part")
    return aliases.alike(t.select(F.expr(_KEYS).alias("key")), t.select(F.upper("t").alias("alias")))


# Descriptors of parts, worked out anew from the latest raw text of each: three rows in about two hundred name theirs.
_RAWS = f"SELECT p_partkey AS id, concat(upper(p_name), ' ', p_partkey % 3) AS normalized, {statement_plans._DESCRIPTOR} AS raw, CAST(p_partkey % 90 AS INT) AS day FROM part "


@query(f"""WITH rows_ AS ({_RAWS}), hit AS (SELECT DISTINCT normalized FROM rows_ WHERE id % 199 < 3 OR normalized IN (SELECT concat(upper(p_name), ' 1') FROM part WHERE p_partkey % 400 = 0)),
s AS (SELECT DISTINCT ON (normalized) normalized, merchant AS key FROM rows_ JOIN hit USING (normalized) JOIN ({statement_plans._stages_sql()}) st ON st.p_partkey = rows_.id ORDER BY normalized, day DESC, id),
now AS ({_HITS.replace('SELECT DISTINCT upper(p_name) AS key FROM part', "SELECT DISTINCT key FROM s WHERE key <> ''")})
SELECT id, coalesce(now.merchant, 'old') AS merchant FROM rows_ LEFT JOIN s USING (normalized) LEFT JOIN now USING (key)""")
def n16_renormalize_ids(spark, d):
    rows = _sql(spark, d, _RAWS, "part").withColumns({"date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")), "merchant": F.lit("old")})
    keys = ledger.table(spark, d, "part").where("p_partkey % 400 = 0").select(F.concat(F.upper("p_name"), F.lit(" 1")).alias("key"))
    return aliases.renormalized(rows, keys, _aliases(spark, d), rows.where("id % 199 < 3").select("id")).select("id", "merchant")


@query("SELECT alias, match, CASE WHEN alias % 3 = 0 AND alias % 6 <> 0 THEN 'seed' WHEN alias % 2 = 0 THEN 'user' ELSE 'llm' END AS source FROM (SELECT p_partkey AS alias, 'exact' AS match FROM part)")
def n14_alias_precedence(spark, d):
    p = ledger.table(spark, d, "part").select(F.col("p_partkey").alias("alias"), F.lit("exact").alias("match"), F.lit("m").alias("merchant"), F.lit(1.0).alias("confidence"))
    old = p.withColumn("source", F.when(F.col("alias") % 2 == 0, "user").otherwise("llm"))
    new = p.where("alias % 3 = 0").withColumn("source", F.lit("seed")).unionByName(p.where("alias % 5 = 0").withColumn("source", F.lit("llm")))
    return aliases.upserted(old, new).select("alias", "match", "source")


@query("SELECT id, CASE WHEN normalized = 'MARKET' THEN 'm1' ELSE CAST(merchant AS VARCHAR) END AS merchant FROM (" + _LEDGER + ")")
def n16_renormalize(spark, d):
    # A descriptor is worked out from its raw text, so here that is the descriptor itself.
    rows = _ledger(spark, d).withColumns({"merchant": F.col("merchant").cast("string"), "raw": F.col("normalized")})
    known = spark.createDataFrame([("MARKET", "m1", "exact", 1.0, "user")], aliases.ALIASES)
    return aliases.renormalized(rows, rows.select(F.col("normalized").alias("key")).distinct(), known).select("id", "merchant")


@query("SELECT normalized AS alias, 'm9' AS merchant, 'exact' AS match, 'user' AS source FROM (" + _LEDGER + ") GROUP BY 1")
def n15_user_aliases(spark, d):
    return aliases.user_aliases(_ledger(spark, d).select(F.col("normalized").alias("key")), "m9").select("alias", "merchant", "match", "source")


# Searches.
_WHERE = "account IN ('purchase', 'view', 'signup') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND cents BETWEEN -30000 AND 30000 AND NOT transfer AND NOT excluded AND NOT pending AND (contains(lower(raw), 'er') OR contains(lower(normalized), 'er'))"
_Q = search.Query(accounts=["purchase", "view", "signup"], start="2024-01-05", end="2024-01-20", least=-30000, most=30000, pending=False, text="eR", order="amount_desc", limit=100, offset=20)


@query(f"SELECT id, account, date, cents FROM ({_LEDGER}) WHERE {_WHERE} ORDER BY cents DESC, id LIMIT 100 OFFSET 20")
def q1_search_page(spark, d):
    return search.page(_ledger(spark, d), _Q)[0].select("id", "account", "date", "cents")


@query(f"SELECT count(*) AS total FROM ({_LEDGER}) WHERE {_WHERE}")
def l2_search_total(spark, d):
    return search.page(_ledger(spark, d), _Q)[1]


@query(f"SELECT normalized, count(*) AS n FROM ({_LEDGER}) WHERE {_WHERE} GROUP BY normalized")
def q2_matching_descriptors(spark, d):
    return search.descriptors(_ledger(spark, d), _Q)


@query(f"SELECT id, CASE WHEN {_WHERE} THEN 'mine' ELSE category END AS category FROM ({_LEDGER})")
def q2_bulk_patch(spark, d):
    return search.patched(_ledger(spark, d), _Q, {"category": "mine"}).select("id", "category")


@query(f"""SELECT id, strftime(date, '%Y-%m-%d') || ',' || id || ',' || '"' || replace(account || ', "' || raw, '"', '""') || '"' AS line FROM ({_LEDGER})""")
def k5_csv_lines(spark, d):
    rows = _ledger(spark, d).select("date", "id", F.concat("account", F.lit(', "'), "raw").alias("text"))
    return search.csv_lines(rows)


@query(f"SELECT category, count(*) AS n, CAST(-sum(cents) AS BIGINT) AS cents FROM ({_LEDGER}) WHERE cents < 0 AND NOT transfer AND NOT excluded GROUP BY category")
def q23_spend_by_category(spark, d):
    return search.spend_by_category(_ledger(spark, d))


@query(f"SELECT merchant, count(*) AS n, CAST(-sum(cents) AS BIGINT) AS cents FROM ({_LEDGER}) WHERE cents < 0 AND NOT transfer AND NOT excluded GROUP BY merchant ORDER BY cents DESC, merchant LIMIT 10")
def q23_top_merchants(spark, d):
    return search.top_merchants(_ledger(spark, d))


@query("WITH g AS (SELECT o_orderpriority AS category, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL) SELECT *, cents - lag(cents) OVER (PARTITION BY category ORDER BY month) AS change FROM g")
def q24_movers(spark, d):
    rows = ledger.orders(spark, d).withColumns({"transfer": F.lit(False), "excluded": F.lit(False)})
    return search.movers(rows)


# Coverage: an import for each customer's orders.
_IMPORTS = "SELECT o_custkey % 6 AS account, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS \"end\", 'committed' AS status FROM orders GROUP BY o_custkey % 6, o_custkey % 50"
_COVERED = f"SELECT DISTINCT account, CAST(unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT account, CAST(CASE WHEN start = date_trunc('month', start) THEN start ELSE date_trunc('month', start) + INTERVAL 1 MONTH END AS DATE) AS f, CAST(CASE WHEN \"end\" = last_day(\"end\") THEN date_trunc('month', \"end\") ELSE date_trunc('month', \"end\") - INTERVAL 1 MONTH END AS DATE) AS l FROM ({_IMPORTS})) WHERE f <= l"


def _imports(spark, d) -> DataFrame:
    return _sql(spark, d, _IMPORTS.replace('"end"', "end"), "orders")


@query(_COVERED)
def r14_covered_months(spark, d):
    return coverage.covered_months(_imports(spark, d))


@query(f"SELECT month FROM ({_COVERED}) GROUP BY month HAVING count(*) = 6")
def r14_fully_covered(spark, d):
    i = _imports(spark, d)
    return coverage.fully_covered(i, i.select("account").distinct())


@query(f"""WITH t AS (SELECT account, CAST(unnest(generate_series(date_trunc('month', start), date_trunc('month', "end"), INTERVAL 1 MONTH)) AS DATE) AS month FROM ({_IMPORTS}) UNION SELECT o_custkey % 6, CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders),
s AS (SELECT account, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM t GROUP BY account)
SELECT s.account, s.month, CASE WHEN c.month IS NOT NULL THEN 'covered' WHEN t.month IS NOT NULL THEN 'partial' ELSE 'missing' END AS state FROM s LEFT JOIN t USING (account, month) LEFT JOIN ({_COVERED}) c USING (account, month)""")
def r15_coverage_bar(spark, d):
    rows = ledger.table(spark, d, "orders").select((F.col("o_custkey") % 6).alias("account"), F.to_date("o_orderdate").alias("date"))
    return coverage.bar(_imports(spark, d), rows)


# State transitions: the tables after a change.
_LATER = "coalesce(state = 'dismissed' AND dismissed_hash IS DISTINCT FROM 'h0', FALSE) AS evidence_changed, coalesce(state = 'dismissed' AND dismissed_config IS NOT NULL AND dismissed_config IS DISTINCT FROM 'new', FALSE) AS config_changed"


@query(f"SELECT subject AS id, {_LATER} FROM ({_FINDINGS}) f LEFT JOIN ({_STATES}) s ON s.id = f.subject")
def q8_changed_since_dismissal(spark, d):
    f, states = _stored(spark, d)
    evidence, config = findings.changed_since(F.lit("new"))
    return f.join(states, "id", "left").select("id", evidence.alias("evidence_changed"), config.alias("config_changed"))


@query(f"SELECT id, state, until FROM ({_STATES}) WHERE id % 5 <> 0 UNION ALL SELECT event_id, 'snoozed', DATE '2024-02-01' + 90 FROM events WHERE event_id % 5 = 0")
def q9_finding_states(spark, d):
    f, states = _stored(spark, d)
    none = {c: F.lit(None).cast(states.schema[c].dataType) for c in ("until", "dismissed_hash", "dismissed_config")}
    changes = f.where("id % 5 = 0").select("id", F.lit("snoozed").alias("state")).withColumns(none)
    return findings.with_state(states, changes, F.lit("2024-02-01").cast("date")).select("id", "state", "until")


@query(f"WITH one AS (SELECT credit, min(debit) AS debit FROM ({_PAIRS}) WHERE credit % 3 = 0 GROUP BY credit HAVING count(DISTINCT debit) = 1), " + r"r AS (SELECT DISTINCT CASE WHEN length(regexp_replace(a.raw, '( \S*\d\S*)+$', '')) < 4 THEN a.raw ELSE regexp_replace(a.raw, '( \S*\d\S*)+$', '') END AS pattern, a.account AS debit_account, b.account AS credit_account FROM one JOIN (" + _LEDGER + ") a ON a.id = debit JOIN (" + _LEDGER + ") b ON b.id = credit) SELECT * FROM r WHERE NOT (pattern = 'XFER' AND debit_account = 'purchase' AND credit_account = 'view') UNION ALL SELECT 'XFER', 'purchase', 'view'")
def q12_learned_rules(spark, d):
    rows = _ledger(spark, d)
    links = transfers.candidates(rows).select("debit", "credit").withColumn("state", F.lit("proposed"))
    known = spark.createDataFrame([("r1", "XFER", "purchase", "view")], "rule string, pattern string, debit_account string, credit_account string")
    chosen = rows.where("id % 3 = 0").select(F.col("id").alias("credit"))
    return transfers.confirmed(links, rows, known, chosen)[1].select("pattern", "debit_account", "credit_account")


@query(f"SELECT debit, credit, CASE WHEN credit % 3 = 0 THEN 'confirmed' ELSE 'proposed' END AS state FROM ({_PAIRS})")
def q12_confirmed_links(spark, d):
    rows = _ledger(spark, d)
    links = transfers.candidates(rows).select("debit", "credit").withColumn("state", F.lit("proposed"))
    none = spark.createDataFrame([], "rule string, pattern string, debit_account string, credit_account string")
    chosen = rows.where("id % 3 = 0").select(F.col("id").alias("credit"))
    return transfers.confirmed(links, rows, none, chosen)[0].select("debit", "credit", "state")


@query("SELECT name, CASE WHEN bool_or(p_partkey % 3 = 0) THEN 'm' || name ELSE substr(sha256(name), 1, 16) END AS merchant FROM (SELECT upper(p_name) AS name, p_partkey FROM part) GROUP BY name")
def n13_provisional_merchants(spark, d):
    rows = ledger.table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("provisional"))
    known = rows.where("p_partkey % 3 = 0").select(F.concat(F.lit("m"), "provisional").alias("merchant"), F.col("provisional").alias("name")).distinct()
    return aliases.provisional(rows, known, spark.createDataFrame([], aliases.ALIASES))[0]


@query("SELECT 'transaction' AS entity, CAST(p_partkey AS VARCHAR) AS entity_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 28 >= 14")
def k7_tombstones_since(spark, d):
    rows = ledger.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    sources = rows.where("id % 3 = 0").selectExpr("id as transaction", "'x' as import", "1 as row").unionByName(rows.where("id % 5 = 0").selectExpr("id as transaction", "'y' as import", "2 as row"))
    gone = imports.without_import(rows, sources, "x")[2]
    dated = gone.withColumn("deleted_at", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(cast(entity_id as bigint) % 28 as int))"))
    return store.tombstones_since(dated, F.lit("2024-01-15").cast("timestamp")).select("entity", "entity_id")


@query("SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN '99' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT 'r' || r_regionkey, '1' FROM region")
def k8_settings(spark, d):
    n, r = ledger.table(spark, d, "nation"), ledger.table(spark, d, "region")
    old = n.selectExpr("concat('n', n_nationkey) as key", "cast(n_regionkey as string) as value")
    new = n.where("n_nationkey % 4 = 0").selectExpr("concat('n', n_nationkey) as key", "'99' as value").unionByName(r.selectExpr("concat('r', r_regionkey) as key", "'1' as value"))
    return store.settings_after(old, new)


@query("SELECT 'f' || p_partkey % 4 AS path, p_partkey AS row_index, CASE WHEN p_partkey % 4 = 1 THEN 'new' ELSE 'old' END AS raw FROM part WHERE p_partkey % 4 <> 1 OR p_partkey % 8 = 1")
def k2_restaged_rows(spark, d):
    rows = ledger.table(spark, d, "part").selectExpr("concat('f', p_partkey % 4) as path", "p_partkey as row_index", "'old' as raw")
    imported = spark.createDataFrame([("f1", "parsed"), ("f2", "committed")], "path string, status string")
    for path in ("f1", "f2"):  # the second is refused
        new = rows.where((F.col("path") == path) & (F.col("row_index") % 8 < 4)).withColumn("raw", F.lit("new"))
        rows = imports.restage(rows, imported, path, new)[0]
    return rows


# Rows of an import, some of which could not be read.
_READ = "SELECT o_orderpriority AS path, o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 13 = 0 THEN 'date' END AS error, o_orderkey % 9 AS cents, o_orderstatus = 'P' AS pending, o_orderkey % 2 = 0 AS zero_allowed, CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 2 END AS key_version FROM orders "


@query(f"SELECT path, count(*) FILTER (error IS NOT NULL) AS unparsed, count(*) FILTER (error IS NULL AND date NOT BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') AS out_of_period, count(*) FILTER (pending) AS pending, count(*) FILTER (cents = 0) AS zero, count(*) FILTER (error IS NULL) AS parsed FROM ({_READ}) GROUP BY path")
def q18_review_strip(spark, d):
    day = lambda x: F.lit(x).cast("date")
    return coverage.review_strip(_sql(spark, d, _READ, "orders"), day("1994-01-01"), day("1996-12-31"))


@query(f"SELECT 'zero_amount' AS reason, count(*) AS n FROM ({_READ}) WHERE cents = 0 AND NOT pending AND NOT zero_allowed UNION ALL SELECT 'mixed_key_versions', 2")
def q20_commit_refusals(spark, d):
    return imports.refusals(_sql(spark, d, _READ, "orders"))


@query(f'SELECT path, min(date) AS start, max(date) AS "end" FROM ({_READ}) WHERE error IS NULL GROUP BY path')
def p10_period(spark, d):
    return statements.period(_sql(spark, d, _READ, "orders"))


@query("SELECT path FROM (SELECT c_nationkey AS path, CAST(round(c_acctbal * 100) AS BIGINT) - 500000 AS b FROM customer) WHERE b <> 0 GROUP BY path HAVING count(*) >= 3 AND count(*) FILTER (b < 0) * 2 > count(*)")
def p14_sign_check(spark, d):
    c = ledger.table(spark, d, "customer")
    return statements.sign_check(c.select(F.col("c_nationkey").alias("path"), (F.round(F.col("c_acctbal") * 100).cast("long") - 500000).alias("balance_cents")))


@query(f"SELECT 'savings' AS measure, CAST(sum(impact) FILTER (kind = 'savings') AS VARCHAR) AS value FROM ({_EMITTED}) UNION ALL SELECT 'findings', CAST(count(*) AS VARCHAR) FROM ({_EMITTED}) UNION ALL SELECT 'run', CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus <> 'P') AND o_orderstatus <> 'P'")
def q19_findings_summary(spark, d):
    f = findings.emitted(_findings(spark, d), budget=1 << 30)[0]
    runs = ledger.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("finished"))
    return findings.summary(f, runs)


def _snapshot(spark, d) -> run.Snapshot:
    """Customers' charges and orders' fees as one ledger; orders are at merchants of their own."""
    kinds = {"normalized": "string", "category": "string", "merchant": "string", "account": "string"}
    cast = lambda df: df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    more = {"transfer": F.lit(False), "refund_pair": F.lit(None).cast("string")}
    charges = cast(_charges(spark, d).withColumns(more).withColumn("id", F.concat(F.lit("c"), F.col("id").cast("string"))))
    other = cast(_sql(spark, d, _FEES + " ", "orders").withColumns(more).withColumns({"id": F.concat(F.lit("o"), F.col("id").cast("string")), "merchant": F.concat(F.lit("o"), F.col("merchant").cast("string"))}))
    rows = charges.select(*run.LEDGER).unionByName(other.select(*run.LEDGER))
    ends = _covered(spark, d).select("account", F.lit("2023-01-01").cast("date").alias("start"), F.col("coverage_end").alias("end"), F.lit("committed").alias("status"))
    kinds = F.when(F.col("category") == "bank", "fee").otherwise("spend")
    categories = rows.select("category").distinct().select("category", kinds.alias("kind"), F.lit(None).cast("string").alias("overlap_group"))
    return run.snapshot(rows, _merchants(spark, d), ends.select("account"), categories, ends, refuse=None)


@query(None)
def r16_analysis_run(spark, d):
    """All rules over one snapshot, in one schema, with the emission policy."""
    return run.analyze(_snapshot(spark, d))[0].select("rule", "subject_type", "subject", "impact", "confidence", "kind", "band", "place")


@query(None)
def u5_findings_by_rule(spark, d):
    """The union of all rules' findings before the policy."""
    return run.union(run.findings_by_rule(_snapshot(spark, d)))


# Trends: orders by their customer's nation; imports of each priority, one a year, leave gaps; some nations are mostly one series.
_SHOPPING = "SELECT o_orderkey AS id, c_nationkey AS category, o_orderpriority AS account, CAST(o_orderdate AS DATE) AS date, -CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus = 'P' AS pending, CASE WHEN c_nationkey % 5 = 0 AND o_orderpriority <> '5-LOW' THEN 'n' || c_nationkey WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey END AS series FROM orders JOIN customer ON o_custkey = c_custkey"
_GAPPY = f"""r AS ({_SHOPPING}), spans AS (SELECT account, min(date) AS a, max(date) AS b FROM r GROUP BY account, year(date)),
ends AS (SELECT account, CAST(CASE WHEN a = date_trunc('month', a) THEN a ELSE date_trunc('month', a) + INTERVAL 1 MONTH END AS DATE) AS f, CAST(CASE WHEN b = last_day(b) THEN date_trunc('month', b) ELSE date_trunc('month', b) - INTERVAL 1 MONTH END AS DATE) AS l FROM spans),
each AS (SELECT DISTINCT account, CAST(unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends WHERE f <= l),
months AS (SELECT month FROM each GROUP BY month HAVING count(*) = (SELECT count(DISTINCT account) FROM r)),
own AS (SELECT category, max(own) AS own FROM (SELECT category, series, sum(-cents) AS own FROM r WHERE series IS NOT NULL AND NOT pending GROUP BY ALL) GROUP BY category),
x AS (SELECT *, -cents AS x FROM r WHERE NOT pending AND cents < 0),
gone AS (SELECT category FROM own JOIN (SELECT category, sum(x) AS whole FROM x GROUP BY category) USING (category) WHERE own / whole > 0.8),
k AS (SELECT DISTINCT category FROM x WHERE category % 7 <> 3 AND category NOT IN (SELECT category FROM gone)),
m AS (SELECT k.category, months.month, CAST(coalesce(sum(x), 0) AS BIGINT) AS total FROM k CROSS JOIN months LEFT JOIN x ON x.category = k.category AND date_trunc('month', x.date) = months.month GROUP BY ALL),
w AS (SELECT *, avg(total) OVER v AS before, min(total) OVER v AS low, count(*) OVER v AS n FROM m WINDOW v AS (PARTITION BY category ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, row_number() OVER (PARTITION BY category, month(month) ORDER BY month) AS turn FROM w WHERE n = 3 AND low > 0 AND total - before > 7500 AND total - before > 0.4 * before),
dl AS (SELECT *, total - lag(total) OVER (PARTITION BY category ORDER BY month) AS delta FROM m),
u AS (SELECT category, mad(delta) AS mad FROM dl WHERE delta IS NOT NULL GROUP BY category),
i AS (SELECT *, sum(CASE WHEN delta > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY category ORDER BY month) AS island FROM dl),
g AS (SELECT category, max(month) AS month, min(total) AS low, max(total) - min(total) AS rise FROM i GROUP BY category, island HAVING count(*) >= 4),
t AS (SELECT 'spike' AS kind, category, month, CAST(floor(total - before + 0.5) AS BIGINT) AS impact FROM s WHERE turn = 1
UNION ALL SELECT 'climb', category, month, CAST(rise * 12 AS BIGINT) FROM g JOIN u USING (category) WHERE low > 0 AND rise > 5000 AND rise > 0.25 * low AND rise > 2 * mad),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY abs(impact) DESC, category, month) AS INTEGER) AS place FROM t)"""


def _shopping(spark, d) -> tuple[DataFrame, DataFrame]:
    """(ledger, charges of series)."""
    rows = _sql(spark, d, _SHOPPING, "orders", "customer")
    return rows.drop("series"), rows.where("series is not null and not pending").select("series", "id")


def _trends(spark, d, top: int | None) -> DataFrame:
    rows, members = _shopping(spark, d)
    accounts = rows.select("account").distinct()
    spans = rows.groupBy("account", F.year("date")).agg(F.min("date").alias("start"), F.max("date").alias("end")).withColumn("status", F.lit("committed"))
    categories = ledger.table(spark, d, "nation").select(F.col("n_nationkey").alias("category"), F.when(F.col("n_nationkey") % 7 == 3, "transfer").otherwise("spend").alias("kind"))
    return trends.trends(rows, coverage.fully_covered(spans, accounts), categories, members, top)


@query(f"WITH {_GAPPY} SELECT kind, category, month, impact, place FROM p")
def r12_trends(spark, d):
    """Every spike and climb over covered months, without categories that are one series."""
    return _trends(spark, d, None)


@query(f"WITH {_GAPPY} SELECT kind, category, month, impact, place FROM p WHERE place <= 5")
def l4_top_trends(spark, d):
    return _trends(spark, d, trends.TOP)


@query(f"WITH {_GAPPY} SELECT category FROM gone")
def r11_dominated(spark, d):
    return trends.dominated(*_shopping(spark, d))


@query(f"SELECT year, count(*) AS n, CAST(sum(x) AS BIGINT) AS impact FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY x DESC, id) AS place FROM (SELECT id, -cents AS x, year(date) AS year, count(*) OVER (PARTITION BY year(date)) AS n, quantile_cont(-cents, 0.99) OVER (PARTITION BY year(date)) AS p99 FROM ({_SHOPPING}) WHERE series IS NULL AND NOT pending AND cents < 0) WHERE n >= 50 AND x >= 20000 AND x >= p99) WHERE place <= 10 GROUP BY year")
def r10_windows(spark, d):
    """One finding a year: its largest rows beside the series."""
    return rules.windows(*_shopping(spark, d))
