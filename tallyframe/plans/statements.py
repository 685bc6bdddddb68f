"""Registered queries on statement files and descriptors, and their SQL.

The driver's tables hold no statements, so files and descriptors are written from their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, merchants
from ..operators import matching
from ..sources import ledger, statements

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HEADS = ["SQ *", "POS DEBIT TST* ", "DEBIT CARD PURCHASE", "PAYPAL *", "Zelle to ", ""]
TAILS = [" #0042 WA", " STORE 12 SEATTLE WA US", " REF 9A77 01/15", ".COM 866-579-7172 CA", " 57442100 PORTLAND OR", " XX1234", " AB12CD34EF"]


def _picked(values: list[str]) -> str:
    return " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))


_DESCRIPTOR = f"concat(CASE p_partkey % {len(HEADS)} {_picked(HEADS)} END, p_name, CASE p_partkey % {len(TAILS)} {_picked(TAILS)} END)"


def _descriptors(spark, d) -> DataFrame:
    return ledger.table(spark, d, "part").select("p_partkey", F.expr(_DESCRIPTOR).alias("raw"))


def _sub(x: str, pattern: str, put: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{put}', 'g')"


def _single(x: str) -> str:
    return f"trim({_sub(x, chr(92) + 's+')})"


def _stages_sql() -> str:
    """The six stages in the regular expressions of DuckDB, which look neither ahead nor behind."""
    listed = "|".join(p.replace("*", r"\*").replace(".", r"\.") for p in merchants.PREFIXES)
    prefix = "a"
    for _ in range(4):
        prefix = rf"regexp_replace({prefix}, '^(?:{listed})\s*(\S)', '\1')"
    stores = "b"
    for pattern, put in merchants.STORES:
        stores = _sub(stores, pattern, put)
    contacts = "c"
    for pattern, put in merchants.CONTACTS:
        contacts = _sub(contacts, pattern, put.replace("$", "\\"))
    places = rf"regexp_replace({_single(contacts)}, '(\S)(?: (?:{'|'.join(merchants.STATES + merchants.COUNTRIES)}))+$', '\1')"
    tail = r"regexp_extract(f, '\s+([A-Z0-9]{8,})\s*$', 1)"
    cut = rf"CASE WHEN regexp_matches({tail}, '\d') AND regexp_matches({tail}, '[A-Z]') THEN regexp_replace(f, '\s+[A-Z0-9]{{8,}}\s*$', ' ') ELSE f END"
    tidy = "h"
    for pattern, put in merchants.TIDY:
        tidy = _sub(tidy, pattern.replace("'", "''"), put)
    return rf"""WITH r AS (SELECT p_partkey, {_single(f'upper({_DESCRIPTOR})')} AS a FROM part), s AS (SELECT p_partkey, {prefix} AS b FROM r),
t AS (SELECT p_partkey, {_single(stores)} AS c FROM s), u AS (SELECT p_partkey, {places} AS e FROM t),
v AS (SELECT p_partkey, {_sub(_sub('e', r'\b(?:REF|TRACE|AUTH|CONF|INV|TRAN|ID)\b\s*#?\s*[A-Z0-9-]*\d[A-Z0-9-]*'), r'\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b')} AS f FROM u),
w AS (SELECT p_partkey, {_single(_sub(cut, merchants.REFERENCES[3][0]))} AS h FROM v) SELECT p_partkey, {_single(tidy)} AS merchant FROM w"""


@query(_stages_sql())
def n7_merchant_stages(spark, d):
    return _descriptors(spark, d).select("p_partkey", merchants.stages(F.col("raw")).alias("merchant"))


@query(f"SELECT p_partkey, regexp_matches(upper({_DESCRIPTOR}), '^(ZELLE|VENMO|CASH APP|SQUARE CASH|CHECK #|CHECK#|PAYPAL \\*|PP\\*)') AS person FROM part")
def n12_person(spark, d):
    return _descriptors(spark, d).select("p_partkey", merchants.to_person(F.col("raw")).alias("person"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS short, CAST(o_orderdate AS DATE) AS long FROM orders")
def p4_date_parse(spark, d):
    o = ledger.table(spark, d, "orders")
    short = dates.parse(F.date_format("o_orderdate", "M/d/yyyy"), "M/D/YYYY")
    long = dates.parse(F.upper(F.date_format("o_orderdate", "MMM dd, yyyy")), "MMM DD, YYYY")
    return o.select("o_orderkey", short.alias("short"), long.alias("long"))


PROFILE = {
    "date_format": "MM/DD/YYYY",
    "columns": {"transaction_date": "Date", "description": "Description", "amount": "Amount", "balance": "Running Balance", "status": "Status"},
    "pending": ["o"],
}


def _statements(spark, d) -> DataFrame:
    """A CSV file for each order: its lines with a running balance, off by a cent in line 5."""
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("date"), F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(', ""x"" '), F.col("l_partkey").cast("string"), F.lit('"')).alias("text"),
        c.alias("cents"), F.col("l_linestatus").alias("status"),
    )
    shown = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))
    before = lambda k: F.aggregate(F.filter("lines", lambda y: y["n"] <= k), F.lit(0).cast("long"), lambda s, y: s + y["cents"])
    rows = F.transform("lines", lambda x: F.concat_ws(",", x["date"], x["text"], shown(x["cents"]), F.when((F.col("l_orderkey") + x["n"]) % 7 == 0, "").otherwise(shown(before(x["n"]) + F.when(x["n"] == 5, 1).otherwise(0))), x["status"]))
    files = ledger.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    top = F.lit("Date,Description,Amount,Running Balance,Status")
    return files.select(F.col("l_orderkey").cast("string").alias("path"), F.concat_ws("\r\n", top, F.array_join(rows, "\r\n")).cast("binary").alias("content"))


def _records(spark, d) -> DataFrame:
    """Split once: the header and the rows below it are both looked for in the kept records."""
    return statements.records(_statements(spark, d), ",").persist()


_LINES = "SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, strftime(l_shipdate, '%m/%d/%Y'), l_returnflag || ', \"x\" ' || l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS row_index, CAST(l_shipdate AS DATE) AS date, l_returnflag || ', \"x\" ' || l_partkey AS description, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linestatus = 'O' AS pending, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END END AS balance_cents FROM lineitem"


@query(f"SELECT path, CAST(row_index AS INTEGER) AS row_index, CAST(row_index + 2 AS INTEGER) AS line, date, description, cents, CAST(balance_cents AS BIGINT) AS balance_cents, pending, CAST(NULL AS VARCHAR) AS error FROM ({_LINES})")
def s13_statement_rows(spark, d):
    return statements.ledger_rows(_records(spark, d), PROFILE)


@query(f"""WITH r AS (SELECT *, balance_cents - lag(balance_cents) OVER w <> cents AS up, balance_cents - lead(balance_cents) OVER w <> cents AS down FROM ({_LINES}) WINDOW w AS (PARTITION BY path ORDER BY row_index)),
g AS (SELECT path, count(balance_cents) AS n, count(up) AS checked, CAST(sum(CAST(up AS INT)) AS BIGINT) AS up, CAST(sum(CAST(down AS INT)) AS BIGINT) AS down FROM r GROUP BY path)
SELECT path, CASE WHEN n < 2 THEN 'unavailable' WHEN checked > 0 AND least(up, down) = 0 THEN 'reconciled' ELSE 'mismatch' END AS status, CASE WHEN n >= 2 THEN CASE WHEN coalesce(up <= down, TRUE) THEN 'ascending' ELSE 'descending' END END AS direction, CASE WHEN n >= 2 THEN checked END AS checked, CASE WHEN n >= 2 THEN coalesce(least(up, down), 0) END AS failures FROM g""")
def p13_balance_check(spark, d):
    return statements.balance_check_in_order(statements.read(_statements(spark, d), ",", PROFILE))


_E = "SELECT event_id AS id, event_type AS account, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) * (CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) AS cents, user_id AS merchant FROM events"


@query(f"SELECT b.id AS incoming, a.id AS existing, b.cents - a.cents AS off FROM ({_E}) a JOIN ({_E}) b ON a.account = b.account AND a.merchant = b.merchant AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(date_diff('day', a.date, b.date)) <= 3 AND (a.date <> b.date OR a.cents <> b.cents) AND (abs(b.cents - a.cents) <= 200 OR abs(b.cents - a.cents) * 100 <= 3 * abs(a.cents))")
def j12_near_pairs(spark, d):
    e = ledger.events(spark, d).withColumn("key", F.col("merchant"))
    return matching.near_duplicates(e.where("id % 2 = 0"), e.where("id % 2 = 1")).select("incoming", "existing", "off")


@query(f"SELECT a.id AS debit, b.id AS credit, date_diff('day', a.date, b.date) AS gap FROM ({_E}) a JOIN ({_E}) b ON a.merchant % 50 = b.merchant % 50 AND a.cents < 0 AND b.cents = -a.cents AND date_diff('day', a.date, b.date) BETWEEN 0 AND 90")
def j14_refund_pairs(spark, d):
    e = ledger.events(spark, d).withColumns({"merchant": F.col("merchant") % 50, "account": F.lit("all")})
    return matching.refund_candidates(e)


@query(f"SELECT month FROM (SELECT account, date_trunc('month', date) AS month FROM ({_E}) GROUP BY ALL) GROUP BY month HAVING count(*) = (SELECT count(DISTINCT account) FROM ({_E}))".replace("SELECT month FROM", "SELECT CAST(month AS DATE) AS month FROM"))
def u2_months_of_all_accounts(spark, d):
    return matching.common_months(ledger.events(spark, d))
