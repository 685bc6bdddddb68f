"""The registered ledger queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import matching, rules
from ..sources import ledger
from . import analysis, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = statements.QUERIES | analysis.QUERIES
ORACLE_SQL: dict[str, str] = statements.ORACLE_SQL | analysis.ORACLE_SQL

EVENTS = "SELECT event_id AS id, event_type AS account, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) * (CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) AS cents, user_id AS merchant FROM events"
ORDERS = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, -CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey AS merchant, o_orderpriority AS category, o_orderstatus = 'P' AS pending FROM orders"
SPEND_E = f"SELECT *, -cents AS x FROM ({EVENTS}) WHERE cents < 0"
SPEND_O = f"SELECT *, -cents AS x FROM ({ORDERS}) WHERE cents < 0 AND NOT pending"
COLLAPSE = "trim(left(trim(regexp_replace(regexp_replace(strip_accents(upper(replace({0}, 'ß', 'SS'))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 40))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The shown amounts of all orders, written in five ways, and in two that are no amounts.
@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN -c WHEN 3 THEN c // 100 * 100 WHEN 4 THEN -c END AS cents FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)")
def p1_money_parse(spark, d):
    o = ledger.orders(spark, d).withColumns({"k": F.col("id") % 7, "t": money.show(-F.col("cents"))})
    bare = F.regexp_replace("t", r"[$,]", "")
    written = F.when(F.col("k") == 0, F.col("t")).when(F.col("k") == 1, F.concat(F.lit("("), "t", F.lit(")"))).when(F.col("k") == 2, F.concat(F.lit(" usd "), bare, F.lit("-\u00a0")))
    written = written.when(F.col("k") == 3, F.regexp_replace(bare, r"\.\d\d$", "")).when(F.col("k") == 4, F.concat(F.lit("-"), "t")).when(F.col("k") == 5, F.concat(F.lit("--"), "t")).otherwise(F.concat("t", F.lit("5")))
    return o.select(F.col("id").alias("o_orderkey"), money.parse(written).alias("cents"))


@query("SELECT o_orderkey, CASE WHEN c < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS shown FROM (SELECT o_orderkey, -CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)")
def p2_money_format(spark, d):
    return ledger.orders(spark, d).select(F.col("id").alias("o_orderkey"), money.show(F.col("cents")).alias("shown"))


@query(f"SELECT doc_id, {COLLAPSE.format('text')} AS key FROM documents")
def p15_collapse(spark, d):
    return ledger.table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("key"))


@query(f"SELECT event_id, sha256(event_type || '|' || strftime(ts, '%Y-%m-%d') || '|' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '|' || {COLLAPSE.format('props')}) AS key FROM events")
def p16_dedupe_key(spark, d):
    e = ledger.table(spark, d, "events")
    return e.select("event_id", text.dedupe_key(F.col("event_type"), F.to_date("ts"), money.cents(F.col("value")), F.col("props")).alias("key"))


_TRI = "list_distinct([substr('  ' || trim({0}) || ' ', i, 3) FOR i IN range(1, length('  ' || trim({0}) || ' ') - 1)])"


@query(f"SELECT p_partkey, CASE WHEN p_name = p_type THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS sim FROM (SELECT *, {_TRI.format('p_name')} AS a, {_TRI.format('p_type')} AS b FROM part)")
def n8_trigram_similarity(spark, d):
    return ledger.table(spark, d, "part").select("p_partkey", text.similarity(F.col("p_name"), F.col("p_type")).alias("sim"))


@query(f"SELECT merchant, count(*) AS n, median(x) AS med, mad(x) AS mad FROM ({SPEND_E}) GROUP BY merchant")
def a4_median_mad(spark, d):
    return rules.robust(rules.spend(ledger.events(spark, d)), "merchant")


@query(f"SELECT merchant, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_pop(x) / avg(x) END AS cv FROM ({SPEND_O}) GROUP BY merchant")
def a6_coefficient_of_variation(spark, d):
    g = rules.spend(ledger.orders(spark, d)).groupBy("merchant")
    return g.agg(F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_pop("x") / F.avg("x")).alias("cv"))


@query(f"SELECT category, quantile_cont(x, 0.99) AS p99 FROM ({SPEND_O}) GROUP BY category")
def a7_percentile(spark, d):
    return rules.ranked(rules.spend(ledger.orders(spark, d)), ["category"], "x", 0.99, "p99").select("category", "p99")


@query(f"SELECT account, strftime(date, '%Y-%m') AS month, count(*) AS n, sum(cents) AS cents FROM ({EVENTS}) GROUP BY ALL")
def a13_month_counts(spark, d):
    return ledger.events(spark, d).groupBy("account", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def _outlier_sql(rows: str, key: str, least: int) -> str:
    return f"""WITH r AS ({rows}), s AS (SELECT {key}, count(*) AS n, median(x) AS med, mad(x) AS mad FROM r GROUP BY {key}),
z AS (SELECT id, r.{key} AS grp, cents, x, med, mad, CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad END AS z FROM r JOIN s USING ({key}) WHERE n >= {least} AND x - med >= 2500)
SELECT id, grp, cents, CAST(floor(x - med + 0.5) AS BIGINT) AS impact, CASE WHEN mad = 0 THEN 0.7 ELSE least(0.9, 0.6 + (abs(z) - 3.5) * 0.05) END AS confidence
FROM z WHERE CASE WHEN mad = 0 THEN x > 3 * med ELSE abs(z) > 3.5 END"""


@query(_outlier_sql(SPEND_E, "merchant", 5))
def r9_outlier_merchant(spark, d):
    return rules.outliers(ledger.events(spark, d), "merchant", 5)


@query(f"SELECT c.* FROM ({_outlier_sql(SPEND_E, 'account', 15)}) c WHERE c.id NOT IN (SELECT id FROM ({_outlier_sql(SPEND_E, 'merchant', 5)}))")
def r9_outlier_category(spark, d):
    e = ledger.events(spark, d)
    return rules.outliers(e, "account", 15).join(rules.outliers(e, "merchant", 5).select("id"), "id", "left_anti")


@query(f"SELECT year, place, id, cents FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY x DESC, id) AS place FROM (SELECT *, year(date) AS year, count(*) OVER (PARTITION BY year(date)) AS n, quantile_cont(x, 0.99) OVER (PARTITION BY year(date)) AS p99 FROM ({SPEND_O})) WHERE n >= 50 AND x >= 20000 AND x >= p99) WHERE place <= 10")
def r10_outlier_yearly(spark, d):
    return rules.yearly(ledger.orders(spark, d))


_MONTHLY = f"""r AS (SELECT *, date_trunc('month', date) AS month FROM ({SPEND_O})), e AS (SELECT min(date) AS a, max(date) AS b FROM ({ORDERS})),
ends AS (SELECT CAST(CASE WHEN a = date_trunc('month', a) THEN a ELSE date_trunc('month', a) + INTERVAL 1 MONTH END AS DATE) AS f, CAST(CASE WHEN b = last_day(b) THEN date_trunc('month', b) ELSE date_trunc('month', b) - INTERVAL 1 MONTH END AS DATE) AS l FROM e),
months AS (SELECT CAST(unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
m AS (SELECT k.category, months.month, CAST(coalesce(sum(x), 0) AS BIGINT) AS total FROM (SELECT DISTINCT category FROM r) k CROSS JOIN months LEFT JOIN r ON r.category = k.category AND r.month = months.month GROUP BY ALL)"""


@query(f"WITH {_MONTHLY} SELECT category, month, total FROM m")
def w8_month_spine(spark, d):
    return rules.monthly(ledger.orders(spark, d), "category")


@query(f"WITH {_MONTHLY}, w AS (SELECT *, avg(total) OVER v AS before, min(total) OVER v AS low, count(*) OVER v AS k FROM m WINDOW v AS (PARTITION BY category ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT category AS grp, month, total, before FROM (SELECT *, row_number() OVER (PARTITION BY category, month(month) ORDER BY month) AS turn FROM w WHERE k = 3 AND low > 0 AND total - before > 7500 AND total - before > 0.4 * before) WHERE turn = 1")
def r11_spikes(spark, d):
    return rules.spikes(ledger.orders(spark, d), "category")


@query(f"WITH {_MONTHLY}, dl AS (SELECT *, total - lag(total) OVER (PARTITION BY category ORDER BY month) AS delta FROM m), u AS (SELECT category, mad(delta) AS mad FROM dl WHERE delta IS NOT NULL GROUP BY category), i AS (SELECT *, sum(CASE WHEN delta > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY category ORDER BY month) AS island FROM dl), g AS (SELECT category, island, count(*) AS n, min(month) AS first_month, max(month) AS last_month, min(total) AS low, max(total) AS high FROM i GROUP BY ALL) SELECT category AS grp, first_month, last_month, high - low AS rise FROM g JOIN u USING (category) WHERE n >= 4 AND low > 0 AND high - low > 5000 AND high - low > 0.25 * low AND high - low > 2 * mad")
def r12_climbs(spark, d):
    return rules.climbs(ledger.orders(spark, d), "category")


_J2 = f"SELECT a.id AS debit, b.id AS credit, b.cents, date_diff('day', a.date, b.date) AS gap FROM ({EVENTS}) a JOIN ({EVENTS}) b ON -a.cents = b.cents AND a.cents < 0 AND b.cents > 0 AND a.account <> b.account AND date_diff('day', a.date, b.date) BETWEEN -1 AND 7"


@query("SELECT l_partkey, l_suppkey, b.n AS incoming, b.n - coalesce(a.n, 0) AS inserts FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) b LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) a USING (l_partkey, l_suppkey) WHERE b.n > coalesce(a.n, 0)")
def j11_bag_merge(spark, d):
    rows = ledger.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return matching.bag_difference(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag <> 'N'"), "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS occurrence FROM lineitem")
def w5_occurrence_index(spark, d):
    rows = ledger.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.withColumn("occurrence", (F.row_number().over(by) - 1).cast("long"))


@query(f"SELECT debit AS id FROM ({_J2}) UNION SELECT credit FROM ({_J2})")
def u1_union_distinct(spark, d):
    c = matching.transfer_candidates(ledger.events(spark, d))
    return c.select(F.explode(F.array("debit", "credit")).alias("id")).distinct()


