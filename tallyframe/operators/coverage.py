"""Which months statements cover, account by account; configuration and the composition of an analysis."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTH = "interval 1 month"
WARN, REFUSE = 250_000, 1_000_000  # rows of a snapshot


def coverage_end(imports: DataFrame) -> DataFrame:
    """account, coverage_end of committed imports (account, start, end, status)."""
    return imports.where("status = 'committed'").groupBy("account").agg(F.max("end").alias("coverage_end"))


def covered_months(imports: DataFrame) -> DataFrame:
    """account, month: months that one committed import spans whole."""
    ok = imports.where("status = 'committed' and start is not null and end is not null")
    first = F.when(F.col("start") == F.trunc("start", "month"), F.col("start")).otherwise(F.add_months(F.trunc("start", "month"), 1))
    last = F.when(F.col("end") == F.last_day("end"), F.trunc("end", "month")).otherwise(F.add_months(F.trunc("end", "month"), -1))
    spans = ok.select("account", first.alias("a"), last.alias("b")).where("a <= b")
    return spans.select("account", F.explode(F.sequence("a", "b", F.expr(MONTH))).alias("month")).distinct()


def fully_covered(imports: DataFrame, accounts: DataFrame) -> DataFrame:
    """month: covered in every account, archived and empty ones too; an account without coverage leaves none."""
    each = covered_months(imports).join(accounts.select("account"), "account", "left_semi")
    n = accounts.agg(F.count_distinct("account").alias("accounts"))
    return each.groupBy("month").agg(F.count_distinct("account").alias("accounts")).join(F.broadcast(n), "accounts").select("month")


def bar(imports: DataFrame, ledger: DataFrame) -> DataFrame:
    """account, month, state from the first to the last month that an import touches or a row is in: covered, partial or missing."""
    ok = imports.where("status = 'committed' and start is not null and end is not null")
    touched = ok.select("account", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr(MONTH))).alias("month"))
    seen = touched.unionByName(ledger.select("account", F.trunc("date", "month").alias("month"))).distinct()
    spine = seen.groupBy("account").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("account", F.explode(F.sequence("a", "b", F.expr(MONTH))).alias("month"))
    key = ["account", "month"]
    out = spine.join(covered_months(imports).withColumn("whole", F.lit(True)), key, "left").join(seen.withColumn("some", F.lit(True)), key, "left")
    return out.select(*key, F.when(F.col("whole"), "covered").when(F.col("some"), "partial").otherwise("missing").alias("state"))


def resolved(defaults: dict[str, dict], override: dict[str, dict]) -> dict[str, dict]:
    """A configuration with some settings of some sections replaced."""
    return {name: {**section, **override.get(name, {})} for name, section in defaults.items()}


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def config_hash(config: dict) -> str:
    """16 hexadecimal digits of the canonical JSON; whole numbers are written without a point."""
    return hashlib.sha256(json.dumps(_plain(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def guard(rows: int, warn: int = WARN, refuse: int | None = REFUSE) -> str:
    """ok or warn by the number of rows; more than ``refuse`` is an error, unless the limit is lifted with None."""
    if refuse is not None and rows > refuse:
        raise ValueError(f"{rows} rows; the limit is {refuse}")
    return "warn" if rows > warn else "ok"


def review_strip(rows: DataFrame, start, end) -> DataFrame:
    """unparsed, out_of_period, pending, zero, parsed of the rows of an import."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    e = F.col("error").isNotNull()
    return rows.groupBy("path").agg(n(e).alias("unparsed"), n(~e & ~F.col("date").between(start, end)).alias("out_of_period"), n(F.col("pending")).alias("pending"), n(F.col("cents") == 0).alias("zero"), n(~e).alias("parsed"))
