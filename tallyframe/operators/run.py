"""One analysis: a snapshot read once, every rule over it, all findings in one schema, the emission policy.

The snapshot's rows are written once to the shared folder, and counted by an ``Observation`` in that
same job, so the row guard costs no scan of its own. The series are found once and written too, as
five rules build on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.money import half_up
from . import coverage, fees, findings, rules, series, trends
from .walks import held

#: What each rule is called.
RULES = ["recurrence.v1", "price_creep.v1", "duplicate.v1", "trial.v1", "lapsed.v1", "fees.v1", "outlier.v1", "trend.v1", "micro.v1"]
#: Confidence of a spike, a climb, small spend, a year's largest rows.
SPIKE, CLIMB, MICRO, WINDOW = 0.7, 0.6, 0.9, 0.9
FINDING = ["rule", "subject_type", "subject", "impact", "confidence", "kind", "llm", "exempt"]
LEDGER = ["id", "account", "date", "cents", "normalized", "merchant", "category", "pending", "transfer", "excluded", "refund_pair"]


@dataclass
class Snapshot:
    """``ledger`` (see ``LEDGER``), ``merchants`` (merchant, known, transfer_kind, overlap_group), ``accounts`` (account), ``categories``
    (category, kind, overlap_group) and ``imports`` (account, start, end, status) as one analysis sees them."""

    ledger: DataFrame
    merchants: DataFrame
    accounts: DataFrame
    categories: DataFrame
    imports: DataFrame
    rows: int
    warning: str


def snapshot(ledger: DataFrame, merchants: DataFrame, accounts: DataFrame, categories: DataFrame, imports: DataFrame, warn: int = coverage.WARN, refuse: int | None = coverage.REFUSE) -> Snapshot:
    """The tables as they are now, with the warning of the row guard; more rows than ``refuse`` are an error (None lifts the limit)."""
    seen = Observation("snapshot")
    kept = held(ledger.select(*LEDGER).observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get["rows"]
    return Snapshot(kept, merchants, accounts, categories, imports, rows, coverage.guard(rows, warn, refuse))


def _as_findings(found: DataFrame, rule: str, kind: str, subject: str, impact: Column | str, flag: Column | str, confidence: Column | str = "confidence", exempt: bool = False) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return found.select(
        F.lit(rule).alias("rule"), (F.col(kind) if kind in found.columns else F.lit(kind)).alias("subject_type"), F.col(subject).cast("string").alias("subject"), column(impact).cast("long").alias("impact"),
        column(confidence).cast("double").alias("confidence"), column(flag).alias("kind"), F.lit(False).alias("llm"), F.lit(exempt).alias("exempt"),
    )


def findings_by_rule(s: Snapshot) -> dict[str, DataFrame]:
    """Each rule's findings (``FINDING``), before the emission policy."""
    ends = coverage.coverage_end(s.imports)
    # The five rules on series read them from here.
    found = held(series.series(s.ledger, s.merchants, ends))
    creep = held(series.price_creep(found))
    trials = series.trials(found, s.ledger, creep.where("first_material"))
    fee = fees.fees(s.ledger, s.categories)
    left = fees.findings(fee, fees.reversals(fee, s.ledger))
    see, save = F.lit("visibility"), F.lit("savings")
    # A row that stands out at its merchant is not told again for its category.
    by_merchant = held(rules.outliers(s.ledger.where("merchant is not null"), "merchant", 5))
    by_category = rules.outliers(s.ledger.where("category is not null"), "category", 15).join(by_merchant.select("id"), "id", "left_anti")
    members = trends.charges(found)
    windows = rules.windows(s.ledger, members)
    # Nothing is told of months that are not proven complete in every account.
    covered = held(coverage.fully_covered(s.imports, s.accounts))
    moved = held(trends.trends(s.ledger, covered, s.categories, members))
    moved = moved.withColumn("subject", F.concat_ws(":", F.col("category").cast("string"), "kind", F.date_format("month", "yyyy-MM")))
    sure = F.when(F.col("kind") == "spike", SPIKE).otherwise(CLIMB)
    out = {
        "recurrence.v1": _as_findings(series.portfolio(found), "recurrence.v1", "portfolio", "subject", "annual", see),
        "price_creep.v1": _as_findings(creep, "price_creep.v1", "series", "series", "impact", save),
        "duplicate.v1": _as_findings(series.duplicates(found), "duplicate.v1", "series", "subject", "impact", save).unionByName(
            _as_findings(series.overlaps(found, s.merchants, s.ledger, s.categories), "duplicate.v1", "category", "overlap_group", "annual", see)
        ),
        "trial.v1": _as_findings(trials, "trial.v1", "series", "series", "impact", see),
        "lapsed.v1": _as_findings(series.lapsed(found, ends), "lapsed.v1", "series", "series", F.lit(0), see, exempt=True),
        "fees.v1": _as_findings(left, "fees.v1", "account", "account", "impact", "kind"),
        "outlier.v1": _as_findings(by_merchant, "outlier.v1", "merchant", "id", "impact", see)
        .unionByName(_as_findings(by_category, "outlier.v1", "category", "id", "impact", see))
        .unionByName(_as_findings(windows, "outlier.v1", "window", "year", "impact", see, F.lit(WINDOW))),
        "trend.v1": _as_findings(moved.drop("category"), "trend.v1", "category", "subject", "impact", see, sure),
        "micro.v1": _as_findings(rules.micro(s.ledger, covered=covered), "micro.v1", "kind", "grp", "annual", see, F.lit(MICRO)),
    }
    return {rule: out[rule] for rule in RULES}


def union(emissions: dict[str, DataFrame]) -> DataFrame:
    """The findings of all rules as one table, in the rules' order of schema."""
    out = None
    for f in emissions.values():
        f = f.select(*FINDING)
        out = f if out is None else out.unionByName(f)
    return out


def analyze(s: Snapshot, budget: int = findings.BUDGET, floor: int = findings.FLOOR) -> tuple[DataFrame, DataFrame]:
    """(findings with band and place, rollups) of one run over a snapshot."""
    return findings.emitted(union(findings_by_rule(s)), budget, floor)
