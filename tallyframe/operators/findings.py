"""Findings: bands, the emission policy, their stored state, search and summaries.

``findings``: rule, subject, impact (a year's cents), confidence, kind (savings, visibility), and
what a rule adds; a stored finding has an id, its natural key, status and evidence hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up

#: Least confidence of each band, the cap of findings that rest on a language model, findings a rule, least impact.
HIGH, MEDIUM, LOW = 0.80, 0.55, 0.35
CAPPED, BUDGET, FLOOR = 0.79, 25, 2500
SNOOZE = 90  # days
CELLS = 64  # a rule's findings, when its largest are chosen


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").when(confidence >= LOW, "low").otherwise("suppressed")


def natural_key(rule: Column, kind: Column, subject: Column) -> Column:
    return F.concat_ws("|", rule, kind, subject.cast("string"))


def evidence_hash(rule: Column, subject: Column, cents: Column, cadence: Column, status: Column) -> Column:
    """32 hexadecimal digits; amounts count in whole units, missing parts as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", part(rule), part(subject), part(half_up(cents / 100)), part(cadence), part(status)), 256), 1, 32)


def emitted(found: DataFrame, budget: int = BUDGET, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(findings with band and place; a rollup row of each rule that has more).

    Confidence that rests on a language model (``llm``) is capped, suppressed bands go, small impacts
    go unless ``exempt``, and each rule keeps its ``budget`` largest. The rollup tells how many were
    left out and the least impact kept.
    """
    f = found.withColumn("confidence", F.when(F.col("llm"), F.least("confidence", F.lit(CAPPED))).otherwise(F.col("confidence")))
    f = f.withColumn("band", band(F.col("confidence"))).where("band <> 'suppressed'").where(F.col("exempt") | (F.abs("impact") >= floor))
    # There are few rules: each one's findings are dealt to cells, and only a cell's largest go on to its place in the rule.
    order = [F.desc(F.abs("impact")), "subject"]
    cell = f.withColumn("cell", F.pmod(F.xxhash64("subject", "impact"), F.lit(CELLS)))
    cell = cell.withColumn("place", F.row_number().over(Window.partitionBy("rule", "cell").orderBy(*order))).where(F.col("place") <= budget).drop("cell")
    top = cell.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).where(F.col("place") <= budget)
    least = top.groupBy("rule").agg(F.min(F.abs("impact")).alias("below_annual"))
    g = f.groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") > budget).join(least, "rule")
    return top, g.select("rule", (F.col("n") - budget).alias("suppressed"), "below_annual")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("rule", F.desc(F.abs("impact")), "subject")


def counts(found: DataFrame, states: DataFrame) -> DataFrame:
    """rule, band, n, unreviewed by rule, by band and over all; unreviewed findings have no state row."""
    seen = found.join(states.select("id", F.lit(1).alias("seen")).distinct(), "id", "left")
    g = seen.groupingSets([["rule"], ["band"], []], "rule", "band")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNull()).alias("unreviewed"))


def headline(found: DataFrame) -> DataFrame:
    """savings: the yearly impact of active findings of that kind, and of no other."""
    active = found.where("status = 'active'") if "status" in found.columns else found
    return active.agg(F.coalesce(F.sum(F.when(F.col("kind") == "savings", F.col("impact"))), F.lit(0)).cast("long").alias("savings"))


def summary(found: DataFrame, runs: DataFrame) -> DataFrame:
    """measure, value: the savings and the number of active findings, and the run that finished last (runs: run, finished; of two at once the larger)."""
    active = found.where("status = 'active'") if "status" in found.columns else found
    row = lambda name, value: (F.lit(name).alias("measure"), value.cast("string").alias("value"))
    last = runs.where("finished is not null").agg(F.max(F.struct("finished", "run")).alias("last"))
    out = headline(found).select(*row("savings", F.col("savings"))).unionByName(active.agg(F.count("*").alias("n")).select(*row("findings", F.col("n"))))
    return out.unionByName(last.select(*row("run", F.col("last.run"))))


def cards(found: DataFrame) -> DataFrame:
    """rule, rule_place, subject, place, impact: rules by their total impact, each one's findings by theirs."""
    g = found.groupBy("rule").agg(F.sum("impact").alias("total"))
    # One row a rule.
    g = g.withColumn("rule_place", F.row_number().over(Window.orderBy(F.desc(F.abs("total")), "rule")))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc(F.abs("impact")), "subject"))
    return found.withColumn("place", place).join(F.broadcast(g), "rule").select("rule", "rule_place", "total", "subject", "place", "impact")


def hidden(now: Column, config: Column) -> Column:
    """Whether the joined state hides a finding: dismissed on the same evidence, and with the same or no configuration; or snoozed until later."""
    dismissed = (F.col("state") == "dismissed") & F.col("dismissed_hash").eqNullSafe(F.col("evidence_hash")) & (F.col("dismissed_config").isNull() | F.col("dismissed_config").eqNullSafe(config))
    snoozed = (F.col("state") == "snoozed") & (F.col("until") > now)
    return F.coalesce(dismissed, F.lit(False)) | F.coalesce(snoozed, F.lit(False))


def changed_since(config: Column) -> tuple[Column, Column]:
    """(evidence changed, configuration changed) since a dismissal."""
    was = F.col("state") == "dismissed"
    return F.coalesce(was & ~F.col("dismissed_hash").eqNullSafe(F.col("evidence_hash")), F.lit(False)), F.coalesce(was & F.col("dismissed_config").isNotNull() & ~F.col("dismissed_config").eqNullSafe(config), F.lit(False))


def search(found: DataFrame, states: DataFrame, evidence: DataFrame, ledger: DataFrame, now: Column, config: Column, *, statuses=("active",), rules=None, bands=None, kinds=None, least=None, accounts=None, visible=True, limit=50, offset=0) -> tuple[DataFrame, DataFrame]:
    """(a page of the findings that meet all of the filters, in order; their number)."""
    f = found.join(states, "id", "left").where(F.col("status").isin(list(statuses)))
    for column, values in (("rule", rules), ("band", bands), ("kind", kinds)):
        if values is not None:
            f = f.where(F.col(column).isin(list(values)))
    if least is not None:
        f = f.where(F.abs("impact") >= least)
    if accounts is not None:
        of = evidence.join(ledger.where(F.col("account").isin(list(accounts))).select(F.col("id").alias("transaction")), "transaction").select(F.col("finding").alias("id"))
        f = f.join(of.distinct(), "id", "left_semi")
    if visible is not None:
        f = f.where(hidden(now, config) != F.lit(visible))
    page = f.orderBy("rule", F.desc(F.abs("impact")), "id").offset(offset).limit(max(1, min(500, limit)))
    return page, f.agg(F.count("*").alias("total"))


def standing(found: DataFrame, rules: DataFrame) -> DataFrame:
    """``found`` with status suppressed where a standing dismissal (scope rule or merchant) covers it, else active."""
    by_rule = rules.where("scope = 'rule'").select("rule", F.lit(True).alias("a")).distinct()
    by_merchant = rules.where("scope = 'merchant'").select("rule", "merchant", F.lit(True).alias("b")).distinct()
    out = found.join(F.broadcast(by_rule), "rule", "left").join(by_merchant, ["rule", "merchant"], "left")
    return out.withColumn("status", F.when(F.coalesce("a", "b", F.lit(False)), "suppressed").otherwise("active")).select(*found.columns, "status")


def applied(stored: DataFrame, found: DataFrame, run: str, now: Column) -> DataFrame:
    """The stored findings after a run: by natural key, ids and first detection stay, what the run has not found is resolved."""
    old = stored.select("natural_key", F.col("id").alias("old_id"), "first_detected", F.struct(*stored.columns).alias("old"))
    new = found.select("natural_key", F.struct(*found.columns).alias("new"))
    both = old.join(new, "natural_key", "full_outer")
    here = F.col("new").isNotNull()
    value = lambda c: F.when(here, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return both.select(
        F.coalesce("old_id", F.sha2("natural_key", 256)).alias("id"), "natural_key", *(value(c) for c in ("rule", "subject", "impact", "confidence", "kind", "evidence_hash")),
        F.when(here, F.col("new.status")).when(F.col("old.status") == "suppressed", "suppressed").otherwise("resolved").alias("status"),
        F.coalesce("first_detected", now).alias("first_detected"), F.when(here, F.lit(run)).otherwise(F.col("old.last_run")).alias("last_run"),
    )


def evidence_of(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """finding, transaction: without repeats, and only of rows that exist."""
    return pairs.select("finding", "transaction").distinct().join(ledger.select(F.col("id").alias("transaction")), "transaction", "left_semi").select("finding", "transaction")


def with_state(states: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """States (id, state, until, dismissed_hash, dismissed_config) after ``changes``, which replace those of the same id; a snooze without an end lasts 90 days."""
    until = F.when(F.col("state") == "snoozed", F.coalesce("until", F.date_add(now, SNOOZE)))
    new = changes.withColumn("until", until).select(*states.columns)
    return states.join(new.select("id"), "id", "left_anti").unionByName(new)


def upserted(stored: DataFrame, new: DataFrame, key: str, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after, keys that vanished): computed columns are the new ones, the user's ``own`` columns stay."""
    kept = new.join(stored.select(key, *own), key, "left")
    return kept, stored.join(new.select(key), key, "left_anti").select(key)
