"""Recurring series and the rules that stand on them.

A series is found among the charges of one account at one merchant, the unit that a task holds: a
person's history with a shop. Everything built on series is by DataFrame operations. The source of
this rule is only described; choices that the description leaves open are named below.

Choices: clusters are per account; a series' id is a hash of merchant, account, first date and
first amount; a lone charge has annual cadence; the summary's subject is ``all`` at 0.9.
"""

from __future__ import annotations

import hashlib
import statistics
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.money import half_up
from .rules import spend

#: Label, days, tolerance, turns a year of each cadence.
CADENCES = [
    ("weekly", 7.0, 2.0, 52.18), ("biweekly", 14.0, 2.0, 26.09), ("four_weekly", 28.0, 2.0, 13.04), ("monthly", 30.44, 4.0, 12.0),
    ("quarterly", 91.3, 7.0, 4.0), ("semiannual", 182.6, 12.0, 2.0), ("annual", 365.25, 20.0, 1.0),
]
STEPS = "array<struct<at: date, from_cents: long, to_cents: long, delta_cents: long, held: int, confirmed: boolean>>"
SCHEMA = f"""series string, merchant string, account string, cadence string, cadence_days double, per_year double, status string, confidence double, basis string, n int,
first_cents long, current_cents long, first_seen date, last_seen date, next_expected date, regularity double, known boolean, steps {STEPS}, charges array<string>, concurrent array<string>, component string"""


def fit(days: list[int]) -> tuple[str, float, float, float] | None:
    """The cadence of increasing day numbers, three at least."""
    gaps = [b - a for a, b in zip(days, days[1:])]
    if len(days) < 3:
        return None
    ok = []
    for c in CADENCES:
        turns = [int(g / c[1] + 0.5) for g in gaps]
        score = statistics.median(abs(g - k * c[1]) for g, k in zip(gaps, turns))
        if all(1 <= k <= 3 for k in turns) and score <= c[2]:
            ok.append((score, sum(turns) / len(turns), c[1], c))
    if {"four_weekly", "monthly"} <= {x[3][0] for x in ok}:
        strict = len(days) >= 6 and all(27 <= g <= 29 for g in gaps)
        return CADENCES[2] if strict else CADENCES[3]
    return min(ok)[3] if ok else None


def _clusters(rows: list[tuple]) -> list[list[tuple]]:
    """Rows (day, id, cents) by amount: a gap to the median opens a cluster; then each goes to the nearest median."""
    out: list[list[tuple]] = []
    for r in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if out and r[2] - (m := statistics.median(x[2] for x in out[-1])) <= max(0.05 * m, 100):
            out[-1].append(r)
        else:
            out.append([r])
    for _ in range(5):
        medians = [statistics.median(x[2] for x in c) for c in out]
        new: list[list[tuple]] = [[] for _ in out]
        for r in (r for c in out for r in c):
            new[min(range(len(medians)), key=lambda i: (abs(r[2] - medians[i]), i))].append(r)
        new = [c for c in new if c]
        if sorted(map(sorted, new)) == sorted(map(sorted, out)):
            break
        out = new
    return [sorted(c) for c in out]


def _merged(clusters: list[list[tuple]]) -> list[list[tuple]]:
    """Clusters that follow each other in one cadence are one series that changed its price."""
    clusters = sorted(clusters)
    again = True
    while again:
        again = False
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                a, b = clusters[i], clusters[j]
                both = sorted(a + b)
                whole = fit([r[0] for r in both])
                own = [f for f in (fit([r[0] for r in a]), fit([r[0] for r in b])) if f]
                if whole and all(f[0] == whole[0] for f in own) and min(a[-1][0], b[-1][0]) - max(a[0][0], b[0][0]) <= whole[1]:
                    clusters = sorted([c for k, c in enumerate(clusters) if k not in (i, j)] + [both])
                    again = True
                    break
            if again:
                break
    return clusters


def _interleaved(a: list[tuple], b: list[tuple]) -> bool:
    """Charges take turns for two cycles in a row."""
    turns = [k for _, _, k in sorted([(r[0], r[1], 0) for r in a] + [(r[0], r[1], 1) for r in b])]
    run = best = 1
    for x, y in zip(turns, turns[1:]):
        run = run + 1 if x != y else 1
        best = max(best, run)
    return best >= 4


def _levels(rows: list[tuple], days: float, least: int) -> list[list[tuple]]:
    """Price levels: a change that holds; short inner levels belong to the one before, a short last one stays."""
    hold = max(1, min(2, -int(-60 // days)))
    out: list[list[tuple]] = [[rows[0]]]
    for r in rows[1:]:
        if abs(r[2] - out[-1][0][2]) >= least:
            out.append([r])
        else:
            out[-1].append(r)
    kept = [out[0]]
    for k, level in enumerate(out[1:], 1):
        if (len(level) < hold and k < len(out) - 1) or abs(level[0][2] - kept[-1][0][2]) < least:
            kept[-1] = kept[-1] + level
        else:
            kept.append(level)
    return kept


def _clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def _describe(rows: list[tuple], known: bool, alone: bool, end, least: int) -> dict | None:
    days = [r[0] for r in rows]
    n, basis = len(rows), "fitted"
    c = fit(days)
    if n == 2 and 355 <= days[1] - days[0] <= 375 and abs(rows[1][2] - rows[0][2]) <= max(0.05 * rows[0][2], 100):
        c, basis = CADENCES[-1], "annual_pair"
    elif n == 1 and known and alone:
        c, basis = CADENCES[-1], "single_charge"
    if c is None:
        return None
    label, length, tol, per_year = c
    levels = _levels(rows, length, least)
    hold = max(1, min(2, -int(-60 // length)))
    rest = [abs(b - a - max(1, int((b - a) / length + 0.5)) * length) for a, b in zip(days, days[1:])]
    mid = statistics.median(rest) if rest else 0.0
    regularity = 1 - _clamp((statistics.median(abs(x - mid) for x in rest) if rest else 0.0) / tol)
    sure = [x for x in levels if len(x) >= hold] or levels
    amounts = [r[2] for r in sure[-1]]
    cv = statistics.pstdev(amounts) / statistics.fmean(amounts) if len(amounts) > 1 and statistics.fmean(amounts) else 0.0
    confidence = 0.45 * regularity + 0.30 * _clamp((n - 2) / 6) + 0.25 * (1 - _clamp(cv / 0.05)) + (0.10 if known else 0.0)
    cap = 1.0 if basis == "annual_pair" or n > 3 else 0.70 if n == 3 else 0.45
    last = date.fromordinal(days[-1])
    active = end is None or (end - last).days <= 1.5 * length
    steps = [
        {"at": date.fromordinal(b[0][0]), "from_cents": a[0][2], "to_cents": b[0][2], "delta_cents": b[0][2] - a[0][2], "held": len(b), "confirmed": len(b) >= hold}
        for a, b in zip(levels, levels[1:])
    ]
    return {
        "cadence": label, "cadence_days": length, "per_year": per_year, "status": "active" if active else "lapsed", "confidence": min(confidence, cap), "basis": basis, "n": n,
        "first_cents": levels[0][0][2], "current_cents": levels[-1][0][2], "first_seen": date.fromordinal(days[0]), "last_seen": last, "next_expected": last + timedelta(days=round(length)),
        "regularity": regularity, "known": known, "steps": steps, "charges": [r[1] for r in rows],
    }


def _of_group(merchant: str, account: str, rows: list[tuple], known: bool, end: date | None, least: int) -> list[dict]:
    """The series among the charges (day number, id, cents) of one merchant and account."""
    found = []
    for c in _merged(_clusters(rows)):
        if told := _describe(c, known, len(rows) == 1, end, least):
            ident = hashlib.sha256(f"{merchant}|{account}|{date.fromordinal(c[0][0])}|{c[0][2]}".encode()).hexdigest()
            found.append({"series": ident, "merchant": merchant, "account": account, **told, "rows": c})
    root = {s["series"]: s["series"] for s in found}
    for s in found:
        s["concurrent"] = sorted(t["series"] for t in found if t is not s and _interleaved(s["rows"], t["rows"]))
        for t in s["concurrent"]:
            a, b = sorted((root[s["series"]], root[t]))
            root = {k: a if v == b else v for k, v in root.items()}
    return [{**{k: v for k, v in s.items() if k != "rows"}, "component": root[s["series"]]} for s in found]


def series(ledger: DataFrame, merchants: DataFrame, coverage: DataFrame, step_cents: int = 50) -> DataFrame:
    """The recurring series of a ledger.

    ``merchants``: merchant, known (a subscription service), transfer_kind; ``coverage``: account,
    coverage_end. Rows without a merchant and transfer-kind merchants take no part.
    """
    m = merchants.select(F.col("merchant").cast("string").alias("merchant"), "known", "transfer_kind")
    rows = spend(ledger).where("merchant is not null").select(F.col("id").cast("string").alias("id"), F.col("merchant").cast("string").alias("merchant"), F.col("account").cast("string").alias("account"), "date", "x")
    rows = rows.join(m, "merchant", "left").where(~F.coalesce("transfer_kind", F.lit(False))).withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.join(coverage.select(F.col("account").cast("string").alias("account"), "coverage_end"), "account", "left")
    each = rows.groupBy("merchant", "account").agg(F.sort_array(F.collect_list(F.struct("date", "id", "x"))).alias("rows"), F.first("known").alias("known"), F.first("coverage_end").alias("end"))
    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                charges = [(c["date"].toordinal(), c["id"], c["x"]) for c in r["rows"]]
                out += _of_group(r["merchant"], r["account"], charges, r["known"], r["end"], step_cents)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return each.mapInArrow(run, SCHEMA)


def annual(s: str = "current_cents"):
    return half_up(F.col(s) * F.col("per_year"))


def portfolio(found: DataFrame) -> DataFrame:
    """One row on all active series, none without any: subject, active, lapsed, monthly, annual, confidence."""
    live = F.col("status") == "active"
    g = found.agg(F.count_if(live).alias("active"), F.count_if(~live).alias("lapsed"), F.sum(F.when(live, annual())).alias("annual"))
    return g.where("active > 0").select(F.lit("all").alias("subject"), "active", "lapsed", half_up(F.col("annual") / 12).alias("monthly"), "annual", F.lit(0.9).alias("confidence"))


def totals(found: DataFrame) -> DataFrame:
    """status, n, annual, monthly; the user's word on a status, where there is one, counts. Rounded once."""
    status = F.coalesce("user_status", "status") if "user_status" in found.columns else F.col("status")
    g = found.groupBy(status.alias("status")).agg(F.count("*").alias("n"), half_up(F.sum(F.col("current_cents") * F.col("per_year"))).alias("annual"))
    return g.withColumn("monthly", half_up(F.col("annual") / 12))


def price_creep(found: DataFrame, step: int = 50, yearly: int = 500) -> DataFrame:
    """series, impact, confidence, steps, first_material of series with a step that matters; falls count too."""
    matters = lambda s: (F.abs(s["delta_cents"]) >= step) & (F.abs(s["delta_cents"]) * F.col("per_year") >= yearly)
    f = found.withColumn("material", F.filter("steps", matters)).where(F.size("material") > 0)
    cap = F.when(F.exists("material", lambda s: ~s["confirmed"]), 0.70).otherwise(0.90)
    impact = half_up((F.col("current_cents") - F.col("first_cents")) * F.col("per_year"))
    first = matters(F.get("steps", F.lit(0)))
    return f.select("series", impact.alias("impact"), F.least(cap, "confidence").alias("confidence"), F.size("material").alias("steps"), first.alias("first_material"))


def duplicates(found: DataFrame) -> DataFrame:
    """component, subject, n, impact of concurrent series at one merchant: the cheapest could go; the subject is the earliest."""
    g = found.groupBy("component").agg(F.count("*").alias("n"), F.min(annual()).alias("impact"), F.min(F.struct("first_seen", "series")).alias("first"))
    return g.where("n >= 2").select("component", F.col("first.series").alias("subject"), "n", "impact", F.lit(0.85).alias("confidence"))


def overlaps(found: DataFrame, merchants: DataFrame, ledger: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """overlap_group, n, annual of active series that serve one purpose.

    A merchant's own group counts, else the group that most of the series' charges have by their
    categories (ties: the group charged first).
    """
    live = found.where("status = 'active'").join(merchants.select(F.col("merchant").cast("string").alias("merchant"), F.col("overlap_group").alias("own")), "merchant", "left")
    if ledger is not None and categories is not None:
        charge = live.select("series", F.explode("charges").alias("id"))
        rows = charge.join(ledger.select(F.col("id").cast("string").alias("id"), "date", "category"), "id").join(categories.select("category", "overlap_group"), "category").where("overlap_group is not null")
        g = rows.groupBy("series", "overlap_group").agg(F.count("*").alias("n"), F.min(F.struct("date", "id")).alias("first"))
        place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("n"), "first", "overlap_group"))
        modal = g.withColumn("place", place).where("place = 1").select("series", F.col("overlap_group").alias("modal"))
        live = live.join(modal, "series", "left").withColumn("own", F.coalesce("own", "modal"))
    g = live.where("own is not null").groupBy(F.col("own").alias("overlap_group")).agg(F.count("*").alias("n"), F.sum(annual()).alias("annual"))
    return g.where("n >= 2").withColumn("confidence", F.lit(0.60))


#: Words of a trial offer, lengths of trials in days.
MARKERS = ["TRIAL", "FREE TRIAL", "INTRO OFFER", "INTRO RATE"]
LENGTHS = [7, 14, 30, 90]


def trials(found: DataFrame, ledger: DataFrame, reported: DataFrame) -> DataFrame:
    """series, points, authorization, early, confidence, impact of series that look like converted trials.

    ``reported``: series whose first price step was reported already. The authorization is the
    latest small row of merchant and account from 5 to 35 days before the first charge.
    """
    s = found.join(reported.select("series"), "series", "left_anti")
    rows = ledger.select(F.col("id").cast("string").alias("id"), F.col("merchant").cast("string").alias("merchant"), F.col("account").cast("string").alias("account"), "date", "cents", "normalized", "excluded")
    gap = F.datediff("first_seen", "date")
    small = rows.where("not excluded").where(F.abs("cents") <= 150)
    auth = s.select("series", "merchant", "account", "first_seen").join(small, ["merchant", "account"]).where(gap.between(5, 35)).groupBy("series").agg(F.max(F.struct("date", "id")).alias("a"))
    words = F.concat(F.lit(" "), F.regexp_replace("normalized", "[^A-Z0-9]+", " "), F.lit(" "))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | words.contains(f" {m} ")
    marks = rows.where(marked).select("merchant").distinct().withColumn("marked", F.lit(True))
    # One row, broadcast.
    start = ledger.agg(F.min("date").alias("start")).withColumn("one", F.lit(1))
    out = s.join(auth, "series", "left").join(marks, "merchant", "left").withColumn("one", F.lit(1)).join(F.broadcast(start), "one")
    near = F.lit(False)
    for n in LENGTHS:
        near = near | (F.abs(F.datediff("first_seen", "a.date") - n) <= 3)
    one = lambda c, k: F.when(c, k).otherwise(0)
    points = one(F.col("a").isNotNull(), 2) + one(F.col("a").isNotNull() & near, 1) + one(F.col("marked"), 2) + one(F.get("steps", F.lit(0))["delta_cents"] > 0, 1)
    out = out.withColumn("points", points).where("points >= 2").withColumn("early", F.datediff("first_seen", "start") < 45)
    raw = F.least(0.30 + 0.15 * F.col("points"), F.lit(0.85))
    return out.select("series", "points", F.col("a.id").alias("authorization"), "early", F.when(F.col("early"), F.greatest(raw / 2, F.lit(0.35))).otherwise(raw).alias("confidence"), annual().alias("impact"))


def lapsed(found: DataFrame, coverage: DataFrame) -> DataFrame:
    """series, days, confidence of series of three charges or more that stopped over two cadences before their account's coverage ends."""
    f = found.where("n >= 3").join(coverage.select(F.col("account").cast("string").alias("account"), "coverage_end"), "account")
    days = F.datediff("coverage_end", "last_seen")
    return f.where(days > 2 * F.col("cadence_days")).select("series", days.alias("days"), "confidence")
