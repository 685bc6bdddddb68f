import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import accounts, aliases, findings, transfers

DAY = datetime.date
LEDGER = "id long, account string, key string, date date, occurrence long, transfer boolean, pair string"
LINKS = "link string, debit long, credit long, score int, state string, created int"


def _first(links):
    """link -> the first link of its credit and state."""
    out = {}
    for x in links:
        out[x["link"]] = min((y["created"], y["link"]) for y in links if (y["credit"], y["state"]) == (x["credit"], x["state"]))[1]
    return out


def _plain(rows, links, computed, now, names):
    """One link after the other; ``names``: the links that new pairs got."""
    rows = {r["id"]: dict(r) for r in rows}

    def clear(link, pair):
        for i in (link["debit"], link["credit"]):
            if i in rows and rows[i]["pair"] == pair:
                rows[i].update(transfer=False, pair=None)

    settled = [x for x in links if x["state"] in ("confirmed", "rejected")]
    machine = {(x["debit"], x["credit"]): x for x in links if x not in settled}
    taken = {(x["debit"], x["credit"]) for x in settled}
    before = _first(list(machine.values()))
    wanted = []
    for c in sorted(computed, key=lambda c: (c["credit"], c["debit"])):
        at = c["debit"], c["credit"]
        if at not in taken:
            old = machine.pop(at, None)
            wanted.append(c | ({"link": old["link"], "created": old["created"]} if old else {"link": names[at], "created": now}))
    for x in machine.values():
        clear(x, before[x["link"]])
    after = _first(wanted)
    for x in wanted:
        if x["state"] == "auto":
            for i in (x["debit"], x["credit"]):
                if i in rows:
                    rows[i].update(transfer=True, pair=after[x["link"]])
        else:
            clear(x, after[x["link"]])
    return sorted((r["id"], r["transfer"], r["pair"]) for r in rows.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_links_replaced_one_by_one(spark, seed):
    r = random.Random(seed)
    pairs = [(d, c) for d in range(20) for c in range(20, 32) if r.random() < 0.2]
    state = lambda *s: r.choice(s)
    links = [{"link": f"L{k:03}", "debit": d, "credit": c, "score": 5, "state": state("auto", "proposed", "confirmed", "rejected"), "created": r.randrange(3)} for k, (d, c) in enumerate(pairs) if r.random() < 0.7]
    computed = [{"debit": d, "credit": c, "score": 4, "state": state("auto", "proposed")} for d, c in pairs if r.random() < 0.6]
    first = _first(links)
    # Some rows bear a pair of a link of theirs, some a foreign one, some are marked by hand.
    rows = []
    for i in range(32):
        own = [first[x["link"]] for x in links if i in (x["debit"], x["credit"])]
        pair = r.choice([None, "other", *own])
        rows.append({"id": i, "account": "a", "key": "k", "date": DAY(2026, 1, 1), "occurrence": 0, "transfer": pair is not None or r.random() < 0.3, "pair": pair})
    ledger = spark.createDataFrame([tuple(x.values()) for x in rows], LEDGER)
    got, kept = transfers.relinked(ledger, spark.createDataFrame([tuple(x.values()) for x in links], LINKS), spark.createDataFrame([tuple(x.values()) for x in computed], "debit long, credit long, score int, state string"), F.lit(9))
    stored = {(x.debit, x.credit): x for x in kept.collect()}
    names = {k: x.link for k, x in stored.items()}
    assert sorted((x.id, x.transfer, x.pair) for x in got.collect()) == _plain(rows, links, computed, 9, names)
    settled = {(x["debit"], x["credit"]): x for x in links if x["state"] in ("confirmed", "rejected")}
    assert all((stored[k].link, stored[k].state) == (x["link"], x["state"]) for k, x in settled.items())
    assert set(stored) == set(settled) | {(c["debit"], c["credit"]) for c in computed}


def _tables(spark):
    rows = [
        (1, "a", "k", DAY(2026, 1, 2), 0, True, "l1"), (2, "b", "k", DAY(2026, 1, 2), 0, True, "l1"), (3, "a", "k", DAY(2026, 1, 1), 1, True, None),
        (4, "c", "k", DAY(2026, 1, 2), 0, True, "l2"), (5, "a", "j", DAY(2026, 1, 3), 0, True, "l2"), (6, "b", "k", DAY(2026, 1, 5), 7, False, None),
    ]
    frame = spark.createDataFrame
    return {
        "ledger": frame(rows, LEDGER),
        "links": frame([("l1", 1, 2, 5, "confirmed", 0), ("l2", 5, 4, 5, "auto", 0)], LINKS),
        "accounts": frame([("a", "USD", True), ("b", "USD", True), ("c", "EUR", True)], "account string, currency string, active boolean"),
        "imports": frame([("a", "x.csv"), ("c", "y.csv"), (None, "z.csv")], "account string, path string"),
        "series": frame([("a", "s1"), ("b", "s2")], "account string, series string"),
        "evidence": frame([("a", 1)], "account string, finding int"),
        "rules": frame([("r1", "a", "b"), ("r2", "a", "c"), ("r3", "c", "a"), ("r4", None, "a")], "rule string, debit_account string, credit_account string"),
    }


def test_merge_reaches_every_table(spark):
    out = accounts.merged(_tables(spark), "a", "b")
    got = {r.id: (r.account, r.occurrence, r.transfer, r.pair) for r in out["ledger"].collect()}
    # Nothing is dropped; moved rows go on from the target's last occurrence, the earliest first; a hand-made mark stays.
    assert got == {1: ("b", 9, False, None), 2: ("b", 0, False, None), 3: ("b", 8, True, None), 4: ("c", 0, True, "l2"), 5: ("b", 0, True, "l2"), 6: ("b", 7, False, None)}
    assert [x.link for x in out["links"].collect()] == ["l2"]
    assert {r.account: r.active for r in out["accounts"].collect()} == {"a": False, "b": True, "c": True}
    assert sorted((r.path, r.account) for r in out["imports"].collect()) == [("x.csv", "b"), ("y.csv", "c"), ("z.csv", None)]
    assert {r.account for r in out["series"].collect()} == {"b"} and [r.account for r in out["evidence"].collect()] == ["b"]
    assert sorted((r.rule, r.debit_account, r.credit_account) for r in out["rules"].collect()) == [("r2", "b", "c"), ("r3", "c", "b"), ("r4", None, "b")]


def test_merges_refused(spark):
    t = _tables(spark)
    for pair, reason in ((("a", "a"), "same_account"), (("a", "z"), "no_such_account"), (("a", "c"), "two_currencies")):
        with pytest.raises(ValueError, match=reason):
            accounts.merged(t, *pair)


def test_fuzzy_join_loses_nothing(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ABC") for _ in range(r.randrange(1, 9)))
    names = {" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(150)}
    keys = {n[:k] + n[k + 1 :] for n in names for k in (0, len(n) // 2)} | set(sorted(names)[:30]) - {""}
    k, a = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in names], "alias string")
    got = {(x.key, x.alias): x.similarity for x in aliases.alike(k, a).collect()}
    grams = lambda t: (lambda x: {x[i : i + 3] for i in range(len(x) - 2)})(f"  {t.strip(' ')} ")
    every = {(x, y): 1.0 if x == y else len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for x in keys for y in names}
    want = {p: s for p, s in every.items() if s >= aliases.FUZZY}
    assert got == pytest.approx(want) and len(want) > len(names)


def test_renormalize_by_ids(spark):
    rows = [(1, "CORNER BAKERY", "CORNER BAKERY", DAY(2026, 1, 1), "old"), (2, "CORNER BAKERY", "CORNER BAKERY", DAY(2026, 1, 3), "old"), (3, "BOOKS", "BOOKS", DAY(2026, 1, 1), "old"), (4, None, None, None, "old"), (5, "TEA", "TEA", DAY(2026, 1, 1), None)]
    ledger = spark.createDataFrame(rows, "id long, normalized string, raw string, date date, merchant string")
    known = spark.createDataFrame([("CORNER BAKERY", "bakery", "exact", 1.0, "user"), ("BOOKS", "books", "exact", 1.0, "user")], aliases.ALIASES)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    told = lambda df: {r.id: r.merchant for r in df.collect()}
    # A row's id reaches all rows of its descriptor; unknown ids, blank keys and descriptors that no alias meets change nothing.
    assert told(aliases.renormalized(ledger, keys(" ", "TEA"), known, ids(1, 4, 99))) == {1: "bakery", 2: "bakery", 3: "old", 4: "old", 5: None}
    assert told(aliases.renormalized(ledger, keys("BOOKS"), known)) == {1: "old", 2: "old", 3: "books", 4: "old", 5: None}


def test_emission_by_cells(spark):
    r = random.Random(4)
    rows = [("big" if r.random() < 0.9 else "small", f"s{k}", r.randrange(2000, 9000) * r.choice([1, -1]), 0.9, False, False) for k in range(1200)]
    found = spark.createDataFrame(rows, "rule string, subject string, impact long, confidence double, llm boolean, exempt boolean")
    kept, rest = findings.emitted(found)
    for rule in ("big", "small"):
        own = sorted((-abs(x[2]), x[1]) for x in rows if x[0] == rule and abs(x[2]) >= findings.FLOOR)
        assert [x.subject for x in kept.where(F.col("rule") == rule).orderBy("place").collect()] == [s for _, s in own[: findings.BUDGET]]
        [told] = rest.where(F.col("rule") == rule).collect()
        assert (told.suppressed, told.below_annual) == (len(own) - findings.BUDGET, -own[findings.BUDGET - 1][0])


def test_links_meet_their_pair_id_without_their_names(spark):
    """Shuffles by the name of a link carry all links' names; their groups tell as much."""
    ledger = spark.createDataFrame([(k, "ab"[k % 2], True, "x") for k in range(6)], "id long, account string, transfer boolean, pair string")
    links = spark.createDataFrame([("x", 0, 1, 5, "auto", 1), ("y", 2, 3, 5, "proposed", 1), ("z", 2, 4, 5, "confirmed", 0)], LINKS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (*transfers.relinked(ledger, links, links.select("debit", "credit", "score", "state"), F.lit(9)), *transfers.without_self_links(ledger, links)):
            assert "hashpartitioning(link" not in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.id, r.pair) for r in transfers.without_self_links(ledger, links)[0].orderBy("id").collect()] == [(k, "x") for k in range(6)]
        assert {r.link for r in transfers.without_self_links(ledger, links)[1].collect()} == {"x", "y"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
