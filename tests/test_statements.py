import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, merchants
from tallyframe.sources import statements


@pytest.mark.parametrize(
    "raw, key",
    [
        ("SQ *CORNER BAKERY WA", "CORNER BAKERY"),
        ("POS DEBIT SQ *CORNER BAKERY", "CORNER BAKERY"),
        ("NETFLIX.COM 866-579-7172 CA", "NETFLIX"),
        ("FUEL STOP 99110022 SALEM OR", "FUEL STOP SALEM"),
        ("TRANSFER TO CHECKING", "TRANSFER TO CHECKING"),
        ("76 GAS", "76 GAS"),
        ("SQ *", "SQ"),
        ("CA", "CA"),
        ("ONLINE PMT CARDINAL CARD XXXX9012", "ONLINE PMT CARDINAL CARD"),
        ("", ""),
    ],
)
def test_stages(spark, raw, key):
    row = spark.range(1).select(merchants.stages(F.lit(raw)).alias("k"), F.size(merchants.trace(F.lit(raw))).alias("n")).first()
    assert (row.k, row.n) == (key, 6)


@pytest.mark.parametrize(
    "raw, fmt, day",
    [
        ("01/31/2026", "MM/DD/YYYY", (2026, 1, 31)),
        ("02/30/2026", "MM/DD/YYYY", None),
        ("1/2/75", "M/D/YY", (1975, 1, 2)),
        ("1/2/69", "M/D/YY", (2069, 1, 2)),
        ("Feb 3, 2026", "MMM D, YYYY", (2026, 2, 3)),
        ("Foo 3, 2026", "MMM D, YYYY", None),
        ("2026-01-02x", "YYYY-MM-DD", None),
        ("", "YYYY-MM-DD", None),
    ],
)
def test_dates(spark, raw, fmt, day):
    assert spark.range(1).select(dates.parse(F.lit(raw), fmt)).first()[0] == (day and datetime.date(*day))


PROFILE = {"date_format": "MM/DD/YYYY", "columns": {"transaction_date": "date", "description": "Description", "amount": "Amount", "balance": "Balance", "status": "Status"}, "pending": ["pending"]}
TEXT = 'Account,4821,,,\r\n\r\nDate,Description,Amount,Balance,Status\r\n01/02/2026,"A, ""B""",-4.75,10.00,posted\n01/03/2026,"two\nlines","3,200.00",3210.00,PENDING\n01/04/2026,,bad,,\n01/02/2026,a b,-4.75,,\n'


def test_statement(spark):
    found = spark.createDataFrame([("f", bytearray(TEXT.encode())), ("e", bytearray()), ("n", None)], "path string, content binary")
    assert {r.path: r.k for r in found.select("path", statements.kind(F.col("content")).alias("k")).collect()} == {"f": "csv", "e": "unknown", "n": "unknown"}
    records = statements.records(found, ",")
    assert [(r.record, r.line, len(r.cells)) for r in records.orderBy("record").collect()] == [(0, 1, 5), (1, 2, 1), (2, 3, 5), (3, 4, 5), (4, 5, 5), (5, 7, 5), (6, 8, 5)]
    assert [(r.delimiter, r.fields) for r in statements.delimiters(found).collect()] == [(",", 5)]


def test_a_file_is_judged_by_its_first_records(spark):
    texts = {
        "semicolon": "a;b;c\n" * 5, "tab": "a\tb\nc\td,e\n", "pipe": "x|y\n", "prose": "no delimiter here\n\nat all\n", "empty": "",
        "quoted": '"one;two\nthree";4\n"five;six";7\n', "tie": "a,b;c\nd,e;f\n", "late": "a,b\n" * 25 + "a;b;c;d\n" * 500, "blank": "\n , \na,b,c\n", "open": 'a,b\n"no end,c\nd,e\n',
    }
    found = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()] + [("null", None)], "path string, content binary")
    got = {r.path: (r.delimiter, r.fields, round(r.confidence, 3)) for r in statements.delimiters(found).collect()}
    assert got == {"semicolon": (";", 3, 1.0), "tab": ("\t", 2, 1.0), "pipe": ("|", 2, 1.0), "quoted": (";", 2, 1.0), "tie": (",", 2, 1.0), "late": (",", 2, 1.0), "blank": (",", 3, 1.0), "open": (",", 2, 0.5)}


def test_ledger_rows(spark):
    body = TEXT.split("\r\n", 2)[2]
    found = spark.createDataFrame([("f", bytearray(body.encode()))], "path string, content binary")
    rows = statements.ledger_rows(statements.records(found, ","), PROFILE)
    got = rows.orderBy("row_index").collect()
    assert [(r.description, r.cents, r.balance_cents, r.pending, r.error) for r in got] == [('A, "B"', -475, 1000, False, None), ("two\nlines", 320000, 321000, True, None), ("", None, None, False, "amount"), ("a b", -475, None, False, None)]
    assert {(r.row_index, r.warning) for r in statements.warnings(rows).collect()} == {(1, "pending_row"), (2, "unparsed_row"), (2, "empty_description"), (3, "repeats:0")}
    assert [tuple(r) for r in statements.balance_check(rows).collect()] == [("f", "reconciled", "ascending", 1, 0)]


def test_decoding():
    assert statements.decode("é".encode()) == "é"
    assert statements.decode(b"\x93\x81\xe9") == "“\x81é"


def test_files_are_read_and_checked_in_one_pass(spark, monkeypatch):
    """Against records, header and rows one after the other; files cross batches, and a large one is split twice."""
    r = random.Random(5)
    odd = ["Date", "Amount", "", "  ", '"a, ""b"""', '"two\nlines"', "﻿Date", '"open', "12\n", "Ämount", '"5"\r\n', "(3.00)", "x"]
    row = lambda: ",".join([r.choice(["01/02/2026", "13/13/2026"]), r.choice(["a", '"b, c"', '"d\n""e"']), r.choice(["1.00", "-1.00", "bad"]), r.choice(["", "5.00", "6.00", "4.00"]), "posted"])
    files = [(f"f{k}", [",".join(r.choice(odd) for _ in range(r.choice([1, 3, 5]))) for _ in range(r.randint(0, 2))] + r.choice([["Date,Description,Amount,Balance,Status"], ["Balance,Date,Status,Amount,Description"], []]) + [row() for _ in range(r.randint(0, 12))]) for k in range(60)]
    found = spark.createDataFrame([(p, bytearray(r.choice(["\n", "\r\n"]).join(t).encode())) for p, t in files] + [("n", None)], "path string, content binary").repartition(3)
    told = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(statements, "KEPT", 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for profile in (PROFILE, PROFILE | {"skip_lines": 1}, {"date_format": "MM/DD/YYYY", "has_header": False, "columns": {"transaction_date": 0, "description": 1, "amount": 2, "balance": 3}}):
            want = statements.ledger_rows(statements.records(found, ","), profile)
            got = statements.read(found, ",", profile)
            assert got.dtypes == want.dtypes and told(got) == told(want) and got.count() > 100
            assert told(statements.balance_check_in_order(got)) == told(statements.balance_check(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
