from tallyframe.streaming import statements

PROFILE = {"date_format": "MM/DD/YYYY", "columns": {"transaction_date": "Date", "description": "Text", "amount": "Amount"}}


def test_files_are_added_once(spark, tmp_path):
    drop, ledger, state = (str(tmp_path / x) for x in ("drop", "ledger", "state"))
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.csv").write_text("Date,Text,Amount\n01/02/2026,one,-1.00\n01/03/2026,two,bad\n")
    statements.follow(spark, drop, ledger, state, PROFILE, "acc").awaitTermination()
    assert spark.read.parquet(ledger).count() == 1
    (tmp_path / "drop" / "b.csv").write_text("Date,Text,Amount\n01/04/2026,three,-3.00\n")
    (tmp_path / "drop" / "c.txt").write_text("no statement")
    statements.follow(spark, drop, ledger, state, PROFILE, "acc").awaitTermination()
    statements.follow(spark, drop, ledger, state, PROFILE, "acc").awaitTermination()
    rows = spark.read.parquet(ledger)
    assert sorted(r.cents for r in rows.collect()) == [-300, -100] and {len(r.key) for r in rows.collect()} == {64}


def test_a_file_under_two_names_adds_nothing(spark, tmp_path):
    drop, staged, ledger = (str(tmp_path / x) for x in ("drop", "staged", "ledger"))
    (tmp_path / "drop").mkdir()
    head, one, two = "Date,Text,Amount\n", "01/02/2026,tea,-1.00\n", "01/03/2026,bread,-2.00\n"

    def arrive(**texts):
        for name, rows in texts.items():
            (tmp_path / "drop" / f"{name}.csv").write_text(head + rows)
        statements.follow(spark, drop, staged, str(tmp_path / "s1"), PROFILE, "acc").awaitTermination()
        statements.consume(spark, staged, ledger, str(tmp_path / "s2")).awaitTermination()
        rows = spark.read.parquet(ledger).collect()
        assert len({(r.key, r.occurrence) for r in rows}) == len(rows)
        return sorted(r.cents for r in rows)

    assert arrive(a=one + one + two) == [-200, -100, -100]
    assert arrive(again=one + one + two) == [-200, -100, -100]  # the same file
    assert arrive(part=one, more=two + one + one + one, twin=one * 3) == [-200, -100, -100, -100]  # the most of any file, also within a batch
    assert arrive() == [-200, -100, -100, -100]
    assert arrive(new="01/04/2026,tea,-1.00\n") == [-200, -100, -100, -100, -100]
