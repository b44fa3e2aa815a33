import pytest
from pyspark.sql import functions as F

from spendcadence.operators import ordered, patterns
from spendcadence.plans import chains, ingest
from spendcadence.sources import statement_csv, statement_text

HEAD = "Statement Period: 01{0}24 to 28{0}24\n"


def test_statements_of_an_account_follow_each_other(spark):
    """Credits 900, 1000 and then 1050, 1047 in a second statement; pages and ids in another order."""
    pages = spark.createDataFrame(
        [
            (1, "zz", 1, HEAD.format("JAN") + "02JAN PAY J$ 900.00 +"),
            (1, "zz", 2, "03JAN PAY J$ 1,000.00 +"),
            (1, "aa", 1, HEAD.format("FEB") + "02FEB PAY J$ 1,050.00 +\n03FEB PAY J$ 1,047.00 +"),
        ],
        "account_id long, statement_id string, page_no int, text string",
    )
    tx = statement_text.parse_statements(pages.repartition(3), 2024)
    assert [(r.seq, r.credit) for r in tx.orderBy("seq").collect()] == [(1, 900), (2, 1000), (3, 1050), (4, 1047)]
    assert patterns.amount_leaders(tx).first().leaders == [900.0, 1000.0, 1050.0]


def test_long_pages_keep_line_order(spark):
    lines = "\n".join(f"{1 + k % 28:02d}JAN PAY J$ {k + 1}.00 +" for k in range(3000))
    pages = spark.createDataFrame([(1, "a", 1, HEAD.format("JAN") + lines)], "account_id long, statement_id string, page_no int, text string")
    tx = statement_text.parse_statements(pages, 2024).orderBy("seq")
    assert [r.credit for r in tx.collect()] == [k + 1.0 for k in range(3000)]
    assert tx.agg(F.count_distinct("seq")).first()[0] == 3000


def test_files_of_different_layouts(spark, tmp_path):
    (tmp_path / "1_a.csv").write_text('Date,Description,Debit,Credit,Balance\n2024-01-02,"POS, SHOP",10.00,,90\n2024-01-03,PAY,,50.00,140\n')
    (tmp_path / "1_b.csv").write_text("﻿Balance,Amount,Narrative,Post Date\n1,-5.00,FEE,04/02/2024\n")
    (tmp_path / "2_a.csv").write_text("no header here\nDETAILS,Withdrawal,Deposit,Value Date\nX,,7.00,2024-03-01\n")
    rows = statement_csv.read_statement_rows(
        statement_csv.read_statement_files(spark, str(tmp_path)), ["account_id", "statement_id", "seq"]
    )
    found = [tuple(r) for r in rows.withColumn("date", F.col("date").cast("string")).orderBy("account_id", "seq").collect()]
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in found] == [
        (1, "a", "POS, SHOP", 10.0, 0.0), (1, "a", "PAY", 0.0, 50.0), (1, "b", "FEE", 5.0, 0.0), (2, "a", "X", 0.0, 7.0),
    ]
    assert [r[2] for r in found if r[0] == 1] == [1, 2, 3]


def test_split_files_keep_their_order(spark, tmp_path):
    lines = "\n".join(f"2024-01-01,row {k},{k + 1}.00,,0" for k in range(4000))
    (tmp_path / "7_x.csv").write_text("Date,Description,Debit,Credit,Balance\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    rows = statement_csv.read_statement_files(spark, str(tmp_path)).orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.description for r in rows] == [f"row {k}" for k in range(4000)]


def test_wide_files_and_odd_cells(spark, tmp_path):
    extra = ",".join(f"x{k}" for k in range(40))
    (tmp_path / "3_wide.csv").write_bytes(
        (f"{extra},Date,Description,Amount\r\n" + "".join(f"{extra},2024-01-0{k},\"say \"\"{k}\"\", now\",-{k}.00\r\n\r\n" for k in range(1, 6))).encode()
    )
    (tmp_path / "3_short.csv").write_text("Date,Description,Debit,Credit\n2024-02-01,ends early,4.00\n,,,\n2024-02-02,,5.00,,surplus,cells\n")
    (tmp_path / "4_none.csv").write_text("a,b\n1,2\n")
    (tmp_path / "5_empty.csv").write_text("")
    raw = statement_csv.read_statement_files(spark, str(tmp_path))
    rows = statement_csv.read_statement_rows(raw, ["account_id", "statement_id", "seq"]).orderBy("account_id", "seq").collect()
    assert [(r.account_id, r.statement_id, r.description, r.debit) for r in rows] == [
        (3, "short", "ends early", 4.0), (3, "short", "", 5.0), *[(3, "wide", f'say "{k}", now', float(k)) for k in range(1, 6)],
    ]
    assert [r.seq for r in rows] == [1, 3, 4, 5, 6, 7, 8]


def test_blocks_of_one_file_are_numbered_apart(spark, tmp_path):
    lines = "\n".join(f"2024-01-01,row {k},{k + 1}.00,,0" for k in range(3000))
    (tmp_path / "7_x.csv").write_text("Date,Description,Debit,Credit,Balance\n" + lines + "\n")
    (tmp_path / "7_a.csv").write_text("Credit,Narrative,Value Date\n1.00,first,2024-01-01\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordered, "HOT_ROWS", 100)
        patch.setattr(ordered.with_rank, "__defaults__", (100,))
        rows = statement_csv.read_statement_files(spark, str(tmp_path)).orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(1, 3002))
    assert [r.description for r in rows] == ["first", *[f"row {k}" for k in range(3000)]]


def test_files_are_parsed_once(spark, sf_small):
    """What finds patterns reads a table that was written once, not the pages or cells again."""
    queries = [chains.pages_salary, chains.pages_risk_report, chains.pages_price_changes, chains.csv_risk_report, ingest.first_files]
    for query in queries:
        files = query(spark, sf_small).inputFiles()
        assert files and all("/stored-" in f for f in files), query.__name__


def test_long_accounts_are_told_by_lines(spark):
    pages = spark.createDataFrame(
        [(1, "a\nb"), (1, "c"), (2, "a\nb"), (3, None)], "account_id long, text string"
    )
    assert [r.account_id for r in statement_text.accounts_with_many_lines(pages, 2).collect()] == [1]
