import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import classify as CL
from spendcadence.plans import adapters as A
from spendcadence.plans import journeys, spend, value
from spendcadence.session import released, stored
from spendcadence.sinks import reports as RP
from spendcadence.sources import events as E
from spendcadence.sources import profiles as P
from spendcadence.sources import statement_csv as C
from spendcadence.sources import statement_text as X


def pages(spark, *texts):
    rows = [(1, "s", i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "account_id long, statement_id string, page_no int, text string")


def parsed(spark, *texts):
    rows = X.parse_statements(pages(spark, *texts), 2019).orderBy("seq").collect()
    return [(r["date"].isoformat(), r["description"], r["debit"], r["credit"], r["balance"]) for r in rows]


def test_year_of_a_period_that_crosses_and_one_that_does_not(spark):
    head = "Statement Period: 01{} to 31{}\n"
    line = "05OCT SHOP J$ 1.00 -\n07JAN SHOP J$ 2.00 +"
    years = [[d[:4] for d, *_ in parsed(spark, head.format(a, b) + line)] for a, b in (("SEP23", "JAN24"), ("OCT23", "DEC23"))]
    assert years == [["2023", "2024"], ["2023", "2023"]]
    assert parsed(spark, "no period\n05OCT SHOP J$ 1.00 -")[0][0] == "2019-10-05"


def test_continuation_balance_and_fees(spark):
    text = """Statement Period: 01JAN24 to 31MAR24
  05JAN ONE J$ 1,234.50 - J$ 99.00
   more text
06JAN TWO J$ 5.00 - J$ 5.00
* note
07JAN THREE J$ 5.00 +
Page 1"""
    second = """08JAN FOUR J$ 5.00 -
GCT/GOVT TAX
09JAN SERVICE CHARGE J$ 1.00 -
line
31FEB FIVE J$ 1.00 -
10XYZ SIX J$ 1.00 -"""
    assert parsed(spark, text, second) == [
        ("2024-01-05", "ONE | more text", 1234.5, 0.0, 99.0), ("2024-01-06", "TWO", 5.0, 0.0, 0.0),
        ("2024-01-07", "THREE", 0.0, 5.0, 0.0), ("2024-01-10", "SIX", 1.0, 0.0, 0.0),
    ]


def test_page_files(spark, tmp_path):
    (tmp_path / "12_2024Q1_1.txt").write_text("Statement Period: 01JAN24 to 31MAR24\n05JAN ONE J$ 1.00 -")
    rows = X.parse_statements(X.read_page_files(spark, str(tmp_path)), 2019).collect()
    assert [(r["account_id"], r["statement_id"], r["date"]) for r in rows] == [(12, "2024Q1", dt.date(2024, 1, 5))]


def test_csv_headers_and_signs(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Post Date, Value Date ,NARRATIVE,Amount,Balance\n,05/01/2024,Shop,-12.50,1\n06/01/2024,,Pay,\"1,000.00\",2\nbad,,x,5,1\n07/01/2024,,zero,0,1\n"
    )
    rows = C.read_statement_rows(C.read_csv(spark, str(tmp_path / "a.csv"))).orderBy("date").collect()
    assert [(r["date"], r["description"], r["debit"], r["credit"], r["balance"]) for r in rows] == [
        (dt.date(2024, 1, 5), "Shop", 12.5, 0.0, 1.0), (dt.date(2024, 1, 6), "Pay", 0.0, 1000.0, 2.0)]


def test_cells_and_lines(spark):
    cells = [["2024-01-05", "12.00", "Corner shop", ""], ["2024-01-05", "Corner shop", "12.00"], ["12.00", "7.00", "2024-01-05", "Shop 1"],
             ["12", "x"], [None, "2024-01-05", "REFERENCE 12345", "8"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c array<string>")
    found = [r["t"] and (r["t"]["description"], r["t"]["debit"], r["t"]["credit"])
             for r in df.orderBy("i").select(C.parse_cell_row(F.col("c")).alias("t")).collect()]
    # after a date and two amounts a short text with a digit overwrites the second amount
    assert found == [("Corner shop", 12.0, 0.0), None, ("", 12.0, 1.0), None, None]
    lines = spark.createDataFrame([("5/1/2024  Shop  1,000.00 20.00 30.00",), ("x 5 Jan 2024 Café 9.50",), ("5/1/2024 nothing",)], "line string")
    rows = [(r["date"].day, r["description"], r["debit"], r["credit"], r["balance"]) for r in C.parse_text_lines(lines).collect()]
    assert rows == [(5, "Shop", 1000.0, 20.0, 30.0), (5, "Café", 9.5, 0.0, 0.0)]


def test_files_per_account(spark):
    rows = [(1, f"f{i}", i) for i in range(6)] + [(2, "f0", 0)]
    df = spark.createDataFrame(rows, "account_id int, statement_id string, seq int")
    kept = C.union_statements([df.filter("seq < 3"), df.filter("seq >= 3")], max_files=4)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(1, "f0"), (1, "f1"), (1, "f2"), (1, "f3"), (2, "f0")]


def test_calendar_json(spark, tmp_path):
    items = [{"user_id": 1, "event_id": 1, "summary": "A", "start": {"date": "2024-01-02"}, "end": {"dateTime": "2024-01-03T10:00:00Z"}},
             {"user_id": 1, "event_id": 2}]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(i) for i in items))
    rows = E.read_calendar_events(spark, str(tmp_path)).orderBy("event_id").collect()
    assert [(r["summary"], r["start"], r["end"], r["location"]) for r in rows] == [
        ("A", "2024-01-02", "2024-01-03T10:00:00Z", ""), ("No Title", "", "", "")]
    assert [E.horizon_days(m) for m in (6, 1)] == [182, 30]
    shown = E.events_preview(E.read_calendar_events(spark, str(tmp_path))).collect()
    assert sorted(r["date"] for r in shown) == ["2024-01-02", "?"]


def test_horizon_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    A.calendar_events(spark, "/root/testdata/sf0.001").write.parquet(path)
    plan = E.events_in_horizon(spark.read.parquet(path), A.TODAY_TRAVEL, 6).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(start_date" in plan and "summary" not in plan.split("ReadSchema")[1]


def test_profiles(spark):
    body = '{"frequency": "yearly", "category": "gaming", "pricing_verified": true, "pricing_tiers": {"monthly": {"usd": 3}, "yearly": "30"}}'
    replies = [body, f"```json\n{body}\n```", f"```\n{body}\n```", "no json", "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = P.decode_profile_json(df).orderBy("i").collect()
    assert [r["decoded"] for r in rows] == [True, True, True, False, False]
    assert {(r["frequency"], r["monthly_price"], r["yearly_price"]) for r in rows[:3]} == {("yearly", 3.0, 30.0)}
    filled = P.apply_defaults(P.decode_profile_json(df).filter("i = 0")).first()
    assert (filled["engagement_type"], filled["is_multi_device"], filled["lifetime_price"]) == ("active", False, 0.0)
    subs = spark.createDataFrame([("Gym",), ("New",)], "name string")
    known = spark.createDataFrame([("Gym", True, "physical", True, False, 5.0)],
                                  "name string, is_local boolean, location_type string, can_pause boolean, can_cancel_and_rejoin boolean, cancellation_penalty double")
    found = {r["name"]: (r["is_local"], r["location_type"]) for r in P.attach_locality(subs, known).collect()}
    assert found == {"Gym": (True, "physical"), "New": (False, "portable")}


def test_documents_hold_every_transaction_by_month(spark, sf_small, tmp_path):
    docs = spend.statement_documents(spark, sf_small)
    rows = spend.classified(spark, sf_small)
    header = docs.filter(F.col("month") == RP.HEADER)
    assert header.count() == rows.select("account_id").distinct().count()
    assert header.filter("transactions is not null or price_changes is not null").count() == 0
    months = docs.filter(F.col("month") != RP.HEADER)
    assert months.agg(F.sum(F.size("transactions"))).first()[0] == rows.count()
    assert months.filter("exists(transactions, t -> substr(t.date, 1, 7) <> month)").count() == 0
    RP.write_documents(docs, str(tmp_path / "docs"))
    doc = spark.read.json(str(tmp_path / "docs" / "headers")).filter("paycycle_map IS NOT NULL").first()
    assert len(doc["paycycle_map"]) == 30 and doc["summary"]["total_subscriptions"] == len(doc["subscriptions"])


def test_a_rerun_of_a_month_replaces_that_month(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(k, m, [k]) for k in (1, 2) for m in ("", "2024-01", "2024-02", "2024-03")]
    docs = spark.createDataFrame(rows, "account_id int, month string, transactions array<int>")
    RP.write_documents(docs, path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "docs" / "months").rglob("part-*")}
    again = spark.createDataFrame([(1, "", [9]), (1, "2024-02", [7, 8])], docs.schema)
    for _ in range(2):
        RP.write_documents(again, path)
    found = sorted((r.month, r.account_id, r.transactions) for r in RP.read_documents(spark, path).collect())
    others = [(m, k, [k]) for m in ("2024-01", "2024-03") for k in (1, 2)]
    assert found == sorted([("", 1, [9]), ("2024-02", 1, [7, 8]), *others])
    kept = [f for f in files if "2024-02" not in str(f)]
    assert kept and all(f.stat().st_mtime_ns == files[f] for f in kept)


def test_reports_leave_no_cached_plan(spark, sf_small):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    spend.statement_documents(spark, sf_small).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    plan = spend.classified(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan


def test_stored_tables_can_be_released(spark):
    table = stored(spark.range(5))
    assert table.count() == 5
    released(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.stored_at).count()


def test_usage_and_travel_documents(spark, sf_small):
    doc = value.usage_documents(spark, sf_small).filter("results is not null").first()
    assert doc["count"] == len(doc["results"]) and [r["app_name"] for r in doc["results"]] == sorted(r["app_name"] for r in doc["results"])
    trips = journeys.travel_documents(spark, sf_small)
    found = trips.groupBy("user_id").agg(
        F.sum(F.aggregate("recommendations", F.lit(0.0), lambda s, r: s + r["net_savings"])).alias("saved"),
        F.max("total_savings").alias("total"),
    )
    assert found.filter("saved is not null").count() and found.filter("abs(saved - total) > 1").count() == 0


def test_export_columns(spark, sf_small):
    export = RP.transaction_export(CL.classify_transactions(A.transactions(spark, sf_small)))
    assert export.columns == ["account_id", "date", "description", "debit", "credit", "category", "vendor_name", "is_subscription"]


def test_labeled_event_files(spark, tmp_path):
    text = 'event_summary,event_location,event_description,is_travel,trigger_type\nFlight,Miami,"to ""see""",1,vacation\nCall,,{},0,\n'
    (tmp_path / "plain.csv").write_text(text.format("daily"))
    rows = E.read_labeled_events(spark, str(tmp_path / "plain.csv")).orderBy("label").collect()
    assert [(r["label"], r["trigger_type"]) for r in rows] == [(0, ""), (1, "vacation")]
    (tmp_path / "broken.csv").write_text(text.format('"two\nlines"'))
    assert E.read_labeled_events(spark, str(tmp_path / "broken.csv"), line_breaks=True).count() == 2


def test_entries_are_gathered_by_as_many_tasks_as_asked(spark):
    rows = spark.range(600).selectExpr("id % 40 AS account_id", "id AS seq", "concat('2024-0', 1 + id % 3, '-05') AS date")
    plain, cut = (
        RP.section(rows, "account_id", "tx", F.struct("seq"), ["seq"], RP.month_of("date"), parts)
        for parts in (None, 7)
    )
    assert sorted(cut.collect()) == sorted(plain.collect())
    assert cut.rdd.getNumPartitions() == 7
