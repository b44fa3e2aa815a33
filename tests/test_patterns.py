import random

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import ordered as O
from spendcadence.operators import patterns as PT


def credits(spark, by_key):
    rows = [(k, i, "2024-01-01", float(x)) for k, values in by_key.items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "account_id int, seq long, date string, credit double").withColumn("date", F.col("date").cast("date"))


def brute_leaders(values, tol=0.05):
    leaders = []
    for x in values:
        if x > 0 and not any(abs(x - lead) / lead < tol for lead in leaders):
            leaders.append(x)
    return leaders


def test_sample_leaders(spark):
    values = [100, 103, 250, 98, 251, 104.9, 95.1, 106]
    clusters = PT.cluster_totals(PT.cluster_amounts(credits(spark, {1: values}))).orderBy("leader_no").collect()
    assert [(r["leader"], r["occurrences"]) for r in clusters] == [(100.0, 5), (250.0, 2), (106.0, 1)]


def test_fold_equals_sequential_scan(spark):
    rng = random.Random(3)
    data = {k: [round(rng.uniform(1, 500), 2) for _ in range(120)] for k in range(4)}
    data[9] = [50.0] * 40
    found = PT.amount_leaders(credits(spark, data)).collect()
    assert {r["account_id"]: r["leaders"] for r in found} == {k: brute_leaders(v) for k, v in data.items()}


@pytest.mark.parametrize("together", [3, 50, 1 << 18])
def test_leaders_in_tables_of_any_size(spark, monkeypatch, together):
    rng = random.Random(together)
    data = {k: [round(rng.choice([rng.uniform(0.01, 2), rng.uniform(1, 900)]), 2) for _ in range(150)] for k in range(6)}
    data[7] = [100.0, 105.0, 95.0, 105.01, 94.99, 110.26]
    monkeypatch.setattr(O, "TOGETHER", together)
    monkeypatch.setattr(O.grouped, "__defaults__", (together,))
    rows = credits(spark, data).repartition(1)
    found = {}
    batches = rows.groupBy("account_id", F.col("credit").alias("amount")).agg(F.min("seq").alias("first_seq")).filter("amount > 0")
    ordered = batches.orderBy("account_id", "first_seq").toArrow().to_batches(max_chunksize=40)
    for batch in PT._leader_arrays("account_id", 0.05)(iter(ordered)):
        found |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert found == {k: brute_leaders(v) for k, v in data.items()}


def test_a_million_amounts_of_one_account(spark):
    df = spark.range(1_000_000).selectExpr(
        "1 AS account_id", "id AS seq", "date'2024-01-01' AS date", "cast(1 + pmod(id * 7919, 1000003) AS double) / 100 AS credit"
    )
    leaders = PT.amount_leaders(df).first().leaders
    values = [(1 + i * 7919 % 1000003) / 100 for i in range(1_000_000)]
    assert leaders[:40] == brute_leaders(values[:4000])[:40]
    assert all(min(abs(v - lead) / lead for lead in leaders) < 0.05 for v in values[::997])
    assert all(abs(b - a) / a >= 0.05 for k, b in enumerate(leaders) for a in leaders[:k])


def test_salary_prefers_count_then_total_then_first(spark):
    df = credits(spark, {1: [10, 10, 500, 500], 2: [10, 20], 3: [100, 100, 100, 900, 900]})
    found = {r["account_id"]: (r["amount"], r["occurrences"]) for r in PT.detect_salary(df).collect()}
    assert found == {1: (500.0, 2), 3: (100.0, 3)}


def test_pay_frequency_threshold(spark):
    rows = [(1, 0, "2024-01-01", 100.0), (1, 1, "2024-01-19", 100.0), (2, 0, "2024-01-01", 100.0), (2, 1, "2024-01-20", 100.0)]
    df = spark.createDataFrame(rows, "account_id int, seq long, date string, credit double").withColumn("date", F.col("date").cast("date"))
    found = {r["account_id"]: (r["frequency"], r["pay_day"]) for r in PT.detect_salary(df).collect()}
    assert found == {1: ("biweekly", 1), 2: ("monthly", 1)}


def test_subscription_failures_use_plain_distance(spark):
    days = ["2024-01-31", "2024-03-01", "2024-03-31", "2024-05-28"]
    rows = [(1, i, d, "Netflix", 10.0, True) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "account_id int, seq long, date string, vendor_name string, debit double, is_subscription boolean")
    row = PT.detect_subscriptions(df.withColumn("date", F.col("date").cast("date"))).first()
    assert (row["renewal_day"], row["past_failures"], row["total_months"], row["fail_rate"]) == (31, 2, 4, 0.5)


def test_modal_tie_takes_smallest_day(spark):
    df = spark.createDataFrame([(1, 20, 2), (1, 5, 2), (1, 9, 1)], "k int, day int, charges long")
    assert PT.modal_day(df, ["k"]).first()["modal_day"] == 5
