import random

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import changes as CH


def charges(spark, by_vendor, start="2024-01-01"):
    rows = [(1, v, i, float(x)) for v, xs in by_vendor.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "account_id int, vendor string, seq long, debit double")
    return df.withColumn("date", F.date_add(F.to_date(F.lit(start)), F.col("seq").cast("int")))


def brute_drift(xs):
    n = len(xs)
    mean = sum(xs) / n
    std = (sum((x - mean) ** 2 for x in xs) / n) ** 0.5
    out, pos, neg = [], 0.0, 0.0
    if n < 3 or std == 0:
        return out
    for i, x in enumerate(xs):
        pos, neg = max(0, pos + x - mean - 0.5 * std), max(0, neg + mean - x - 0.5 * std)
        if pos > 1.5 * std:
            out.append((i, True))
            pos = 0
        if neg > 1.5 * std:
            out.append((i, False))
            neg = 0
    return out


def test_step_raises_one_alarm_at_the_end(spark):
    found = CH.cusum_drift(charges(spark, {"a": [10, 10, 10, 10, 20, 20, 20]})).collect()
    assert [(r["seq"], r["is_up"], r["new_amount"]) for r in found] == [(6, True, 20.0)]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_drift_equals_brute_force(spark, batch):
    rng = random.Random(11)
    data = {"long": [round(rng.uniform(5, 30), 2) for _ in range(300)], "flat": [9.0] * 100, "short": [1, 2],
            "mid": [round(rng.uniform(5, 30), 2) for _ in range(30)]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    found = CH.cusum_drift(charges(spark, data)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {(v, i, up) for v, xs in data.items() for i, up in brute_drift(xs)}
    assert {(r["vendor"], r["seq"], r["is_up"]) for r in found} == expected and len(found) == len(expected)


def test_hundred_thousand_alarms_in_one_series(spark):
    df = spark.range(200_000).selectExpr(
        "1 AS account_id", "'a' AS vendor", "id AS seq", "date_add(date'2000-01-01', cast(id AS int)) AS date",
        "IF(id % 2 = 0, 1D, 9D) AS debit",
    )
    expected = brute_drift([1.0 if i % 2 == 0 else 9.0 for i in range(2000)])
    found = CH.cusum_drift(df)
    assert found.filter("seq < 2000").count() == len(expected)
    assert found.count() == len(brute_drift([1.0 if i % 2 == 0 else 9.0 for i in range(200_000)]))


def drift_of(spark, data, block_rows):
    found = CH.cusum_drift(charges(spark, data), block_rows=block_rows).collect()
    return sorted((r["vendor"], r["seq"], r["is_up"]) for r in found)


def sequential(xs):
    """The fold as it is defined, with mean and deviation from whole cents like the operator's."""
    cents = [round(x * 100) for x in xs]
    n, s, q = len(xs), sum(cents), sum(c * c for c in cents)
    mean, std = float(s) / n / 100.0, float(n * q - s * s) ** 0.5 / n / 100.0
    out, up, down = [], 0.0, 0.0
    for i, x in enumerate(xs):
        up, down = max(0.0, up + (x - mean) - 0.5 * std), max(0.0, down + (mean - x) - 0.5 * std)
        if up > 1.5 * std:
            out.append((i, True))
            up = 0.0
        if down > 1.5 * std:
            out.append((i, False))
            down = 0.0
    return out


@pytest.mark.parametrize("block_rows", [2, 7, 50, 100_000])
def test_blocks_of_a_series_give_the_sequential_fold(spark, block_rows):
    rng = random.Random(block_rows)
    data = {
        "noise": [round(rng.gauss(20, 4), 2) for _ in range(400)],
        "steps": [10.0 + 5 * (i // 90) for i in range(360)],  # rises for long, so starts stay unknown over several blocks
        "turns": [1.0 if i % 2 else 9.0 for i in range(300)],
        "slow": [round(10 + i * 0.01, 2) for i in range(350)],
        "jumps": [rng.choice([5.0, 5.0, 5.0, 50.0]) for _ in range(200)],
    }
    want = sorted((v, i, up) for v, xs in data.items() for i, up in sequential(xs))
    assert drift_of(spark, data, block_rows) == want


def test_dense_days_are_cut_by_seq(spark):
    rng = random.Random(5)
    xs = [round(rng.gauss(20, 4), 2) for _ in range(900)]
    rows = charges(spark, {"a": xs}).withColumn("date", F.expr("date_add(date'2024-01-01', cast(seq div 300 as int))"))
    plans = CH.cusum_drift(rows, block_rows=40)
    assert sorted((r["seq"], r["is_up"]) for r in plans.collect()) == sequential(xs)


def test_a_million_charges_of_one_series(spark):
    df = spark.range(1_000_000).selectExpr(
        "1 AS account_id", "'a' AS vendor", "id AS seq", "date_add(date'1990-01-01', cast(id div 100 AS int)) AS date",
        "cast(1000 + pmod(hash(id), 2000) AS double) / 100 AS debit",
    )
    xs = [r.debit for r in df.orderBy("seq").select("debit").collect()]
    found = CH.cusum_drift(df)
    assert sorted((r["seq"], r["is_up"]) for r in found.collect()) == sequential(xs)
    dealt = found.select("seq", F.spark_partition_id().alias("p")).select("p").distinct().count()
    assert dealt > 1


def test_plans_start_no_job(spark):
    data = charges(spark, {"a": [10, 10, 20, 20]})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans-only", "no job expected")
    CH.cusum_drift(data)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(tracker.getJobIdsForGroup("plans-only")) == []


def test_labels_on_both_sides_of_every_threshold(spark):
    data = {"a": [100, 105], "b": [100, 105.01], "c": [100, 120], "d": [100, 120.5], "e": [100, 150], "f": [100, 150.5],
            "g": [100, 50], "h": [100, 49.5], "i": [100, 95]}
    found = CH.label_price_change(CH.pairwise_price_change(CH.price_pairs(charges(spark, data)))).collect()
    assert {r["vendor"]: (r["type"], r["severity"]) for r in found} == {
        "b": (CH.INCREASE, "info"), "c": (CH.INCREASE, "info"), "d": (CH.INCREASE, "warning"), "e": (CH.INCREASE, "warning"),
        "f": (CH.UPGRADE, "warning"), "g": (CH.DECREASE, "info"), "h": (CH.DOWNGRADE, "info"),
    }
    texts = {r["vendor"]: r["description"] for r in found}
    assert texts["c"] == "Price increased from $100.00 to $120.00 (+20.0%)."
    assert texts["h"] == "Significant price drop: $100.00 → $49.50 (-50%). Likely a plan change."


def test_trial_and_union(spark):
    rows = charges(spark, {"netflix": [0, 10, 10, 20]}).select(
        "account_id", "seq", "date", "debit", F.lit(0.0).alias("credit"), F.lit(True).alias("is_subscription"),
        F.col("vendor").alias("vendor_name"),
    )
    found = CH.detect_price_changes(rows, include_zero=True).orderBy("date").collect()
    assert [(r["subscription"], r["type"], r["change_percent"]) for r in found] == [
        ("Netflix", CH.TRIAL, 100.0), ("Netflix", CH.UPGRADE, 100.0)]
    assert CH.detect_price_changes(rows).count() == 1
