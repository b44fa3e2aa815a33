import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import renewals as RN


def predict(spark, days, today="2024-06-15"):
    rows = [(1, "netflix", d, 10.0, True) for d in days]
    df = spark.createDataFrame(rows, "account_id int, vendor_name string, date string, debit double, is_subscription boolean")
    return RN.predict_renewals(df.withColumn("date", F.col("date").cast("date")), today).first()


def brute(days, today):
    days = sorted(dt.date.fromisoformat(d) for d in days)
    n = len(days)
    gaps = sorted((b - a).days for a, b in zip(days, days[1:]) if b > a)
    if n == 1:
        median, band, label, method = 30, 7, "low", "cold_start"
    elif n == 2:
        median, band, label, method = (gaps[0] if gaps else 30), 5, "medium", "single_interval"
    elif not gaps:
        median, band, label, method = 30, 7, "low", "fallback"
    else:
        m = len(gaps)
        median = gaps[m // 2] if m % 2 else (gaps[m // 2 - 1] + gaps[m // 2]) / 2
        iqr = gaps[min(3 * m // 4, m - 1)] - gaps[m // 4]
        band, method = max(round(1.5 * iqr), 2), "median_iqr"
        label = "high" if iqr <= 2 else "medium" if iqr <= 7 else "low"
    nxt = days[-1] + dt.timedelta(days=int(median))
    while nxt < today:
        nxt += dt.timedelta(days=int(median))
    return nxt, float(median), band, label, method, n


@pytest.mark.parametrize(
    "days",
    [
        ["2024-05-01"], ["2024-05-01", "2024-05-01"], ["2024-05-01", "2024-05-08"], ["2024-05-01"] * 3,
        ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"], ["2024-01-01", "2024-01-31", "2024-03-02"],
        ["2024-01-01", "2024-01-06", "2024-03-01", "2024-03-04", "2024-05-20", "2024-05-20"],
        ["2024-06-01", "2024-06-08", "2024-06-15"], ["2024-01-01", "2024-01-04", "2024-01-08", "2024-01-13", "2024-01-20"],
    ],
)
def test_prediction_equals_brute_force(spark, days):
    r = predict(spark, days)
    expected = brute(days, dt.date(2024, 6, 15))
    assert (r["next_charge_date"], r["median_interval_days"], r["confidence_window"]["band_days"], r["confidence_label"],
            r["method"], r["data_points"]) == expected
    assert r["days_until_charge"] == (expected[0] - dt.date(2024, 6, 15)).days >= 0


def test_urgency(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (7,), (8,)], "d int").select(RN.charge_urgency(F.col("d")))
    assert [r[0] for r in df.collect()] == ["urgent", "urgent", "soon", "soon", "later"]
