"""Next charge date and confidence window per subscription."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import text as T

DEFAULT_INTERVAL = 30


def charge_days(classified: DataFrame, key: str = "account_id") -> DataFrame:
    """Per (key, vendor): number of charges and the set of charge days.

    Gaps of zero days carry no information beyond the count, so only distinct
    days travel: the set is built map-side and bounded by the calendar.
    """
    return (
        classified.filter(F.col("is_subscription") & (F.col("debit") > 0))
        .groupBy(key, T.vendor_key(F.col("vendor_name")).alias("vendor"))
        .agg(F.count(F.lit(1)).alias("data_points"), F.array_sort(F.collect_set("date")).alias("days"))
    )


def charge_intervals(days: Column) -> Column:
    """Positive day gaps between consecutive charges, in order."""
    return F.transform(
        F.slice(days, F.lit(2), F.greatest(F.size(days) - 1, F.lit(0))),
        lambda day, i: F.datediff(day, F.element_at(days, (i + 1).cast("int"))),
    )


def median_interval(gaps: Column) -> Column:
    """Median of sorted gaps (mean of the middle two)."""
    n = F.size(gaps)
    upper = F.element_at(gaps, (F.floor(n / 2) + 1).cast("int"))
    lower = F.element_at(gaps, F.greatest(F.floor(n / 2), F.lit(1)).cast("int"))
    return F.when(n % 2 == 0, (lower + upper) / 2.0).otherwise(upper.cast("double"))


def index_iqr(gaps: Column) -> Column:
    """Spread between the sorted gaps at positions n div 4 and 3n div 4 (no interpolation)."""
    n = F.size(gaps)
    low = F.element_at(gaps, (F.floor(n / 4) + 1).cast("int"))
    high = F.element_at(gaps, (F.least(F.floor(n * 3 / 4), n - 1) + 1).cast("int"))
    return high - low


def iqr_band(iqr: Column) -> Column:
    return F.greatest(F.bround(iqr * 1.5, 0).cast("int"), F.lit(2))


def iqr_label(iqr: Column) -> Column:
    return F.when(iqr <= 2, "high").when(iqr <= 7, "medium").otherwise("low")


def interval_profile(days: DataFrame) -> DataFrame:
    """``median_interval_days, band_days, confidence_label, method`` by number of charges."""
    n = F.col("data_points")
    sorted_gaps = days.withColumn("gaps", F.array_sort(charge_intervals(F.col("days"))))
    enough = (n >= 3) & (F.size("gaps") > 0)
    stats = sorted_gaps.withColumns(
        {
            "_median": F.when(F.size("gaps") > 0, median_interval(F.col("gaps"))),
            "_iqr": F.when(enough, index_iqr(F.col("gaps"))),
        }
    )
    measured = (n == 2) | enough
    return stats.withColumns(
        {
            "median_interval_days": F.when(measured, F.col("_median")),
            "band_days": F.when(n == 2, F.lit(5)).when(enough, iqr_band(F.col("_iqr"))).otherwise(F.lit(7)),
            "confidence_label": F.when(n == 2, "medium").when(enough, iqr_label(F.col("_iqr"))).otherwise("low"),
            "method": F.when(n < 2, "cold_start")
            .when(n == 2, "single_interval")
            .when(enough, "median_iqr")
            .otherwise("fallback"),
        }
    ).withColumn(
        "median_interval_days", F.coalesce(F.col("median_interval_days"), F.lit(float(DEFAULT_INTERVAL)))
    )


def roll_forward(last: Column, interval: Column, today: Column) -> Column:
    """First ``last + k * interval`` (k >= 1) that is not before today, without a loop."""
    step = F.floor(interval).cast("int")
    cycles = F.greatest(F.lit(1), F.ceil(F.datediff(today, last) / step)).cast("int")
    return F.date_add(last, cycles * step)


def predict_renewals(classified: DataFrame, today: str, key: str = "account_id") -> DataFrame:
    """Next charge of every subscription with its confidence window."""
    now = F.to_date(F.lit(today))
    profiled = interval_profile(charge_days(classified, key))
    dated = profiled.withColumn("last_charge_date", F.element_at("days", -1)).withColumn(
        "next_charge_date", roll_forward(F.col("last_charge_date"), F.col("median_interval_days"), now)
    )
    return dated.select(
        key,
        T.title_case(F.col("vendor")).alias("subscription"),
        "next_charge_date",
        F.datediff("next_charge_date", now).alias("days_until_charge"),
        "median_interval_days",
        F.struct(
            F.expr("date_sub(next_charge_date, band_days)").alias("earliest"),
            F.expr("date_add(next_charge_date, band_days)").alias("latest"),
            "band_days",
        ).alias("confidence_window"),
        "confidence_label",
        "method",
        "data_points",
        "last_charge_date",
    )


def charge_urgency(days_until: Column) -> Column:
    """How soon the charge comes: within 3 days, within 7, later."""
    return F.when(days_until <= 3, "urgent").when(days_until <= 7, "soon").otherwise("later")
