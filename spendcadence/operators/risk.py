"""Risk that a renewal fails within the pay cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import text as T

MONTH = 30
BIWEEK = 14

# Factor weights and logistic curve.
W_PAYCYCLE, W_CLUSTER, W_HISTORY, W_LOAD = 0.35, 0.25, 0.25, 0.15
STEEPNESS, CENTRE = 8.0, 0.45

# Zones and advice.
ZONES = [(0.3, "SAFE ZONE", "safe"), (0.6, "MID-CYCLE", "moderate"), (0.8, "CAUTION ZONE", "high")]
LAST_ZONE = ("DANGER ZONE", "critical")
RISK_LEVELS = [
    (0.30, "LOW", "low", "Your renewal should go through fine."),
    (0.55, "MODERATE", "moderate", "Check your balance a day before renewal."),
    (0.75, "HIGH", "high", "High risk of insufficient funds. Transfer money to your card."),
]
LAST_RISK_LEVEL = ("CRITICAL", "critical", "This renewal will likely fail. Add funds immediately.")


def days_since_payday(day: Column, pay_day: Column) -> Column:
    return F.when(day >= pay_day, day - pay_day).otherwise(F.lit(MONTH) - pay_day + day)


def days_until_payday(day: Column, pay_day: Column) -> Column:
    return F.when(day < pay_day, pay_day - day).otherwise(F.lit(MONTH) - day + pay_day)


def paycycle_position(day: Column, pay_day: Column, frequency: Column) -> Column:
    """Share of the pay cycle that has passed, at most 1."""
    cycle = F.when(frequency == "monthly", float(MONTH)).otherwise(float(BIWEEK))
    return F.least(days_since_payday(day, pay_day) / cycle, F.lit(1.0))


def paycycle_zone(position: Column) -> Column:
    """Struct (label, level)."""
    chain = None
    for limit, label, level in ZONES:
        pair = F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"))
        chain = F.when(position <= limit, pair) if chain is None else chain.when(position <= limit, pair)
    return chain.otherwise(F.struct(F.lit(LAST_ZONE[0]).alias("label"), F.lit(LAST_ZONE[1]).alias("level")))


def expense_calendar(expenses: DataFrame, key: str = "account_id") -> DataFrame:
    """One row per key: expense sums by day of month (at most 31 entries) and their total.

    Folding the expenses into 31 day sums first turns the range joins on the
    day into one equi-join with a single small row per key.
    """
    by_day = expenses.groupBy(key, "day").agg(F.sum(T.as_cents_decimal(F.col("amount"))).alias("spent"))
    return by_day.groupBy(key).agg(
        F.collect_list(F.struct("day", "spent")).alias("calendar"), F.sum("spent").alias("total_expenses")
    )


def _calendar_sum(calendar: Column, keep) -> Column:
    kept = F.filter(calendar, keep)
    zero = F.lit(0).cast("decimal(38,2)")
    total = F.aggregate(kept, zero, lambda acc, entry: (acc + entry["spent"]).cast("decimal(38,2)"))
    return F.coalesce(total, zero).cast("double")


def expenses_before_day(calendar: Column, day: Column) -> Column:
    """Expenses due up to and including the day."""
    return _calendar_sum(calendar, lambda entry: entry["day"] <= day)


def expense_cluster(calendar: Column, day: Column, window: int = 3) -> Column:
    """Expenses at most ``window`` days away on a circular 30-day month."""

    def near(entry: Column) -> Column:
        distance = F.abs(entry["day"] - day)
        return F.least(distance, F.lit(MONTH) - distance) <= window

    return _calendar_sum(calendar, near)


def income_share(amount: Column, salary: Column) -> Column:
    """Share of the salary, at most 1; one half when the salary is unknown."""
    return F.when(salary > 0, F.least(amount / salary, F.lit(1.0))).otherwise(F.lit(0.5))


def renewal_risk(position: Column, cluster: Column, fail_rate: Column, load: Column) -> Column:
    """Score from 0 to 1, two decimals."""
    raw = W_PAYCYCLE * position + W_CLUSTER * cluster + W_HISTORY * fail_rate + W_LOAD * load
    return T.half_even(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-STEEPNESS) * (raw - CENTRE))), 2)


def risk_label(score: Column) -> Column:
    """Struct (label, level, advice) of the rounded score."""

    def triple(label: str, level: str, advice: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"), F.lit(advice).alias("advice"))

    chain = None
    for limit, *texts in RISK_LEVELS:
        chain = (
            F.when(score <= limit, triple(*texts)) if chain is None else chain.when(score <= limit, triple(*texts))
        )
    return chain.otherwise(triple(*LAST_RISK_LEVEL))


def renewal_loads(
    subscriptions: DataFrame, salary: DataFrame, expenses: DataFrame, key: str = "account_id"
) -> DataFrame:
    """Subscriptions of salaried keys with both expense sums around the renewal day."""
    pay = salary.select(key, F.col("amount").alias("salary"), "pay_day", "frequency")
    return (
        subscriptions.join(pay, key)
        .join(expense_calendar(expenses, key), key, "left")
        .withColumns(
            {
                "spent_before": expenses_before_day(F.col("calendar"), F.col("renewal_day")),
                "cluster_amount": expense_cluster(F.col("calendar"), F.col("renewal_day")),
            }
        )
        .drop("calendar", "total_expenses")
    )


def score_renewals(loads: DataFrame, key: str = "account_id") -> DataFrame:
    """Risk score, label and the factors behind them."""
    day, pay_day, pay = F.col("renewal_day"), F.col("pay_day"), F.col("salary")
    factors = loads.withColumns(
        {
            "paycycle_factor": paycycle_position(day, pay_day, F.col("frequency")),
            "cluster_factor": income_share(F.col("cluster_amount"), pay),
            "load_factor": income_share(F.col("spent_before"), pay),
        }
    )
    scored = factors.withColumn(
        "risk_score",
        renewal_risk(F.col("paycycle_factor"), F.col("cluster_factor"), F.col("fail_rate"), F.col("load_factor")),
    ).withColumns({"_label": risk_label(F.col("risk_score")), "_zone": paycycle_zone(F.col("paycycle_factor"))})
    return scored.select(
        key,
        F.col("name").alias("subscription"),
        "amount",
        "renewal_day",
        "risk_score",
        F.col("_label.label").alias("risk_label"),
        F.col("_label.level").alias("risk_level"),
        F.col("_label.advice").alias("advice"),
        F.format_string("%d/%d", "past_failures", "total_months").alias("fail_history"),
        F.struct(
            "paycycle_factor",
            "cluster_factor",
            "fail_rate",
            "load_factor",
            F.col("_zone.label").alias("zone_label"),
            F.col("_zone.level").alias("zone_level"),
            days_since_payday(day, pay_day).alias("days_since_payday"),
            days_until_payday(day, pay_day).alias("days_until_payday"),
            "cluster_amount",
        ).alias("breakdown"),
    )


def risk_report(
    subscriptions: DataFrame, salary: DataFrame, expenses: DataFrame, key: str = "account_id"
) -> DataFrame:
    """All renewals of salaried keys, riskiest first within a key (range-partitioned sort)."""
    scored = score_renewals(renewal_loads(subscriptions, salary, expenses, key), key)
    return scored.orderBy(key, F.desc("risk_score"), "subscription")


def paycycle_map(salary: DataFrame, subscriptions: DataFrame, key: str = "account_id") -> DataFrame:
    """Thirty days per salaried key: position, zone, pay-day flag and a renewal on that day."""
    days = salary.select(key, "pay_day", "frequency", F.explode(F.sequence(F.lit(1), F.lit(MONTH))).alias("day"))
    renewals = subscriptions.groupBy(key, F.col("renewal_day").alias("day")).agg(F.min("name").alias("subscription"))
    placed = days.withColumn("position", paycycle_position(F.col("day"), F.col("pay_day"), F.col("frequency")))
    return placed.join(renewals, [key, "day"], "left").select(
        key,
        "day",
        "position",
        paycycle_zone(F.col("position"))["level"].alias("zone"),
        (F.col("day") == F.col("pay_day")).alias("is_payday"),
        "subscription",
    )


def account_summary(
    risks: DataFrame, salary: DataFrame, expenses: DataFrame, key: str = "account_id"
) -> DataFrame:
    """Counts and totals per salaried key."""
    per_key = risks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_count"),
        F.sum(T.as_cents_decimal(F.col("amount"))).alias("_subs"),
    )
    spent = expenses.groupBy(key).agg(F.sum(T.as_cents_decimal(F.col("amount"))).alias("_spent"))
    zero = F.lit(0).cast("decimal(18,2)")
    joined = salary.select(key, F.col("amount").alias("salary")).join(per_key, key, "left").join(spent, key, "left")
    subs, out = F.coalesce("_subs", zero), F.coalesce("_spent", zero)
    return joined.select(
        key,
        F.coalesce("total_subscriptions", F.lit(0)).alias("total_subscriptions"),
        F.coalesce("high_risk_count", F.lit(0)).alias("high_risk_count"),
        subs.cast("double").alias("total_sub_cost"),
        out.cast("double").alias("total_expenses"),
        (T.as_cents_decimal(F.col("salary")) - out - subs).cast("double").alias("income_remaining"),
    )
