"""Salary, subscription and expense patterns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.operators.ordered import grouped

TOLERANCE = 0.05


def _within(amount: Column, leader: Column, tolerance: float) -> Column:
    return F.abs(amount - leader) / leader < tolerance


def _near(amounts: np.ndarray, leaders: np.ndarray, tolerance: float) -> np.ndarray:
    """Which amounts are close to one of the leaders, which come in order of size.

    The further below or above an amount a leader is, the larger the share it is off, so only its neighbours count.
    """
    near = np.zeros(len(amounts), bool)
    if len(leaders):
        above = np.searchsorted(leaders, amounts)
        for at in (above - 1, above):
            leader = leaders[at.clip(0, len(leaders) - 1)]
            near |= np.abs(amounts - leader) / leader < tolerance
    return near


def _new_leaders(amounts: np.ndarray, leaders: np.ndarray, tolerance: float) -> list[float]:
    """The amounts, in their order, that are close neither to ``leaders`` nor to an earlier one of these."""
    amounts = amounts[~_near(amounts, leaders, tolerance)]
    found = []
    while len(amounts):
        leader = amounts[0]
        found.append(float(leader))
        # The leader itself goes whatever the tolerance.
        amounts = amounts[1:][~(np.abs(amounts[1:] - leader) / leader < tolerance)]
    return found


def _leader_arrays(key: str, tolerance: float):
    """(key, leaders) from rows ordered by key and first_seq; held are the leaders and one table of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, leaders = None, None
        for rows, starts, goes_on in grouped(batches, [key]):
            owners = rows[key].take(pa.array(starts)).combine_chunks()
            amounts = rows["amount"].to_numpy()
            found = []
            for k, part in enumerate(np.split(amounts, starts[1:])):
                known = leaders if k == 0 and goes_on else []
                found.append(known + _new_leaders(part, np.sort(np.array(known, float)), tolerance))
            if not goes_on and leaders is not None:
                yield _batch(owner, [leaders])
            yield _batch(owners.slice(0, len(found) - 1), found[:-1])
            owner, leaders = owners.slice(len(found) - 1), found[-1]
        if leaders is not None:
            yield _batch(owner, [leaders])

    def _batch(owners: pa.Array, found: list[list[float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([owners, pa.array(found, pa.list_(pa.float64()))], [key, "leaders"])

    return work


def amount_leaders(credits: DataFrame, key: str = "account_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Ordered leader array per key, from positive ``credit`` values in ``seq`` order.

    An amount close to no leader becomes one.  Equal amounts always join the same leader, so the input shrinks to
    distinct amounts first (map-side combined).  Of these, a key's are worked off in tables: what is close to known
    leaders goes at once, by two look-ups in the ordered leaders; then the first that is left leads, and what it covers
    goes, until nothing is left.  Leaders differ by the tolerance and so are a few hundred per key whatever the data.
    """
    distinct = (
        credits.filter(F.col("credit") > 0)
        .groupBy(key, F.col("credit").alias("amount"))
        .agg(F.min("seq").alias("first_seq"))
    )
    kind = distinct.schema[key].dataType.simpleString()
    return (
        distinct.repartition(key)
        .sortWithinPartitions(key, "first_seq")
        .mapInArrow(_leader_arrays(key, tolerance), f"{key} {kind}, leaders array<double>")
    )


def cluster_amounts(credits: DataFrame, key: str = "account_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Clusters per key and day: ``leader_no, leader, date, occurrences, total``.

    The credits are pre-aggregated by (key, amount, date) before anything is
    joined, so repeated pay amounts of a hot account collapse map-side.
    """
    leaders = amount_leaders(credits, key, tolerance)
    daily = (
        credits.filter(F.col("credit") > 0)
        .groupBy(key, F.col("credit").alias("amount"), "date")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.sum(T.as_cents_decimal(F.col("credit"))).alias("total"))
    )
    position = F.array_position(
        F.transform("leaders", lambda leader: _within(F.col("amount"), leader, tolerance)), F.lit(True)
    ).cast("int")
    return (
        daily.join(leaders, key)
        .withColumn("leader_no", position)
        .withColumn("leader", F.element_at("leaders", F.col("leader_no")))
        .groupBy(key, "leader_no", "leader", "date")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("total").alias("total"))
    )


def cluster_totals(clusters: DataFrame, key: str = "account_id") -> DataFrame:
    """One row per cluster: size, total, first and last date and modal day of the month.

    Folded over the (at most 31) days of the month, so that no join is needed
    to bring the modal day back.
    """
    cluster = [key, "leader_no", "leader"]
    by_day = clusters.groupBy(*cluster, F.dayofmonth("date").alias("day")).agg(
        F.sum("occurrences").alias("occurrences"),
        F.sum("total").alias("total"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return by_day.groupBy(*cluster).agg(
        F.max_by("day", F.struct(F.col("occurrences"), -F.col("day"))).alias("pay_day"),
        F.sum("occurrences").alias("occurrences"),
        F.sum("total").alias("total"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def salary_group(totals: DataFrame, key: str = "account_id") -> DataFrame:
    """Best cluster with two or more members: most members, then largest total, then earliest."""
    rank = F.struct("occurrences", "total", -F.col("leader_no"))
    picked = F.struct("leader_no", "leader", "occurrences", "total", "first_date", "last_date", "pay_day")
    return (
        totals.filter(F.col("occurrences") >= 2)
        .groupBy(key)
        .agg(F.max_by(picked, rank).alias("_best"))
        .select(key, "_best.*")
    )


def modal_day(day_counts: DataFrame, keys: Sequence[str], day: str = "day", count: str = "charges") -> DataFrame:
    """Most frequent day of month per key; ties go to the smallest day.

    ``day_counts`` has at most 31 rows per key.
    """
    return day_counts.groupBy(*keys).agg(F.max_by(day, F.struct(count, -F.col(day))).alias("modal_day"))


def pay_frequency(first_date: Column, last_date: Column, occurrences: Column) -> Column:
    """``biweekly`` when the mean gap is at most 18 days, else ``monthly``.

    The mean of consecutive gaps telescopes to (last - first) / (n - 1).
    """
    mean_gap = F.datediff(last_date, first_date) / (occurrences - 1)
    return F.when((occurrences >= 2) & (mean_gap <= 18), F.lit("biweekly")).otherwise(F.lit("monthly"))


def detect_salary(tx: DataFrame, key: str = "account_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Salary pattern per key; keys without a repeated credit have no row."""
    best = salary_group(cluster_totals(cluster_amounts(tx, key, tolerance), key), key)
    return best.select(
        key,
        T.half_even(F.col("total").cast("double") / F.col("occurrences"), 2).alias("amount"),
        "pay_day",
        pay_frequency(F.col("first_date"), F.col("last_date"), F.col("occurrences")).alias("frequency"),
        "occurrences",
    )


def vendor_day_counts(tx: DataFrame, key: str = "account_id") -> DataFrame:
    """Charges and exact totals per (key, vendor, day of month): at most 31 rows per vendor."""
    return tx.groupBy(
        key, T.vendor_key(F.col("vendor_name")).alias("vendor"), F.dayofmonth("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("charges"), F.sum(T.as_cents_decimal(F.col("debit"))).alias("total"))


def _day_summary(day_counts: DataFrame, key: str) -> DataFrame:
    """Per vendor: mean amount, modal day and the day histogram, in one aggregation."""
    return day_counts.groupBy(key, "vendor").agg(
        F.sum("charges").alias("charges"),
        F.sum("total").alias("total"),
        F.max_by("day", F.struct(F.col("charges"), -F.col("day"))).alias("modal_day"),
        F.collect_list(F.struct("day", "charges")).alias("histogram"),
    )


def renewal_failures(histogram: Column, expected_day: Column, slack: int = 2) -> Column:
    """Charges more than ``slack`` days away from the expected day of the month."""
    return F.aggregate(
        histogram,
        F.lit(0).cast("bigint"),
        lambda total, bar: total
        + F.when(F.abs(bar["day"] - expected_day) > slack, bar["charges"]).otherwise(F.lit(0).cast("bigint")),
    )


def detect_subscriptions(classified: DataFrame, key: str = "account_id") -> DataFrame:
    """Subscription pattern per (key, vendor)."""
    summary = _day_summary(vendor_day_counts(classified.filter("is_subscription"), key), key)
    failures = renewal_failures(F.col("histogram"), F.col("modal_day"))
    return summary.withColumn("past_failures", failures).select(
        key,
        T.title_case(F.col("vendor")).alias("name"),
        T.half_even(F.col("total").cast("double") / F.col("charges"), 2).alias("amount"),
        F.col("modal_day").alias("renewal_day"),
        "past_failures",
        F.col("charges").alias("total_months"),
        (F.col("past_failures") / F.greatest(F.col("charges"), F.lit(1))).alias("fail_rate"),
    )


def detect_expenses(classified: DataFrame, key: str = "account_id") -> DataFrame:
    """Recurring expense pattern per (key, vendor)."""
    wanted = (
        F.col("category").isin(*R.EXPENSE_CATEGORIES) & F.col("is_recurring") & (F.col("debit") > 0)
    )
    summary = _day_summary(vendor_day_counts(classified.filter(wanted), key), key)
    return summary.select(
        key,
        T.title_case(F.col("vendor")).alias("name"),
        T.half_even(F.col("total").cast("double") / F.col("charges"), 2).alias("amount"),
        F.col("modal_day").alias("day"),
    )
