"""Report documents and flat exports.

A report has one header document per account or user, with what its meaning bounds (a salary, the days of a
month, vendors, categories, subscriptions), and one document per calendar month with what time keeps adding:
transactions, price changes, travel recommendations.  The rule is the same for every account, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.operators.travel_model import TravelModel, evaluate_model

HEADER = ""  # the month of a header document
ROWS_PER_TASK = 250_000  # transactions that a task gathers into documents, on average


def transaction_export(classified: DataFrame, key: str = "account_id") -> DataFrame:
    """Flat list of transactions with ISO date text."""
    return classified.select(
        key, F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "debit", "credit", "category",
        "vendor_name", "is_subscription",
    )


def section(
    rows: DataFrame, key: str, name: str, entry: Column, order: Sequence[str], month: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """(key, month, name): sorted entries, in the header or by calendar month.

    With ``parts`` they are gathered by so many tasks; else Spark merges tasks by their compressed size, and entries that
    repeat themselves are a hundred times larger in memory.
    """
    sort_key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)

    rows = rows.withColumn("_month", F.lit(HEADER) if month is None else month)
    if parts is not None:
        rows = rows.repartition(parts, key, "_month")
    return (
        rows.groupBy(key, F.col("_month").alias("month"))
        .agg(F.array_sort(F.collect_list(F.struct(sort_key.alias("k"), entry.alias("e"))), by_key).alias("_sorted"))
        .select(key, "month", F.col("_sorted.e").alias(name))
    )


def single(rows: DataFrame, key: str, name: str, entry: Column) -> DataFrame:
    """(key, header, name) for sections with one record per key."""
    return rows.select(key, F.lit(HEADER).alias("month"), entry.alias(name))


def month_of(day: str) -> Column:
    return F.date_format(F.col(day).cast("date"), "yyyy-MM")


def assemble_document(sections: Sequence[DataFrame], key: str) -> DataFrame:
    """All sections side by side, one row per key and month (one shuffle, no chain of joins)."""
    together = sections[0]
    for more in sections[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    names = [c for c in together.columns if c not in (key, "month")]
    return together.groupBy(key, "month").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def statement_report(
    classified: DataFrame,
    salary: DataFrame,
    expenses: DataFrame,
    risks: DataFrame,
    cycle: DataFrame,
    changes: DataFrame,
    predictions: DataFrame,
    summary: DataFrame,
    categories: DataFrame,
    key: str = "account_id",
    parts: int | None = None,
) -> DataFrame:
    """One nested header document per account, and one per month with transactions and price changes.

    Accounts without a salary keep their other sections.  ``parts`` tasks gather the transactions.
    """

    def record(df: DataFrame) -> Column:
        return F.struct(*[c for c in df.columns if c != key])

    def listed(df: DataFrame, name: str, order: Sequence[str], month: Column | None = None) -> DataFrame:
        return section(df, key, name, record(df), order, month)

    export = classified.select(key, "seq", *[c for c in transaction_export(classified, key).columns if c != key])
    export = export.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    tx_record = F.struct(*[c for c in export.columns if c not in (key, "seq")])
    risk_rows = risks.withColumn("_low_first", -F.col("risk_score"))
    sections = [
        single(salary, key, "salary", record(salary)),
        single(summary, key, "summary", record(summary)),
        listed(categories, "categories", ["category"]),
        section(risk_rows, key, "subscriptions", record(risks), ["_low_first", "subscription"]),
        listed(expenses, "expenses", ["name"]),
        listed(cycle, "paycycle_map", ["day"]),
        section(export, key, "transactions", tx_record, ["seq"], month_of("date"), parts),
        listed(changes, "price_changes", ["date", "subscription", "type", "new_amount"], month_of("date")),
        listed(predictions, "renewal_predictions", ["days_until_charge", "subscription"]),
    ]
    return assemble_document(sections, key)


def usage_report(
    nested: DataFrame, portfolio: DataFrame, insights: DataFrame, alerts: DataFrame, key: str = "user_id"
) -> DataFrame:
    """Verdicts, portfolio with its categories, count and exam alert per user."""

    def record(df: DataFrame) -> Column:
        return F.struct(*[c for c in df.columns if c != key])

    counts = portfolio.select(key, F.col("subscriptions").alias("count"))
    insight_rows = insights.withColumn("_high_first", -F.col("total_monthly_cost"))
    sections = [
        section(nested, key, "results", record(nested), ["app_name"]),
        single(portfolio, key, "portfolio", record(portfolio)),
        section(insight_rows, key, "category_insights", record(insights), ["_high_first", "category"]),
        single(counts, key, "count", F.col("count")),
        single(alerts, key, "exam_alert", record(alerts)),
    ]
    return assemble_document(sections, key)


def travel_report(
    events: DataFrame,
    preview: DataFrame,
    away: DataFrame,
    subscriptions: DataFrame,
    recommendations: DataFrame,
    totals: DataFrame,
    split: DataFrame,
    key: str = "user_id",
) -> DataFrame:
    """Events scanned, preview, away periods, subscriptions and totals per user; recommendations by month of departure."""

    def record(df: DataFrame) -> Column:
        return F.struct(*[c for c in df.columns if c != key])

    scanned = events.groupBy(key).agg(F.count(F.lit(1)).alias("events_scanned"))
    sections = [
        single(scanned, key, "events_scanned", F.col("events_scanned")),
        section(preview, key, "events_preview", record(preview), ["position"]),
        section(away, key, "away_periods", record(away), ["departure_date", "reason"]),
        section(subscriptions, key, "processed_subscriptions", record(subscriptions), ["name"]),
        section(
            recommendations, key, "recommendations", record(recommendations),
            ["subscription", "departure_date"], month_of("departure_date"),
        ),
        single(totals, key, "total_savings", F.col("total_savings")),
        single(split, key, "local_count", F.col("local_count")),
        single(split, key, "portable_count", F.col("portable_count")),
    ]
    return assemble_document(sections, key)


def evaluation_report(scored: DataFrame, model: TravelModel, cv: tuple[float, float] | None = None) -> DataFrame:
    """Model metrics as one table, ready for ``write.json``."""
    metrics = evaluate_model(scored)
    extra = {
        "total_features": F.lit(len(model.travel.featureImportances.toArray())),
        "cv_accuracy_mean": F.lit(cv[0] if cv else None).cast("double"),
        "cv_accuracy_std": F.lit(cv[1] if cv else None).cast("double"),
    }
    return metrics.withColumns(extra)


def write_documents(documents: DataFrame, path: str, fmt: str = "json") -> None:
    """Write documents as JSON lines (or any built-in format): headers and months below ``path``, months by partition.

    Writing is idempotent: headers are replaced, and so is each month that the documents hold; other months stay as they
    are.  So a rerun over one month's rows rewrites that month alone.
    """
    headers = documents.filter(F.col("month") == HEADER).drop("month")
    headers.write.mode("overwrite").format(fmt).save(f"{path}/headers")
    months = documents.filter(F.col("month") != HEADER)
    by_month = months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month")
    by_month.format(fmt).save(f"{path}/months")


def read_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The documents of :func:`write_documents`, headers with an empty month."""
    headers = spark.read.format(fmt).load(f"{path}/headers").withColumn("month", F.lit(HEADER))
    months = spark.read.format(fmt).load(f"{path}/months").withColumn("month", F.col("month").cast("string"))
    return headers.unionByName(months, allowMissingColumns=True)
