"""Calendar events and labelled training events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.operators.travel_features import combine_text

DAYS_PER_MONTH = 30.44
PREVIEW = 15

EVENT_SCHEMA = (
    "user_id bigint, event_id bigint, summary string, location string, description string, "
    "start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>"
)


def read_calendar_events(spark: SparkSession, path: str) -> DataFrame:
    """Calendar items from JSON files (schema given, so no inference pass)."""
    return flatten_events(spark.read.schema(EVENT_SCHEMA).json(path))


def flatten_events(items: DataFrame) -> DataFrame:
    """Nested items to text columns with their defaults."""

    def moment(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.dateTime"), F.col(f"{name}.date"), F.lit(""))

    return items.select(
        "user_id",
        "event_id",
        F.coalesce("summary", F.lit("No Title")).alias("summary"),
        moment("start").alias("start"),
        moment("end").alias("end"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def horizon_days(months: int) -> int:
    return int(months * DAYS_PER_MONTH)


def events_in_horizon(events: DataFrame, today: str, months: int = 6) -> DataFrame:
    """Events that start before the horizon and are not over today (plain range filters, pushed to the scan)."""
    now = F.to_date(F.lit(today))
    start, end = F.col("start_date"), F.col("end_date")
    return events.filter(
        (start < F.date_add(now, horizon_days(months))) & ((end > now) | (start >= now))
    )


def with_event_dates(events: DataFrame) -> DataFrame:
    """Typed dates from the first ten characters of the text moments."""
    return events.withColumns(
        {
            "start_date": F.substring("start", 1, 10).try_cast("date"),
            "end_date": F.substring("end", 1, 10).try_cast("date"),
        }
    )


def events_preview(events: DataFrame, n: int = PREVIEW, key: str = "user_id") -> DataFrame:
    """First n events per user by start; a missing start shows as ``?``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("start", "event_id"))
    shown = F.when(F.coalesce("start", F.lit("")) == "", "?").otherwise(F.substring("start", 1, 10))
    return (
        events.withColumn("position", nth)
        .filter(F.col("position") <= n)
        .select(key, "position", shown.alias("date"), "summary", "location")
    )


def labeled_events(rows: DataFrame) -> DataFrame:
    """Training rows: combined text, 0/1 label and trimmed trigger."""
    columns = ("event_summary", "event_location", "event_description")
    return rows.select(
        *[c for c in rows.columns if c == "event_id"],
        combine_text(*[F.coalesce(F.col(c), F.lit("")) for c in columns]).alias("text"),
        F.coalesce(F.col("is_travel").cast("string").try_cast("int"), F.lit(0)).alias("label"),
        T.strip(F.coalesce("trigger_type", F.lit(""))).alias("trigger_type"),
    )


def read_labeled_events(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Labelled training events from CSV with a header.

    Files are read in parts by many tasks; where quoted cells hold ``line_breaks``, a file is read by one.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)
    return labeled_events(reader.csv(path))
