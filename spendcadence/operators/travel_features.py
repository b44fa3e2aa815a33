"""Calendar events: text features, destination, trigger, merged away periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.functions.fence import compute_once

GAP_DAYS = 3
UNKNOWN = "Unknown"

FEATURES = [
    "travel_keyword_count",
    "has_travel_keyword",
    "local_keyword_count",
    "has_local_keyword",
    "has_airport_code",
    "has_flight",
    "has_foreign_country",
    "has_accommodation",
    "has_travel_docs",
    "text_length",
    "travel_ratio",
]

# Patterns of destinations.
TO_PLACE = r"\bto\s+([A-Z][a-zA-Z\s,]+)"
IN_PLACE = r"\bin\s+([A-Z][a-zA-Z\s,]+)"
NAMED_PLACE = r"(?:destination|location|at|visiting)\s*:?\s*([A-Z][a-zA-Z\s,]+)"


def combine_text(summary: Column, location: Column, description: Column) -> Column:
    """Non-empty parts joined by a blank, lower-cased."""
    parts = [F.when(part != "", T.strip(part)) for part in (summary, location, description)]
    return F.lower(F.concat_ws(" ", *parts))


def _word_pattern(words: list[str]) -> str:
    """Any of the words between characters that are neither letters, digits nor underscore."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def _token_pattern(words: list[str]) -> str:
    """Any of the words between white space."""
    return r"(^|\s)(" + "|".join(words) + r")($|\s)"


def event_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Eleven numeric features of a lower-cased event text."""
    t = F.col("_low")
    codes = [code.lower() for code in R.AIRPORT_CODES]

    def flag(test: Column) -> Column:
        return test.cast("int")

    counted = df.withColumn("_low", F.lower(text)).withColumns(
        {
            "travel_keyword_count": T.count_contained("_low", R.TRAVEL_KEYWORDS),
            "local_keyword_count": T.count_contained("_low", R.LOCAL_KEYWORDS),
        }
    )
    travel, local = F.col("travel_keyword_count"), F.col("local_keyword_count")
    return counted.withColumns(
        {
            "has_travel_keyword": flag(travel > 0),
            "has_local_keyword": flag(local > 0),
            "has_airport_code": flag(t.rlike(_token_pattern(codes))),
            "has_flight": flag(T.contains_any("_low", R.FLIGHT_WORDS)),
            "has_foreign_country": flag(t.rlike(_word_pattern(R.FOREIGN_COUNTRIES))),
            "has_accommodation": flag(T.contains_any("_low", R.ACCOMMODATION_WORDS)),
            "has_travel_docs": flag(T.contains_any("_low", R.TRAVEL_DOCUMENT_WORDS)),
            "text_length": F.length(F.col(text)),
            "travel_ratio": travel / F.greatest(travel + local, F.lit(1)),
        }
    ).drop("_low")


def trigger_type(text: str = "text", predicted: Column | None = None) -> Column:
    """First keyword group found in a lower-case text, then a model's answer, then ``other``."""
    chain = None
    for label, words in R.TRIGGER_GROUPS:
        test = T.contains_any(text, words)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    fallback = F.lit("other") if predicted is None else F.coalesce(predicted, F.lit("other"))
    return F.coalesce(chain, fallback)


def with_destination(events: DataFrame, name: str = "destination") -> DataFrame:
    """A real-looking location, else a capitalised place in the texts, else ``Unknown``."""
    trimmed = {
        f"_{c}": T.strip(F.coalesce(c, F.lit(""))) for c in ("summary", "location", "description")
    }
    staged = events.withColumns(trimmed).withColumn("_where", F.lower("_location"))
    place, head, body = F.col("_location"), F.col("_summary"), F.col("_description")

    def after(text: Column, pattern: str) -> Column:
        found = F.regexp_replace(T.strip(F.regexp_extract(text, pattern, 1)), ",+$", "")
        return F.when(F.length(found) > 2, found)

    def named(text: Column) -> Column:
        return T.blank_to_null(F.regexp_extract(text, NAMED_PLACE, 1))

    found = F.coalesce(
        F.when((place != "") & ~T.contains_any("_where", R.VIRTUAL_LOCATION_WORDS), place),
        after(head, TO_PLACE),
        after(head, IN_PLACE),
        named(body),
        named(head),
        F.lit(UNKNOWN),
    )
    return compute_once(staged, {name: found}, drop=(*trimmed, "_where"))


def confidence_label(probability: Column) -> Column:
    return F.when(probability >= 0.85, "high").when(probability >= 0.60, "medium").otherwise("low")


def _confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)


def merge_away_periods(away: DataFrame, key: str = "user_id", gap_days: int = GAP_DAYS) -> DataFrame:
    """Merge periods of a user that overlap or lie at most ``gap_days`` apart.

    Input: ``key, seq, reason, departure_date, return_date, destination,
    trigger_type, confidence``.  Everything an island needs combines from its
    start days, so the events first collapse to one row per (user, start day),
    map-side.  The window then sees at most one row per calendar day.  Rows
    without both dates stay periods of their own.
    """
    dated = F.col("departure_date").isNotNull() & F.col("return_date").isNotNull()
    earlier = F.struct(F.lit(0) - F.unix_date("departure_date"), F.lit(0) - F.col("seq"))
    best = F.struct("reason", "trigger_type", "confidence")
    best_rank = F.struct(_confidence_rank(F.col("confidence")).alias("rank"), earlier.alias("earlier"))
    known = F.when(F.col("destination") != UNKNOWN, F.col("seq"))
    daily = (
        away.filter(dated)
        .groupBy(key, "departure_date")
        .agg(
            F.max(F.greatest("return_date", "departure_date")).alias("return_date"),
            F.max_by(best, best_rank).alias("best"),
            F.max(best_rank).alias("best_rank"),
            F.min_by("destination", known).alias("destination"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    timeline = Window.partitionBy(key).orderBy("departure_date")
    reach = F.max("return_date").over(timeline.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        daily.withColumn("_reach", reach)
        .withColumn(
            "_new",
            F.when(F.datediff("departure_date", "_reach") <= gap_days, 0).otherwise(1),
        )
        .withColumn("_island", F.sum("_new").over(timeline))
    )
    known_day = F.when(F.col("destination").isNotNull(), F.col("departure_date"))
    merged = (
        islands.groupBy(key, "_island")
        .agg(
            F.min("departure_date").alias("departure_date"),
            F.max("return_date").alias("return_date"),
            F.max_by("best", "best_rank").alias("best"),
            F.coalesce(F.min_by("destination", known_day), F.lit(UNKNOWN)).alias("destination"),
            F.sum("events").alias("events"),
        )
        .select(key, "best.reason", "departure_date", "return_date", "destination", "best.trigger_type",
                "best.confidence", "events")
    )
    undated = away.filter(~dated).select(
        key, "reason", "departure_date", "return_date", "destination", "trigger_type", "confidence",
        F.lit(1).cast("bigint").alias("events"),
    )
    return merged.unionByName(undated)


def travel_to_away(travel: DataFrame, today: str, key: str = "user_id") -> DataFrame:
    """Travel events (with ``text`` and, if a model ran, ``predicted_trigger`` and ``probability``) as away rows."""
    predicted = F.col("predicted_trigger") if "predicted_trigger" in travel.columns else None
    confidence = (
        confidence_label(F.col("probability")) if "probability" in travel.columns else F.col("confidence")
    )
    dated = T.with_event_date(T.with_event_date(travel, "start", "_from", today), "end", "_to", today)
    dated = with_destination(dated)
    return dated.select(
        key,
        F.col("event_id").alias("seq"),
        F.coalesce("summary", F.lit("Unknown travel event")).alias("reason"),
        F.col("_from").try_cast("date").alias("departure_date"),
        F.col("_to").try_cast("date").alias("return_date"),
        "destination",
        trigger_type("text", predicted).alias("trigger_type"),
        confidence.alias("confidence"),
    )
