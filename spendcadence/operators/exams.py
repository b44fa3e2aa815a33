"""Exam-season advice for students."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.functions.fence import compute_once

# Message texts.
NOTHING_TO_PAUSE = (
    "📚 %d exam(s) detected in the next 30 days, but none of your subscriptions are entertainment or gaming."
)
PAUSE = (
    "🎓 %d exam(s) detected in the next 30 days. Consider pausing %s to save $%s/mo during this period."
)


def match_exam_events(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events whose summary or description holds an exam keyword; the first keyword in list order is kept."""
    combined = F.concat(
        F.lower(F.coalesce("summary", F.lit(""))), F.lit(" "), F.lower(F.coalesce("description", F.lit("")))
    )
    keyword = T.first_rule("_text", [(word, word) for word in R.EXAM_KEYWORDS])
    return (
        compute_once(events.withColumn("_text", combined), {"keyword_matched": keyword}, drop=("_text",))
        .filter(F.col("keyword_matched").isNotNull())
        .select(
            key, "event_id", F.coalesce("summary", F.lit("Unnamed Event")).alias("name"),
            F.col("start").alias("date"), "keyword_matched",
        )
    )


def pausable_subscriptions(verdicts: DataFrame, key: str = "user_id") -> DataFrame:
    """Entertainment and gaming subscriptions with their monthly burden."""
    return verdicts.filter(F.col("category").isin(*R.PAUSABLE_CATEGORIES)).select(
        key, F.col("app_name").alias("name"), "category", F.col("personal_burden").alias("monthly_cost")
    )


def exam_alert(exams: DataFrame, pausable: DataFrame, students: DataFrame, key: str = "user_id") -> DataFrame:
    """Advice per student with at least one exam.

    The exams collapse to a count; the names in the text are one per app a
    student holds.
    """
    counted = exams.groupBy(key).agg(F.count(F.lit(1)).alias("exam_count"))
    saved = pausable.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"),
        F.count(F.lit(1)).alias("pausable_count"),
        F.sum(F.col("monthly_cost").cast("decimal(28,10)")).alias("_saved"),
    )
    total = F.coalesce(F.col("_saved").cast("double"), F.lit(0.0))
    return (
        counted.join(students.select(key).distinct(), key, "left_semi")
        .join(saved, key, "left")
        .select(
            key,
            F.lit(True).alias("exam_detected"),
            "exam_count",
            F.coalesce("pausable_count", F.lit(0)).alias("pausable_count"),
            total.alias("total_monthly_savings"),
            F.when(F.col("names").isNull(), F.format_string(NOTHING_TO_PAUSE, "exam_count"))
            .otherwise(F.format_string(PAUSE, "exam_count", "names", T.money(total)))
            .alias("message"),
        )
    )
