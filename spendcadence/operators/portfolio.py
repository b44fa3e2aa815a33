"""Overlap between a user's subscriptions, category by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.operators import ordered as O

# Fixed value: recommendation text.
ADVICE = (
    "You have %d %s subscriptions costing $%s/mo total. %s is your best value at $%s/hr. "
    "Dropping %s alone saves $%s/mo ($%s/yr)."
)

EXACT = "decimal(28,10)"


def category_totals(verdicts: DataFrame, key: str = "user_id") -> DataFrame:
    """Per user and category: count, cost, hours, best and worst value.

    Best and worst are aggregates (least and greatest cost per hour, then
    name), so no ranking window is needed and the work combines map-side.
    """
    place = F.struct("cph", "app_name")
    entry = F.struct(F.col("app_name").alias("name"), "cph", "personal_burden")
    return verdicts.groupBy(key, "category").agg(
        F.count(F.lit(1)).alias("subscription_count"),
        # Kept below 38 digits: a wider type would lose scale in the subtraction that follows.
        F.sum(F.col("personal_burden").cast(EXACT)).cast("decimal(30,10)").alias("_cost"),
        F.sum(F.col("raw_hours").cast(EXACT)).cast("decimal(30,10)").alias("_hours"),
        F.min_by(entry, place).alias("best_value"),
        F.max_by(entry, place).alias("worst_value"),
    )


def category_saturation(verdicts: DataFrame, key: str = "user_id") -> DataFrame:
    """Categories in which a user holds two or more subscriptions."""
    return (
        category_totals(verdicts, key)
        .filter(F.col("subscription_count") >= 2)
        .withColumns(
            {
                "total_monthly_cost": F.col("_cost").cast("double"),
                "total_weekly_hours": F.col("_hours").cast("double"),
            }
        )
    )


def rank_by_value(verdicts: DataFrame, key: str = "user_id", hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """Rank in saturated categories by cost per hour (then name), best and worst flags.

    A user with very many apps in one category is cut at seams drawn from the
    apps' own (cost, name), so apps of equal cost are split by their names.
    """
    keys = [key, "category"]
    counts = verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("subscription_count"))
    saturated = verdicts.join(counts.filter(F.col("subscription_count") >= 2), keys)
    ranked = O.with_split_rank(saturated, keys, ["cph", "app_name"], "rank", hot_rows)
    return ranked.select(
        key,
        "category",
        "app_name",
        "rank",
        "cph",
        F.when(F.col("is_presence"), "day").otherwise("hour").alias("unit"),
        F.col("personal_burden").alias("monthly_cost"),
        "raw_hours",
        "action",
        (F.col("rank") == 1).alias("is_best_value"),
        (F.col("rank") == F.col("subscription_count")).alias("is_worst_value"),
    )


def consolidation_savings(saturation: DataFrame) -> DataFrame:
    """Monthly and yearly savings of dropping the worst, or keeping only the best."""
    drop = F.col("worst_value.personal_burden")
    keep = (F.col("_cost") - F.col("best_value.personal_burden").cast(EXACT)).cast("double")
    return saturation.withColumns(
        {
            "savings_drop_worst": drop,
            "savings_drop_worst_annual": drop * 12,
            "savings_keep_best_only": keep,
            "savings_keep_best_only_annual": keep * 12,
        }
    )


def category_insight(verdicts: DataFrame, key: str = "user_id") -> DataFrame:
    """One record per saturated category with label and recommendation."""
    saved = consolidation_savings(category_saturation(verdicts, key))
    label = F.regexp_replace("category", "_", " ")
    drop = F.col("savings_drop_worst")
    return saved.withColumns(
        {
            "category_label": T.title_case(label),
            "is_saturated": F.lit(True),
            "recommendation": F.format_string(
                ADVICE,
                "subscription_count",
                label,
                T.money(F.col("total_monthly_cost")),
                F.col("best_value.name"),
                T.money(F.col("best_value.cph")),
                F.col("worst_value.name"),
                T.money(drop),
                T.money(drop * 12),
            ),
        }
    ).drop("_cost", "_hours")


def portfolio_summary(verdicts: DataFrame, insights: DataFrame, key: str = "user_id") -> DataFrame:
    """Saturated categories and potential savings per user; zeros for users without any."""
    users = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("subscriptions"))
    saved = insights.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(T.as_cents_decimal(T.half_even(F.col("savings_drop_worst"), 2))).alias("_saved"),
    )
    zero = F.lit(0).cast("decimal(28,2)")
    monthly = F.coalesce("_saved", zero)
    return users.join(saved, key, "left").select(
        key,
        "subscriptions",
        F.coalesce("_n", F.lit(0)).alias("saturated_categories"),
        monthly.cast("double").alias("total_potential_savings_monthly"),
        (monthly * 12).cast("double").alias("total_potential_savings_annual"),
    )
