"""App profiles: raw model replies, defaults and the catalog join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.operators import usage as U

REPLY_SCHEMA = (
    "frequency string, category string, value_mode string, engagement_type string, is_multi_device boolean, "
    "has_free_tier boolean, is_shared_plan boolean, student_plan_price double, pricing_verified boolean, "
    "pricing_tiers map<string,string>"
)

# The profile of an app nothing is known about.
DEFAULT_PROFILE = {
    "frequency": "monthly",
    "category": "entertainment",
    "value_mode": "time_based",
    "engagement_type": "active",
    "is_multi_device": False,
    "has_free_tier": False,
    "is_shared_plan": False,
    "student_plan_price": 0.0,
    "pricing_verified": False,
    "monthly_price": 0.0,
    "yearly_price": 0.0,
    "lifetime_price": 0.0,
}

# The classification of a subscription nothing is known about.
PORTABLE_DEFAULT = {
    "is_local": False,
    "location_type": "portable",
    "can_pause": False,
    "can_cancel_and_rejoin": True,
    "cancellation_penalty": 0.0,
}


def strip_fences(reply: Column) -> Column:
    """Drop an opening ``` or ```json fence and a closing one."""
    opened = F.regexp_replace(T.strip(reply), r"^```(json)?", "")
    return T.strip(F.regexp_replace(opened, r"```$", ""))


def decode_profile_json(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Flat profile columns of a raw reply; ``decoded`` is false for unusable text."""
    parsed = replies.withColumn("_profile", F.from_json(strip_fences(F.col(reply)), REPLY_SCHEMA))
    tiers = {f"{plan}_price": F.element_at(F.col("_profile.pricing_tiers"), F.lit(plan)) for plan in U.PLANS}
    plain = [c for c in DEFAULT_PROFILE if not c.endswith("_price") or c == "student_plan_price"]
    return parsed.select(
        *[c for c in replies.columns if c != reply],
        F.col("_profile.frequency").isNotNull().alias("decoded"),
        *[F.col(f"_profile.{c}").alias(c) for c in plain],
        *[U.coerce_price(text).alias(name) for name, text in tiers.items()],
    )


def apply_defaults(profiles: DataFrame) -> DataFrame:
    """Fill every missing profile field with its default."""
    return profiles.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_PROFILE.items()})


def verify_profiles(profiles: DataFrame, cost: str = "cost") -> DataFrame:
    """Check claimed prices against the price that is paid."""
    checked = U.verify_pricing(
        F.coalesce("pricing_verified", F.lit(False)), F.col(cost),
        F.col("monthly_price"), F.col("yearly_price"), F.col("lifetime_price"),
    )
    return profiles.withColumn("_checked", checked).withColumns(
        {
            "pricing_verified": F.col("_checked.pricing_verified"),
            **{f"{plan}_price": F.col(f"_checked.{plan}") for plan in U.PLANS},
        }
    ).drop("_checked")


def attach_profiles(usage: DataFrame, catalog: DataFrame, on: str = "app_name") -> DataFrame:
    """Left join of the catalog by app name; unknown apps get the default profile.

    No broadcast hint: the planner broadcasts the catalog when its measured
    size allows and falls back to a skew-aware shuffle join when it does not.
    """
    columns = [on, *DEFAULT_PROFILE]
    return apply_defaults(usage.join(catalog.select(*columns), on, "left"))


def attach_locality(subscriptions: DataFrame, classified: DataFrame, on: str = "name") -> DataFrame:
    """Left join of subscription classifications; unknown ones count as portable."""
    joined = subscriptions.join(classified.select(on, *PORTABLE_DEFAULT), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in PORTABLE_DEFAULT.items()})
