"""What can be paused while a person is away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.operators import ordered as O

MIN_DAYS = 14

# Recommended actions and their texts.
PAUSE = ("PAUSE MEMBERSHIP", "Freeze your membership during this period.")
REJOIN = ("CANCEL & REJOIN", "Cancel before you leave, resubscribe when you return.")
REJOIN_PENALTY = ("CANCEL & REJOIN (WITH PENALTY)", "Rejoin fee is $%s, but you still save $%s net.")
CONSIDER = ("CONSIDER CANCELING", "Check with the provider about pause options.")
NO_ALTERNATIVES_TIP = "Could not find alternatives."


def away_days(departure: Column, back: Column, today: str) -> Column:
    """Days away from today on; 0 when the trip is over."""
    start = F.greatest(departure, F.to_date(F.lit(today)))
    return F.greatest(F.lit(0), F.datediff(back, start))


def trip_duration(departure: Column, back: Column) -> Column:
    return F.datediff(back, departure)


def local_split(subscriptions: DataFrame, key: str = "user_id") -> DataFrame:
    """Local and portable subscriptions per user."""
    local = F.coalesce(F.col("is_local"), F.lit(False))
    return subscriptions.groupBy(key).agg(
        F.count_if(local).alias("local_count"), F.count_if(~local).alias("portable_count")
    )


def savings_action(can_pause: Column, can_rejoin: Column, penalty: Column, net: Column) -> Column:
    """Struct (action, detail)."""

    def out(action: str, detail: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), detail.alias("detail"))

    pause, rejoin = F.coalesce(can_pause, F.lit(False)), F.coalesce(can_rejoin, F.lit(False))
    fee = F.format_string(REJOIN_PENALTY[1], T.money(penalty), T.money(net))
    return (
        F.when(pause, out(PAUSE[0], F.lit(PAUSE[1])))
        .when(rejoin & (penalty == 0), out(REJOIN[0], F.lit(REJOIN[1])))
        .when(rejoin & (net > penalty * 2), out(REJOIN_PENALTY[0], fee))
        .otherwise(out(CONSIDER[0], F.lit(CONSIDER[1])))
    )


def travel_savings(
    subscriptions: DataFrame, away: DataFrame, today: str, key: str = "user_id", min_days: int = MIN_DAYS
) -> DataFrame:
    """Net savings per local subscription and long away period of the same user.

    Both sides are filtered before the equi-join.  Merged periods of a user do
    not overlap and last ``min_days`` or more, so a user has at most
    (calendar span / min_days) of them and the output stays a small multiple
    of the subscriptions.
    """
    local = subscriptions.filter(F.col("is_local") & (F.col("monthly_cost") > 0)).select(
        key,
        F.col("name").alias("subscription"),
        "location_type",
        "can_pause",
        "can_cancel_and_rejoin",
        F.col("monthly_cost").cast("double").alias("monthly_cost"),
        F.coalesce(F.col("cancellation_penalty").cast("double"), F.lit(0.0)).alias("penalty"),
    )
    long_trips = away.withColumn(
        "days_away", away_days(F.col("departure_date"), F.col("return_date"), today)
    ).filter(F.col("days_away") >= min_days)
    gross = F.col("monthly_cost") / 30.0 * F.col("days_away")
    paired = (
        local.join(long_trips, key)
        .withColumn("potential_savings", gross)
        .withColumn("net_savings", F.col("potential_savings") - F.col("penalty"))
        .filter(F.col("net_savings") > 0)
    )
    action = savings_action(
        F.col("can_pause"), F.col("can_cancel_and_rejoin"), F.col("penalty"), F.col("net_savings")
    )
    return paired.withColumn("_action", action).select(
        key,
        "subscription",
        F.col("reason").alias("away_reason"),
        "departure_date",
        "return_date",
        F.coalesce("destination", F.lit("Unknown")).alias("destination"),
        "days_away",
        F.ceil(F.col("days_away") / 30.0).cast("int").alias("months_away"),
        "monthly_cost",
        "potential_savings",
        "penalty",
        "net_savings",
        F.col("_action.action").alias("action"),
        F.col("_action.detail").alias("action_detail"),
        F.coalesce("location_type", F.lit("unknown")).alias("location_type"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
    )


def total_savings(recommendations: DataFrame, key: str = "user_id") -> DataFrame:
    """Sum of the rounded net savings per user."""
    return recommendations.groupBy(key).agg(
        F.sum(T.as_cents_decimal(T.half_even(F.col("net_savings"), 2))).cast("double").alias("total_savings"),
        F.count(F.lit(1)).alias("recommendations"),
    )


def with_search_term(subscriptions: DataFrame, column: str = "term") -> DataFrame:
    """What to look for at the destination; null for portable services."""
    name, location_type = F.col("name"), F.col("location_type")
    physical = T.first_rule("_low", R.ALTERNATIVE_SEARCH_TERMS["physical"])
    regional = T.first_rule("_low", R.ALTERNATIVE_SEARCH_TERMS["regional_service"])
    term = F.when(
        location_type == "physical", F.coalesce(physical, F.concat(F.lit("alternatives to "), name))
    ).when(
        location_type == "regional_service",
        F.coalesce(regional, F.concat(F.lit("visitor "), name, F.lit(" options"))),
    )
    return subscriptions.withColumn("_low", F.lower("name")).withColumn(column, term).drop("_low")


def pairs_in_slots(
    recommendations: DataFrame, alternatives: DataFrame, eligible: Column, hot_rows: int = O.HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_slot``: a pair of over ``hot_rows`` recommendations is dealt over as many slots as needed.

    The slot of a recommendation follows from its content, and the one alternative of a heavy pair is repeated for each
    of its slots.  At most rows / ``hot_rows`` pairs can be heavy, which bounds the broadcast.  Rows that are not
    ``eligible`` find nothing; they spread over all tasks.
    """
    keys = ["subscription", "destination"]
    # Content without maps, which have no hash.
    content = F.xxhash64(*[c for c, kind in recommendations.dtypes if "map<" not in kind])
    heavy = (
        recommendations.filter(eligible).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("bigint").alias("_slots"))
    )
    dealt = F.when(~F.coalesce(eligible, F.lit(False)), F.pmod(content, F.lit(1 << 30)) + 1).otherwise(
        F.when(F.col("_slots").isNull(), F.lit(0)).otherwise(F.pmod(content, F.col("_slots")))
    )
    left = recommendations.join(F.broadcast(heavy), keys, "left")
    left = left.withColumn("_slot", dealt.cast("bigint")).drop("_slots")
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_slots"), F.lit(1)) - 1)
    right = alternatives.join(F.broadcast(heavy), keys, "left").withColumn("_slot", F.explode(every)).drop("_slots")
    return left, right


def attach_alternatives(
    recommendations: DataFrame, alternatives: DataFrame, hot_rows: int = O.HOT_ROWS
) -> DataFrame:
    """Add the options found for (subscription, destination), or a "not found" record.

    Only recommendations with a known destination and a service that does not
    travel along get a record.  ``alternatives`` has columns ``subscription,
    destination, options, best_value_option, tip``, one row per pair.  A pair
    that very many recommendations share is joined in slots.
    """
    eligible = (F.col("destination") != "") & (F.col("destination") != "Unknown") & (
        F.col("location_type") != "portable"
    )
    left, right = pairs_in_slots(recommendations, alternatives, eligible, hot_rows)
    joined = left.join(right.withColumn("_found", F.lit(True)), ["subscription", "destination", "_slot"], "left")
    hit = F.coalesce(F.col("_found"), F.lit(False))
    record = F.struct(
        hit.alias("alternatives_found"),
        F.when(hit, F.col("options")).otherwise(F.slice("options", 1, 0)).alias("options"),
        F.when(hit, F.col("best_value_option")).alias("best_value_option"),
        F.when(hit, F.col("tip")).otherwise(F.lit(NO_ALTERNATIVES_TIP)).alias("tip"),
    )
    return joined.withColumn("alternatives", F.when(eligible, record)).drop(
        "_found", "_slot", "options", "best_value_option", "tip"
    )


def cheapest_option(options: Column) -> Column:
    """Lowest positive monthly cost among the options."""
    return F.array_min(
        F.filter(F.transform(options, lambda o: o["estimated_monthly_cost"]), lambda cost: cost > 0)
    )


def alternative_cost(with_alternatives: DataFrame) -> DataFrame:
    """Cost of the cheapest alternative over the trip and what then remains of the savings."""
    priced = with_alternatives.withColumn("cheapest_monthly", cheapest_option(F.col("alternatives.options")))
    cost = F.col("cheapest_monthly") * F.col("months_away")
    return priced.withColumns(
        {"alternative_total": cost, "net_after_alternative": F.col("potential_savings") - cost}
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows per key with their position and the number of rows left out.

    ``row_number <= n`` becomes a group limit below the shuffle, and the count
    is a separate map-side combined aggregation, so no task sees a whole key.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("position", position).filter(F.col("position") <= n)
    sizes = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return kept.join(sizes, list(keys))
