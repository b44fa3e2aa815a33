"""Is a subscription worth its cost?  Usage series, plan pricing and a verdict.

Series have a fixed, small length, so every series function takes the list of
its weekly columns and unrolls into plain arithmetic: the whole evaluation is
one code-generated projection after the catalog join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import text as T

WEEKS = 4

# Model constants.
GAMMA = {"utility": 0.05, "productivity": 0.10, "entertainment": 0.20, "gaming": 0.35}
DEFAULT_GAMMA = 0.20
CYCLE_MONTHS = {"weekly": 0.23, "monthly": 1.0, "quarterly": 3.0, "biannual": 6.0, "yearly": 12.0}
ENGAGEMENT_WEIGHT = {"passive": 0.33, "active": 1.0, "generative": 1.5}
PRIORITY = {"productivity": 1.2, "utility": 1.1, "entertainment": 0.8, "gaming": 0.7}
BUDGET_STYLE = {"strict": 0.07, "balanced": 0.10, "lenient": 0.15}
EMA_ALPHA = 0.3
UNUSED_COST = 9999.99
PRESENCE_DAYS = 30.0
DISCOUNT_RATE = 0.005
HORIZONS = [(0.3, 3), (0.5, 6), (0.8, 12)]
LAST_HORIZON = 36
PLANS = ["monthly", "yearly", "lifetime"]

# Reason texts.
REASON = {
    "unused": "Zero usage detected in the tracking period.",
    "verify": "Low confidence in screen-time data. Verify actual usage before canceling.",
    "cliff": "CUSUM detected a significant usage drop (magnitude: %sσ). Monitor closely — this may indicate "
    "you're about to stop using %s.",
    "binge": "Statistical binge detected — usage is heavily concentrated. Cancel now and only resubscribe when needed.",
    "household": "Mobile CPH is high ($%s/hr), but %s is a TV/desktop app. Verify total household time.",
    "lifetime": "Stable usage over %d months. Lifetime ($%s) breaks even at month %d. NPV analysis confirms this is "
    "the cheapest long-term option.",
    "annual": "Yearly billing ($%s/mo) saves %.0f%% vs monthly ($%s/mo). Usage trend supports commitment.",
    "student": "Student tier (~$%s/mo) is cheaper than your current %s rate.",
    "over": "Cost ($%s/%s) exceeds your personal threshold ($%s).",
    "decay": "Value is okay, but EMA trend shows usage declining (velocity: %s).",
    "student_kept": "Already on the best price (Student Tier). Habit is locked in.",
    "better_plan": "Habit is locked in (%.0f%% break-even prob). NPV analysis shows %s is the optimal plan.",
    "locked": "Locked-in habit (%.0f%% break-even prob). Current plan is already optimal.",
    "fine": "Satisfactory value ($%s/%s).",
}


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    chain = None
    for name, value in table.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain.otherwise(F.lit(default))


def _total(series: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, series)


# --- series ------------------------------------------------------------------


def weekly_hours(long: DataFrame, keys: Sequence[str], weeks: int = WEEKS) -> DataFrame:
    """(keys, week, hours) rows to one ordered array per key; absent weeks are 0.

    Conditional sums instead of a collected list: combined map-side, so a user
    with a third of all rows sends one partial row per task.
    """
    per_week = [
        F.coalesce(F.sum(F.when(F.col("week") == w, F.col("hours"))), F.lit(0)).cast("double") for w in range(weeks)
    ]
    return long.groupBy(*keys).agg(F.array(*per_week).alias("weekly_hours"))


def clean_series(df: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """Clamp negative hours to 0 and flag series of another length (``valid_series``)."""
    hours = F.col("weekly_hours")
    return df.withColumns(
        {
            "valid_series": F.coalesce(F.size(hours) == weeks, F.lit(False)),
            "weekly_hours": F.transform(hours, lambda h: F.greatest(h, F.lit(0.0))),
        }
    )


def rejected_series(df: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """The rows that :func:`evaluate_usage` can't judge, with ``reject_reason``."""
    reason = F.when(F.col("weekly_hours").isNull(), "no series").otherwise("series of another length")
    return clean_series(df, weeks).filter(~F.col("valid_series")).withColumn("reject_reason", reason).drop("valid_series")


def series_columns(weeks: int = WEEKS, column: str = "weekly_hours") -> list[Column]:
    return [F.get(F.col(column), i) for i in range(weeks)]


def mean(series: Sequence[Column]) -> Column:
    return _total(series) / len(series)


def deviation(series: Sequence[Column], centre: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(_total([(x - centre) * (x - centre) for x in series]) / len(series))


def ema(series: Sequence[Column], alpha: float = EMA_ALPHA) -> Column:
    """Exponential moving average seeded with the first value."""
    return reduce(lambda level, x: F.lit(alpha) * x + F.lit(1 - alpha) * level, series)


def usage_velocity(series: Sequence[Column], presence: Column) -> Column:
    """Moving average over plain mean; 1 without use or for presence apps."""
    return F.when(presence | (_total(series) == 0), F.lit(1.0)).otherwise(ema(series) / mean(series))


def cusum_peaks(series: Sequence[Column], centre: Column, std: Column, slack: float = 0.5) -> tuple[Column, Column]:
    """Largest upward and downward excursion of the two cumulative sums (no restart)."""

    def excursions(deviations: list[Column]) -> Column:
        level, levels = F.lit(0.0), []
        for d in deviations:
            level = F.greatest(F.lit(0.0), level + d - slack * std)
            levels.append(level)
        return F.greatest(*levels)

    return excursions([x - centre for x in series]), excursions([centre - x for x in series])


def cusum_shift(peak_up: Column, peak_down: Column, std: Column, weeks: int, threshold: float = 1.5) -> Column:
    """Struct (direction, magnitude); a drop is reported before a surge."""

    def found(direction: str | None, magnitude: Column) -> Column:
        return F.struct(
            F.lit(direction).cast("string").alias("direction"), magnitude.cast("double").alias("magnitude")
        )

    if weeks < 3:
        return found(None, F.lit(0.0))
    return (
        F.when(std == 0, found(None, F.lit(0.0)))
        .when(peak_down > threshold * std, found("drop", peak_down / std))
        .when(peak_up > threshold * std, found("surge", peak_up / std))
        .otherwise(found(None, F.lit(0.0)))
    )


def detect_binge(series: Sequence[Column], centre: Column, std: Column) -> Column:
    """One week stands out by more than 1.5 deviations and holds over 40 % of the use."""
    total, top = _total(series), (F.greatest(*series) if len(series) > 1 else series[0])
    return (
        F.when((total == 0) | (std == 0), F.lit(False))
        .otherwise(((top - centre) / std > 1.5) & (top / total > 0.40))
    )


# --- cost --------------------------------------------------------------------


def monthly_cost(cost: Column, frequency: Column) -> Column:
    return cost.cast("double") / _lookup(frequency, CYCLE_MONTHS, 1.0)


def household_divisor(name: str, shared: Column) -> Column:
    """People who share the cost, from the lower-case app name and the shared-plan flag."""
    return (
        F.when(T.contains_any(name, ["duo", "couple"]), 2)
        .when(T.contains_any(name, ["family", "party", "group"]), 4)
        .when(shared, 3)
        .otherwise(1)
    )


def engagement_weight(engagement: Column, outcome: Column) -> Column:
    weight = _lookup(engagement, ENGAGEMENT_WEIGHT, 1.0)
    return F.when(outcome, F.greatest(weight, F.lit(1.5))).otherwise(weight)


def effective_hours(hours: Column, weight: Column, presence: Column) -> Column:
    return F.when(presence, F.lit(PRESENCE_DAYS)).otherwise(hours * weight)


def cost_per_hour(burden: Column, effective: Column) -> Column:
    """Per hour, or per day for presence apps (their effective hours are 30 days)."""
    return F.when(effective > 0, burden / effective).otherwise(F.lit(UNUSED_COST))


def cancel_threshold(wage: Column, style: Column, value_mode: Column) -> Column:
    factor = F.when(value_mode == "presence_based", 1.5).when(value_mode == "outcome_based", 2.0).otherwise(1.0)
    return wage * style * factor


def budget_style(style: Column) -> Column:
    """Share of the hourly wage a strict, balanced or lenient user accepts."""
    chain = None
    for name, value in BUDGET_STYLE.items():
        chain = F.when(style == name, F.lit(value)) if chain is None else chain.when(style == name, F.lit(value))
    return chain


def confidence(multi_device: Column, hours: Column, presence: Column, velocity: Column, weeks: int) -> Column:
    score = F.lit(1.0) - F.when(multi_device, 0.3).otherwise(0.0)
    score = score - F.when((hours < 2) & ~presence, 0.2).otherwise(0.0)
    score = score - F.when((velocity < 0.2) | (velocity > 2.0), 0.1).otherwise(0.0)
    if weeks < 4:
        score = score - 0.15
    return F.greatest(F.lit(0.3), score)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MODERATE").otherwise("LOW")


def break_even_prob(velocity: Column, category: Column, months: Column) -> Column:
    gamma = _lookup(category, GAMMA, DEFAULT_GAMMA)
    decay = F.exp(-gamma * (F.lit(1.0) / F.greatest(months, F.lit(1))))
    return F.least(F.least(velocity, F.lit(1.5)) * decay, F.lit(1.0))


def value_risk_score(velocity: Column, cph: Column, threshold: Column, months: Column, category: Column) -> Column:
    """0..100, high is good."""
    use = F.least(velocity * 50, F.lit(100.0))
    cost = F.when(threshold > 0, F.greatest((1 - cph / (threshold * 2)) * 100, F.lit(0.0))).otherwise(F.lit(50.0))
    duration = F.least(months / 12.0, F.lit(1.0)) * 100
    raw = 0.35 * use + 0.40 * cost + 0.10 * duration + 0.15 * 50
    rounded = F.bround(raw * _lookup(category, PRIORITY, 1.0), 0).cast("int")
    return F.greatest(F.least(rounded, F.lit(100)), F.lit(0))


def value_risk_label(score: Column) -> Column:
    return F.when(score > 70, "Low Risk").when(score >= 40, "Medium Risk").otherwise("High Risk")


# --- plans -------------------------------------------------------------------


def usage_horizon(velocity: Column) -> Column:
    """Months the use is expected to last."""
    chain = None
    for limit, months in HORIZONS:
        chain = F.when(velocity < limit, months) if chain is None else chain.when(velocity < limit, months)
    return chain.otherwise(LAST_HORIZON)


def _annuity(horizon: Column, periods, rate: float) -> Column:
    """Discount factor per horizon; the few horizons make it a constant each."""

    def factor(months: int) -> float:
        return math.fsum((1 + rate) ** -t for t in periods(months))

    table = [months for _, months in HORIZONS]
    chain = None
    for months in table:
        value = F.lit(factor(months))
        chain = F.when(horizon == months, value) if chain is None else chain.when(horizon == months, value)
    return chain.otherwise(F.lit(factor(LAST_HORIZON)))


def plan_npv(monthly: Column, yearly: Column, lifetime: Column, horizon: Column, rate: float = DISCOUNT_RATE) -> Column:
    """Struct of present values; an unpriced plan is null."""
    by_month = _annuity(horizon, lambda n: range(1, n + 1), rate)
    by_year = _annuity(horizon, lambda n: range(12, 12 * math.ceil(n / 12) + 1, 12), rate)
    return F.struct(
        F.when(monthly > 0, T.half_even(monthly * by_month, 2)).alias("monthly"),
        F.when(yearly > 0, T.half_even(yearly * by_year, 2)).alias("yearly"),
        F.when(lifetime > 0, lifetime).alias("lifetime"),
    )


def best_plan(npv: Column) -> Column:
    """Cheapest present value; ties go to monthly, yearly, lifetime."""
    cheapest = F.least(*[npv[plan] for plan in PLANS])
    chain = F.when(npv["monthly"] == cheapest, "monthly")
    return chain.when(npv["yearly"] == cheapest, "yearly").when(npv["lifetime"] == cheapest, "lifetime")


def breakeven_months(price: Column, monthly: Column) -> Column:
    return F.when((price > 0) & (monthly > 0), F.ceil(price / monthly)).otherwise(F.lit(0)).cast("int")


def coerce_price(text: Column) -> Column:
    """Number, numeric text or nested JSON object (named price, else first number); else 0."""
    nested = F.from_json(text, "map<string,string>")
    named = F.coalesce(*[F.element_at(nested, F.lit(k)) for k in ("price", "cost", "value", "amount")])
    first_number = F.regexp_extract(text, r'"\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)', 1)
    inside = F.coalesce(named, first_number).try_cast("double")
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), inside).otherwise(text.try_cast("double")), F.lit(0.0))


def verify_pricing(
    verified: Column, cost: Column, monthly: Column, yearly: Column, lifetime: Column, tolerance: float = 0.20
) -> Column:
    """Struct (pricing_verified, monthly, yearly, lifetime) after the plausibility check."""
    tiers = [monthly, yearly, lifetime]
    priced = reduce(lambda a, b: a | b, [t > 0 for t in tiers])
    close = reduce(
        lambda a, b: a | b,
        [(t > 0) & (F.abs(cost - t) / F.greatest(t, F.lit(0.01)) < tolerance) for t in tiers],
    )
    kept = [F.when(verified, t).otherwise(F.lit(0.0)) for t in tiers]
    return F.struct(
        (verified & (~priced | close)).alias("pricing_verified"),
        *[price.alias(plan) for plan, price in zip(PLANS, kept)],
    )


# --- verdict -----------------------------------------------------------------


def usage_verdict() -> Column:
    """Struct (action, reason): the first gate that applies, in order.

    Reads the columns made by :func:`usage_metrics`.
    """
    c = F.col
    presence, cph, threshold = c("is_presence"), c("cph"), c("cancel_threshold")
    cycle, name = F.upper(c("frequency")), c("app_name")
    student, burden = c("student_plan_price"), c("personal_burden")
    dollars = T.money(cph)
    unit = F.when(presence, "day").otherwise("hr")
    over = cph > threshold
    yearly_monthly = c("yearly_price") / 12
    saving = (c("monthly_price") - yearly_monthly) / c("monthly_price") * 100
    to_lifetime = (
        (c("best_plan") == "lifetime") & (c("lifetime_price") > 0) & (c("velocity") >= 0.8)
        & (c("breakeven_lifetime") > 0) & (c("months_subscribed") >= c("breakeven_lifetime") * 0.6)
    )
    to_annual = (
        (c("best_plan") == "yearly") & (c("yearly_price") > 0) & (c("monthly_price") > 0)
        & (c("frequency") == "monthly") & (c("velocity") >= 0.7) & (saving > 5)
    )
    locked = (
        (c("p_break_even") > 0.80) & (c("eff_hours") > 5)
        & ~c("frequency").isin("yearly", "lifetime") & ~c("is_binge")
    )
    percent = F.bround(c("p_break_even") * 100, 0)

    def out(action, reason: Column) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.struct(action.alias("action"), reason.alias("reason"))

    keep = F.concat(F.lit("KEEP "), cycle)
    return (
        F.when((c("raw_hours") == 0) & ~presence, out("CANCEL", F.lit(REASON["unused"])))
        .when((c("confidence") < 0.6) & over & ~presence, out("VERIFY USAGE", F.lit(REASON["verify"])))
        .when(
            (c("shift.direction") == "drop") & (c("shift.magnitude") > 2.0) & ~presence,
            out(
                "WARNING: USAGE CLIFF",
                F.format_string(REASON["cliff"], F.format_string("%.1f", F.bround(c("shift.magnitude"), 1)), name),
            ),
        )
        .when(
            c("is_binge") & (c("frequency") == "monthly") & c("category").isin("entertainment", "gaming"),
            out("SUBSCRIBE & CHURN", F.lit(REASON["binge"])),
        )
        .when(
            over & c("is_multi_device"),
            out("WARNING: VERIFY USAGE", F.format_string(REASON["household"], dollars, name)),
        )
        .when(
            to_lifetime,
            out(
                "SWITCH TO LIFETIME",
                F.format_string(
                    REASON["lifetime"], c("months_subscribed"), T.money(c("lifetime_price")), c("breakeven_lifetime")
                ),
            ),
        )
        .when(
            to_annual,
            out(
                "UPGRADE TO ANNUAL",
                F.format_string(
                    REASON["annual"], T.money(yearly_monthly), F.bround(saving, 0), T.money(c("monthly_price"))
                ),
            ),
        )
        .when(
            (student > 0) & (burden > student + 0.05),
            out("SWITCH TO STUDENT PLAN", F.format_string(REASON["student"], T.money(student), c("frequency"))),
        )
        .when(
            over,
            out(
                F.when(c("has_free_tier"), "DOWNGRADE TO FREE").otherwise("CANCEL"),
                F.format_string(REASON["over"], dollars, unit, T.money(threshold)),
            ),
        )
        .when(
            (c("velocity") < 0.50) & ~presence,
            out(
                F.concat(F.lit("WATCH "), cycle, F.lit(" (DECAYING)")),
                F.format_string(REASON["decay"], T.money(c("velocity"))),
            ),
        )
        .when(
            locked & (student > 0) & (burden <= student + 0.50), out(keep, F.lit(REASON["student_kept"]))
        )
        .when(
            locked & c("best_plan").isNotNull() & (c("best_plan") != c("frequency")),
            out(
                F.concat(F.lit("UPGRADE TO "), F.upper(c("best_plan"))),
                F.format_string(REASON["better_plan"], percent, c("best_plan")),
            ),
        )
        .when(locked, out(keep, F.format_string(REASON["locked"], percent)))
        .otherwise(out(keep, F.format_string(REASON["fine"], dollars, unit)))
    )


def usage_metrics(profiled: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """All numbers behind a verdict, in stages so that no step is computed twice.

    Needs usage columns (``app_name, cost, months_subscribed, weekly_hours,
    wage, style``) next to the profile columns.
    """
    c = F.col
    hours = [F.col(f"_h{i}") for i in range(weeks)]
    based = profiled.withColumns(
        {
            **{f"_h{i}": h for i, h in enumerate(series_columns(weeks))},
            "frequency": F.lower(c("frequency")),
            "is_presence": c("value_mode") == "presence_based",
            "_name": F.lower("app_name"),
        }
    ).withColumns(
        {
            "raw_hours": _total(hours),
            "_mean": mean(hours),
            "normalized_cost": monthly_cost(c("cost"), c("frequency")),
            "divisor": household_divisor("_name", c("is_shared_plan")),
            "weight": engagement_weight(c("engagement_type"), c("value_mode") == "outcome_based"),
            "velocity": usage_velocity(hours, c("is_presence")),
            "cancel_threshold": cancel_threshold(c("wage"), c("style"), c("value_mode")),
        }
    ).withColumns(
        {
            "personal_burden": c("normalized_cost") / c("divisor"),
            "eff_hours": effective_hours(c("raw_hours"), c("weight"), c("is_presence")),
            "_std": deviation(hours, c("_mean")),
            "confidence": confidence(
                c("is_multi_device"), c("raw_hours"), c("is_presence"), c("velocity"), weeks
            ),
            "p_break_even": break_even_prob(c("velocity"), c("category"), c("months_subscribed")),
            "projected_months": usage_horizon(c("velocity")),
        }
    )
    up, down = cusum_peaks(hours, c("_mean"), c("_std"))
    return (
        based.withColumns(
            {
                "cph": cost_per_hour(c("personal_burden"), c("eff_hours")),
                "_up": up,
                "_down": down,
                "is_binge": detect_binge(hours, c("_mean"), c("_std")),
                "npv": plan_npv(c("monthly_price"), c("yearly_price"), c("lifetime_price"), c("projected_months")),
                "breakeven_lifetime": breakeven_months(c("lifetime_price"), c("monthly_price")),
                "breakeven_yearly": breakeven_months(c("yearly_price"), c("monthly_price")),
                "confidence_label": confidence_label(c("confidence")),
            }
        )
        .withColumns(
            {
                "shift": cusum_shift(c("_up"), c("_down"), c("_std"), weeks),
                "best_plan": best_plan(c("npv")),
                "value_risk_score": value_risk_score(
                    c("velocity"), c("cph"), c("cancel_threshold"), c("months_subscribed"), c("category")
                ),
            }
        )
        .withColumn("value_risk_label", value_risk_label(c("value_risk_score")))
        .drop("_name", "_mean", "_std", "_up", "_down", *[f"_h{i}" for i in range(weeks)])
    )


def evaluate_usage(profiled: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """Verdict per (user, app) with a series of ``weeks`` values; :func:`rejected_series` has the others."""
    series = clean_series(profiled, weeks).filter("valid_series").drop("valid_series")
    judged = usage_metrics(series, weeks).withColumn("_verdict", usage_verdict())
    return judged.withColumns({"action": F.col("_verdict.action"), "reason": F.col("_verdict.reason")}).drop(
        "_verdict", "weekly_hours"
    )


def nest_verdict(judged: DataFrame, key: str = "user_id") -> DataFrame:
    """The verdict as one nested record per (user, app)."""
    c = F.col
    plan_costs = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(p).alias("key"), c(f"npv.{p}").alias("value")) for p in PLANS]),
            lambda entry: entry["value"].isNotNull(),
        )
    )
    return judged.select(
        key,
        "app_name",
        "category",
        "action",
        "reason",
        "confidence_label",
        "is_presence",
        "best_plan",
        F.when(
            c("best_plan").isNotNull(),
            F.struct(
                "projected_months",
                c("breakeven_lifetime").alias("breakeven_months_lifetime"),
                c("breakeven_yearly").alias("breakeven_months_yearly"),
                "months_subscribed",
                plan_costs.alias("plan_costs_npv"),
            ),
        ).alias("breakeven_info"),
        "value_risk_score",
        "value_risk_label",
        F.struct(
            "normalized_cost", "divisor", "personal_burden", "raw_hours", "weight", "eff_hours", "cph", "velocity"
        ).alias("math"),
    )


def velocity_trend(velocity: Column) -> Column:
    return F.when(velocity > 1.05, "increasing").when(velocity < 0.95, "declining").otherwise("stable")


def action_class(text: str = "action") -> Column:
    """Colour class of an action text."""
    action = F.col(text)
    return (
        F.when(action.isNull() | (action == ""), "warn")
        .when(T.contains_any(text, ["KEEP", "UPGRADE"]), "safe")
        .when(T.contains_any(text, ["CANCEL", "DOWNGRADE"]), "danger")
        .otherwise("warn")
    )


def plan_comparison(judged: DataFrame, key: str = "user_id") -> DataFrame:
    """One row per priced plan of a verified app: tier price, present value, best flag."""
    c = F.col
    rows = F.array(
        *[
            F.struct(
                F.lit(plan).alias("plan"), c(f"{plan}_price").alias("tier_price"), c(f"npv.{plan}").alias("npv_cost")
            )
            for plan in PLANS
        ]
    )
    return (
        judged.filter(c("pricing_verified") & c("best_plan").isNotNull())
        .select(key, "app_name", "best_plan", F.inline(rows))
        .filter(c("npv_cost").isNotNull())
        .withColumn("is_best", c("plan") == c("best_plan"))
        .drop("best_plan")
    )
