"""Queries over app usage: verdicts, portfolio overlap and exam-season advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.operators import exams as EX
from spendcadence.operators import portfolio as PF
from spendcadence.operators import usage as U
from spendcadence.plans import adapters as A
from spendcadence.plans import oracle_base as S
from spendcadence.plans.registry import query
from spendcadence.sinks import reports as RP
from spendcadence.sources import events as E

KEY = ["user_id", "app_name"]
KEY_SQL = "user_id, app_name"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    series = U.clean_series(A.profiled_usage(spark, sf)).filter("valid_series")
    return U.usage_metrics(series)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return U.evaluate_usage(A.profiled_usage(spark, sf))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.usage(spark, sf)
    return rows.withColumns({f"h{i}": h for i, h in enumerate(U.series_columns())})


HOURS = ["h0", "h1", "h2", "h3"]


def _hours() -> list:
    return [F.col(h) for h in HOURS]


def _odd_series(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of which some series are too short, and some missing."""
    length = F.when(F.col("user_id") % 7 == 0, F.lit(None)).otherwise(F.least(F.col("user_id") % 9, F.lit(4))).cast("int")
    return A.usage(spark, sf).withColumn("weekly_hours", F.slice("weekly_hours", F.lit(1), length))


@query(
    "use_01_rejected_series",
    S.build(
        f"""SELECT {KEY_SQL}, CASE WHEN user_id % 7 = 0 THEN -1 ELSE least(user_id % 9, 4) END::INT AS weeks,
                   CASE WHEN user_id % 7 = 0 THEN 'no series' ELSE 'series of another length' END AS reject_reason
            FROM usage WHERE user_id % 7 = 0 OR user_id % 9 < 4""",
        ["usage"],
    ),
)
def rejected_series(spark: SparkSession, sf: str) -> DataFrame:
    rejected = U.rejected_series(_odd_series(spark, sf))
    return rejected.select(*KEY, F.coalesce(F.size("weekly_hours"), F.lit(-1)).alias("weeks"), "reject_reason")


@query("use_01_weekly_hours", S.build(f"SELECT {KEY_SQL}, h0, h1, h2, h3 FROM usage", ["usage"]))
def weekly_hours(spark: SparkSession, sf: str) -> DataFrame:
    clean = U.clean_series(A.usage(spark, sf)).filter("valid_series")
    return clean.select(*KEY, *[h.alias(f"h{i}") for i, h in enumerate(U.series_columns())])


def _metric(*columns: str, renamed: dict | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        picked = [F.col(c).alias(a) for c, a in (renamed or {}).items()]
        return metrics(spark, sf).select(*KEY, *columns, *picked)

    return run


def _metric_query(name: str, sql_columns: str, *columns: str, renamed: dict | None = None, source: str = "metrics") -> None:
    query(name, S.build(f"SELECT {KEY_SQL}, {sql_columns} FROM {source}", [source]))(_metric(*columns, renamed=renamed))


_metric_query("use_02_monthly_cost", "normalized_cost", "normalized_cost")
_metric_query("use_03_household_divisor", "divisor, personal_burden", "divisor", "personal_burden")
_metric_query("use_04_effective_hours", "raw_hours, weight, eff_hours", "raw_hours", "weight", "eff_hours")
_metric_query("use_05_cost_per_hour", "cph, cancel_threshold", "cph", "cancel_threshold")
_metric_query("use_07_usage_velocity", "velocity", "velocity")
_metric_query("use_09_detect_binge", "is_binge", "is_binge")
_metric_query("use_10_confidence", "confidence, confidence_label", "confidence", "confidence_label")
_metric_query("use_13_usage_horizon", "projected_months", "projected_months")
_metric_query(
    "use_16_breakeven_months", "breakeven_lifetime, breakeven_yearly", "breakeven_lifetime", "breakeven_yearly"
)


@query(
    "use_06_ema",
    S.build(
        f"""SELECT {KEY_SQL}, 0.3::DOUBLE * h3 + 0.7::DOUBLE * (0.3::DOUBLE * h2 + 0.7::DOUBLE * (0.3::DOUBLE * h1
            + 0.7::DOUBLE * h0)) AS ema FROM usage""",
        ["usage"],
    ),
)
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select(*KEY, U.ema(_hours()).alias("ema"))


@query(
    "use_08_cusum_shift",
    S.build(
        f"""SELECT {KEY_SQL}, round(cost_up, 9) AS peak_up, round(cost_down, 9) AS peak_down,
                   CASE WHEN dropped THEN 'drop' WHEN surge THEN 'surge' ELSE 'none' END AS direction FROM metrics""",
        ["metrics"],
    ),
)
def cusum_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = _series(spark, sf).withColumn("mean", U.mean(_hours()))
    rows = rows.withColumn("std", U.deviation(_hours(), F.col("mean")))
    up, down = U.cusum_peaks(_hours(), F.col("mean"), F.col("std"))
    peaks = rows.withColumns({"peak_up": up, "peak_down": down})
    shift = U.cusum_shift(F.col("peak_up"), F.col("peak_down"), F.col("std"), U.WEEKS)
    return peaks.select(
        *KEY, F.round("peak_up", 9).alias("peak_up"), F.round("peak_down", 9).alias("peak_down"),
        F.coalesce(shift["direction"], F.lit("none")).alias("direction"),
    )


@query("use_11_break_even_prob", S.build(f"SELECT {KEY_SQL}, round(p_break_even, 9) AS p FROM metrics", ["metrics"]))
def break_even_prob(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*KEY, F.round("p_break_even", 9).alias("p"))


@query(
    "use_12_value_risk_score",
    S.build(f"SELECT {KEY_SQL}, value_risk_score, value_risk_label FROM verdicts", ["verdicts"]),
)
def value_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*KEY, "value_risk_score", "value_risk_label")


@query("use_14_plan_npv", S.build(f"SELECT {KEY_SQL}, npv_monthly, npv_yearly, npv_lifetime FROM metrics", ["metrics"]))
def plan_npv(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*KEY, *[F.col(f"npv.{p}").alias(f"npv_{p}") for p in U.PLANS])


@query("use_15_best_plan", S.build(f"SELECT {KEY_SQL}, best_plan FROM verdicts", ["verdicts"]))
def best_plan(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*KEY, "best_plan")


@query(
    "use_17_coerce_price",
    S.build(
        """SELECT user_id, app_name, coalesce(m, 0)::DOUBLE AS plain, coalesce(m, 0)::DOUBLE AS named, cost AS first_number,
                  0::DOUBLE AS unreadable
           FROM usage LEFT JOIN catalog USING (app_name)""",
        ["usage", "catalog"],
    ),
)
def coerce_price(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.usage(spark, sf).join(A.catalog(spark).select("app_name", "monthly_price"), "app_name", "left")
    plain = F.col("monthly_price").cast("string")
    paid = F.col("cost").cast("string")
    return rows.select(
        *KEY,
        U.coerce_price(plain).alias("plain"),
        U.coerce_price(F.concat(F.lit('{"note": "n/a", "price": "'), plain, F.lit('"}'))).alias("named"),
        U.coerce_price(F.concat(F.lit('{"plan": "basic", "usd": '), paid, F.lit(', "eur": 1}'))).alias("first_number"),
        U.coerce_price(F.concat(F.lit("about "), paid)).alias("unreadable"),
    )


@query(
    "use_18_verify_pricing",
    S.build(
        f"SELECT {KEY_SQL}, pricing_verified, monthly_price, yearly_price, lifetime_price FROM profiled", ["profiled"]
    ),
)
def verify_pricing(spark: SparkSession, sf: str) -> DataFrame:
    return A.profiled_usage(spark, sf).select(
        *KEY, "pricing_verified", "monthly_price", "yearly_price", "lifetime_price"
    )


@query("use_19_usage_verdict", S.build(f"SELECT {KEY_SQL}, action, reason FROM verdicts", ["verdicts"]))
def usage_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select(*KEY, "action", "reason")


@query(
    "use_20_evaluate_usage",
    S.build(
        f"""SELECT {KEY_SQL}, category, action, confidence_label, is_presence, best_plan,
                   CASE WHEN best_plan IS NULL THEN 0 ELSE projected_months END AS projected_months, value_risk_score,
                   value_risk_label, normalized_cost, divisor, personal_burden, raw_hours, weight, eff_hours, cph, velocity
            FROM verdicts""",
        ["verdicts"],
    ),
)
def evaluate_usage(spark: SparkSession, sf: str) -> DataFrame:
    nested = U.nest_verdict(verdicts(spark, sf))
    return nested.select(
        *KEY, "category", "action", "confidence_label", "is_presence", "best_plan",
        F.coalesce("breakeven_info.projected_months", F.lit(0)).alias("projected_months"), "value_risk_score",
        "value_risk_label", "math.*",
    )


@query(
    "use_21_velocity_trend",
    S.build(
        f"""SELECT {KEY_SQL}, CASE WHEN velocity > 1.05::DOUBLE THEN 'increasing' WHEN velocity < 0.95::DOUBLE THEN 'declining'
                   ELSE 'stable' END AS trend FROM metrics""",
        ["metrics"],
    ),
)
def velocity_trend(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*KEY, U.velocity_trend(F.col("velocity")).alias("trend"))


@query(
    "use_22_action_class",
    S.build(
        f"""SELECT {KEY_SQL}, CASE WHEN contains(action, 'KEEP') OR contains(action, 'UPGRADE') THEN 'safe'
                   WHEN contains(action, 'CANCEL') OR contains(action, 'DOWNGRADE') THEN 'danger' ELSE 'warn' END AS class
            FROM verdicts""",
        ["verdicts"],
    ),
)
def action_class(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select(*KEY, U.action_class("action").alias("class"))


@query(
    "use_23_budget_style",
    S.build(f"SELECT {KEY_SQL}, style, wage * style AS hourly_threshold FROM usage", ["usage"]),
)
def budget_style(spark: SparkSession, sf: str) -> DataFrame:
    named = A.pick("user_id % 3", ["strict", "balanced", "lenient"])
    share = U.budget_style(named)
    return A.usage(spark, sf).select(*KEY, share.alias("style"), (F.col("wage") * share).alias("hourly_threshold"))


@query(
    "use_24_plan_comparison",
    S.build(
        f"""SELECT {KEY_SQL}, plan, tier_price, npv_cost, plan = best_plan AS is_best
            FROM (SELECT *, 'monthly' AS plan, monthly_price AS tier_price, npv_monthly AS npv_cost FROM verdicts
                  UNION ALL SELECT *, 'yearly', yearly_price, npv_yearly FROM verdicts
                  UNION ALL SELECT *, 'lifetime', lifetime_price, npv_lifetime FROM verdicts)
            WHERE pricing_verified AND best_plan IS NOT NULL AND npv_cost IS NOT NULL""",
        ["verdicts"],
    ),
)
def plan_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return U.plan_comparison(verdicts(spark, sf)).orderBy("user_id", "app_name", "npv_cost")


# --- portfolio ------------------------------------------------------------------


@query(
    "por_01_category_saturation",
    S.build(
        """SELECT user_id, category, n AS subscription_count, total_cost AS total_monthly_cost, total_hours AS total_weekly_hours
           FROM insights""",
        ["insights"],
    ),
)
def category_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return PF.category_saturation(verdicts(spark, sf)).select(
        "user_id", "category", "subscription_count", "total_monthly_cost", "total_weekly_hours"
    )


@query(
    "por_02_rank_by_value",
    S.build(
        """SELECT user_id, category, app_name, rank, cph, CASE WHEN is_presence THEN 'day' ELSE 'hour' END AS unit,
                  personal_burden AS monthly_cost, raw_hours, action, rank = 1 AS is_best_value, rank = n AS is_worst_value
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY cph, app_name)::INT AS rank,
                        count(*) OVER (PARTITION BY user_id, category) AS n FROM verdicts) WHERE n >= 2""",
        ["verdicts"],
    ),
)
def rank_by_value(spark: SparkSession, sf: str) -> DataFrame:
    return PF.rank_by_value(verdicts(spark, sf))


@query(
    "por_03_consolidation_savings",
    S.build(
        """SELECT user_id, category, drop_worst AS savings_drop_worst, drop_worst_annual AS savings_drop_worst_annual,
                  keep_best AS savings_keep_best_only, keep_best_annual AS savings_keep_best_only_annual FROM insights""",
        ["insights"],
    ),
)
def consolidation_savings(spark: SparkSession, sf: str) -> DataFrame:
    saved = PF.consolidation_savings(PF.category_saturation(verdicts(spark, sf)))
    return saved.select("user_id", "category", *[c for c in saved.columns if c.startswith("savings_")])


@query(
    "por_04_category_insight",
    S.build(
        f"""SELECT user_id, category, {S.title("replace(category, '_', ' ')")} AS category_label, n AS subscription_count,
                   best_name, best_cph, worst_name, worst_cph, recommendation FROM insights""",
        ["insights"],
    ),
)
def category_insight(spark: SparkSession, sf: str) -> DataFrame:
    return PF.category_insight(verdicts(spark, sf)).select(
        "user_id", "category", "category_label", "subscription_count",
        F.col("best_value.name").alias("best_name"), F.col("best_value.cph").alias("best_cph"),
        F.col("worst_value.name").alias("worst_name"), F.col("worst_value.cph").alias("worst_cph"), "recommendation",
    )


_SUMMARY_SQL = """
  SELECT user_id, u.n AS subscriptions, coalesce(i.n, 0)::BIGINT AS saturated_categories,
         coalesce(i.saved, 0)::DOUBLE AS total_potential_savings_monthly,
         (coalesce(i.saved, 0) * 12)::DOUBLE AS total_potential_savings_annual
  FROM (SELECT user_id, count(*) AS n FROM verdicts GROUP BY user_id) u
  LEFT JOIN (SELECT user_id, count(*) AS n, sum(CAST(round_even(drop_worst, 2) AS DECIMAL(18, 2))) AS saved
             FROM insights GROUP BY user_id) i USING (user_id)"""


@query("por_05_portfolio_summary", S.build(_SUMMARY_SQL, ["verdicts", "insights"]))
def portfolio_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = verdicts(spark, sf)
    return PF.portfolio_summary(rows, PF.category_insight(rows))


# --- exams ----------------------------------------------------------------------

_EXAMS_SQL = f"""
  SELECT user_id, event_id, summary AS name, start AS date, keyword_matched
  FROM (SELECT *, {S.first_rule("lower(summary) || ' ' || lower(description)", [(w, w) for w in R.EXAM_KEYWORDS])} AS keyword_matched
        FROM calendar WHERE start_date < DATE '1998-01-01' + 30
          AND (end_date > DATE '1998-01-01' OR start_date >= DATE '1998-01-01'))
  WHERE keyword_matched IS NOT NULL"""


def exam_events(spark: SparkSession, sf: str) -> DataFrame:
    return EX.match_exam_events(E.events_in_horizon(A.calendar_events(spark, sf), A.TODAY_TRAVEL, 1))


@query("exm_01_match_exam_events", S.build(_EXAMS_SQL, ["calendar"]))
def match_exam_events(spark: SparkSession, sf: str) -> DataFrame:
    return exam_events(spark, sf)


@query(
    "exm_01_exam_keywords_in_documents",
    f"SELECT doc_id, {S.first_rule('lower(text)', [(w, w) for w in R.EXAM_KEYWORDS])} AS keyword FROM documents "
    f"WHERE {S.first_rule('lower(text)', [(w, w) for w in R.EXAM_KEYWORDS])} IS NOT NULL",
)
def exam_keywords_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents").select(
        F.lit(0).alias("user_id"), F.col("doc_id").alias("event_id"), F.col("text").alias("summary"),
        F.lit("").alias("description"), F.lit("").alias("start"),
    )
    return EX.match_exam_events(docs).select(F.col("event_id").alias("doc_id"), F.col("keyword_matched").alias("keyword"))


_PAUSABLE_SQL = """SELECT user_id, app_name AS name, category, personal_burden AS monthly_cost FROM verdicts
  WHERE category IN ('entertainment', 'gaming')"""


@query("exm_02_pausable_subscriptions", S.build(_PAUSABLE_SQL, ["verdicts"]))
def pausable_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return EX.pausable_subscriptions(verdicts(spark, sf))


def exam_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return EX.exam_alert(
        exam_events(spark, sf), EX.pausable_subscriptions(verdicts(spark, sf)), A.students(spark, sf)
    )


@query(
    "exm_03_exam_alert",
    S.build(
        f"""SELECT user_id, TRUE AS exam_detected, e.n AS exam_count, coalesce(p.n, 0)::BIGINT AS pausable_count,
                   coalesce(p.saved, 0)::DOUBLE AS total_monthly_savings,
                   CASE WHEN p.n IS NULL THEN '📚 ' || e.n || ' exam(s) detected in the next 30 days, but none of your subscriptions '
                          || 'are entertainment or gaming.'
                        ELSE '🎓 ' || e.n || ' exam(s) detected in the next 30 days. Consider pausing ' || names || ' to save $'
                          || {S.money('p.saved')} || '/mo during this period.' END AS message
            FROM (SELECT user_id, count(*) AS n FROM ({_EXAMS_SQL}) GROUP BY user_id) e
            LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(name, ', ' ORDER BY name) AS names,
                              sum(CAST(monthly_cost AS DECIMAL(28, 10)))::DOUBLE AS saved FROM ({_PAUSABLE_SQL}) GROUP BY user_id) p
              USING (user_id)
            WHERE user_id % 4 = 0 AND user_id IN (SELECT user_id FROM events)""",
        ["verdicts", "calendar"],
    ),
)
def exam_alert(spark: SparkSession, sf: str) -> DataFrame:
    return exam_alerts(spark, sf)


def usage_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = verdicts(spark, sf)
    insights = PF.category_insight(rows)
    return RP.usage_report(
        U.nest_verdict(rows), PF.portfolio_summary(rows, insights), insights, exam_alerts(spark, sf)
    )


@query(
    "snk_05_usage_report",
    S.build(
        f"""SELECT user_id, coalesce(v.n, 0)::BIGINT AS results, coalesce(i.n, 0)::BIGINT AS category_insights, v.n AS "count",
                   x.n IS NOT NULL AS has_exam_alert, v.apps, v.actions
            FROM (SELECT user_id, count(*) AS n, string_agg(app_name, ',' ORDER BY app_name) AS apps,
                         string_agg(action, ',' ORDER BY app_name) AS actions FROM verdicts GROUP BY user_id) v
            FULL JOIN (SELECT user_id, count(*) AS n FROM ({_EXAMS_SQL}) WHERE user_id % 4 = 0
                         AND user_id IN (SELECT user_id FROM events) GROUP BY user_id) x USING (user_id)
            LEFT JOIN (SELECT user_id, count(*) AS n FROM insights GROUP BY user_id) i USING (user_id)""",
        ["verdicts", "insights", "calendar"],
    ),
)
def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    return usage_documents(spark, sf).select(
        "user_id",
        *[F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c) for c in ("results", "category_insights")],
        "count",
        F.col("exam_alert").isNotNull().alias("has_exam_alert"),
        F.array_join("results.app_name", ",").alias("apps"),
        F.array_join("results.action", ",").alias("actions"),
    )

