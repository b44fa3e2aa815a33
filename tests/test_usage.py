import math
import random

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import usage as U

SCHEMA = (
    "user_id int, app_name string, cost double, months_subscribed int, weekly_hours array<double>, wage double, style double, "
    "frequency string, category string, value_mode string, engagement_type string, is_multi_device boolean, "
    "has_free_tier boolean, is_shared_plan boolean, student_plan_price double, pricing_verified boolean, "
    "monthly_price double, yearly_price double, lifetime_price double"
)
BASE = dict(
    app_name="App", cost=10.0, months_subscribed=12, weekly_hours=[5.0, 5.0, 5.0, 5.0], wage=20.0, style=0.1, frequency="monthly",
    category="productivity", value_mode="time_based", engagement_type="active", is_multi_device=False, has_free_tier=False,
    is_shared_plan=False, student_plan_price=0.0, pricing_verified=True, monthly_price=0.0, yearly_price=0.0, lifetime_price=0.0,
)


def frame(spark, cases):
    order = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [tuple({**BASE, **case, "user_id": i}[c] for c in order) for i, case in enumerate(cases)]
    return spark.createDataFrame(rows, SCHEMA)


GATES = [
    (dict(weekly_hours=[0.0] * 4), "CANCEL", "Zero usage"),
    (dict(weekly_hours=[0.4] * 4, is_multi_device=True, cost=90.0), "VERIFY USAGE", "Low confidence"),
    (dict(weekly_hours=[0.0, 0.0, 0.0, 9.0], category="gaming"), "SUBSCRIBE & CHURN", "Statistical binge"),
    (dict(is_multi_device=True, cost=90.0), "WARNING: VERIFY USAGE", "Mobile CPH is high ($4.50/hr), but App"),
    (dict(monthly_price=10.0, lifetime_price=20.0), "SWITCH TO LIFETIME", "Stable usage over 12 months. Lifetime ($20.00) breaks even at month 2."),
    (dict(monthly_price=10.0, yearly_price=60.0), "UPGRADE TO ANNUAL", "Yearly billing ($5.00/mo) saves 50% vs monthly ($10.00/mo)."),
    (dict(student_plan_price=5.0), "SWITCH TO STUDENT PLAN", "Student tier (~$5.00/mo)"),
    (dict(cost=90.0, has_free_tier=True), "DOWNGRADE TO FREE", "Cost ($4.50/hr) exceeds your personal threshold ($2.00)."),
    (dict(cost=90.0), "CANCEL", "Cost ($4.50/hr)"),
    (dict(weekly_hours=[30.0, 9.0, 1.0, 0.5], frequency="yearly"), "KEEP YEARLY", "Satisfactory value"),
    (dict(student_plan_price=9.9), "SWITCH TO STUDENT PLAN", "Student tier"),
    (dict(student_plan_price=9.96), "KEEP MONTHLY", "Already on the best price"),
    (dict(frequency="quarterly", monthly_price=10.0), "UPGRADE TO MONTHLY", "Habit is locked in (99% break-even prob)"),
    (dict(), "KEEP MONTHLY", "Locked-in habit (99% break-even prob)"),
    (dict(frequency="yearly", cost=60.0), "KEEP YEARLY", "Satisfactory value ($0.25/hr)."),
    (dict(value_mode="presence_based", weekly_hours=[0.0] * 4), "KEEP MONTHLY", "Locked-in habit"),
]


@pytest.fixture(scope="module")
def judged(spark):
    return U.evaluate_usage(frame(spark, [case for case, *_ in GATES])).orderBy("user_id").collect()


@pytest.mark.parametrize("index", range(len(GATES)))
def test_gate(judged, index):
    _, action, reason = GATES[index]
    assert (judged[index]["action"], judged[index]["reason"][: len(reason)]) == (action, reason)


def test_gates_that_need_a_longer_series(spark):
    """With four weeks the velocity stays above 0.58 and a drop below 1.3 deviations, so these gates never fire."""
    spike = [0.0] * 3 + [20.0] + [0.0] * 6
    row = U.evaluate_usage(frame(spark, [dict(weekly_hours=spike, frequency="weekly", cost=0.1)]), weeks=10).first()
    assert math.isclose(row["velocity"], 0.3 * 20 * 0.7**6 / 2)
    assert row["action"] == "WATCH WEEKLY (DECAYING)" and row["reason"].endswith("(velocity: 0.35).")
    cliff = U.evaluate_usage(frame(spark, [dict(weekly_hours=[9.0] * 5 + [0.0] * 5)]), weeks=10).first()
    assert cliff["action"] == "WARNING: USAGE CLIFF" and "magnitude: 2.5σ" in cliff["reason"]


def test_series_of_other_length_is_left_out(spark):
    df = frame(spark, [dict(weekly_hours=[1.0, 2.0]), dict(weekly_hours=[-1.0, 2.0, 2.0, 2.0])])
    assert [r["user_id"] for r in U.evaluate_usage(df).collect()] == [1]
    clean = U.clean_series(df).orderBy("user_id").collect()
    assert [r["valid_series"] for r in clean] == [False, True] and clean[1]["weekly_hours"][0] == 0.0


def brute(case):
    c = {**BASE, **case}
    h = c["weekly_hours"]
    months = {"weekly": 0.23, "monthly": 1, "quarterly": 3, "biannual": 6, "yearly": 12}.get(c["frequency"], 1)
    name = c["app_name"].lower()
    divisor = 2 if "duo" in name or "couple" in name else 4 if any(w in name for w in ("family", "party", "group")) else 3 if c["is_shared_plan"] else 1
    burden = c["cost"] / months / divisor
    weight = {"passive": 0.33, "generative": 1.5}.get(c["engagement_type"], 1)
    presence, outcome = c["value_mode"] == "presence_based", c["value_mode"] == "outcome_based"
    weight = max(weight, 1.5) if outcome else weight
    eff = 30 if presence else sum(h) * weight
    cph = burden / eff if eff > 0 else 9999.99
    level = h[0]
    for x in h[1:]:
        level = 0.3 * x + 0.7 * level
    velocity = 1.0 if presence or sum(h) == 0 else level / (sum(h) / len(h))
    threshold = c["wage"] * c["style"] * (1.5 if presence else 2 if outcome else 1)
    cost = max((1 - cph / (threshold * 2)) * 100, 0)
    priority = {"productivity": 1.2, "utility": 1.1, "entertainment": 0.8, "gaming": 0.7}[c["category"]]
    raw = 0.35 * min(velocity * 50, 100) + 0.4 * cost + 0.1 * min(c["months_subscribed"] / 12, 1) * 100 + 7.5
    score = max(min(round(raw * priority), 100), 0)
    horizon = 3 if velocity < 0.3 else 6 if velocity < 0.5 else 12 if velocity < 0.8 else 36
    costs = {}
    if c["monthly_price"] > 0:
        costs["monthly"] = round(sum(c["monthly_price"] / 1.005**t for t in range(1, horizon + 1)), 2)
    if c["yearly_price"] > 0:
        costs["yearly"] = round(sum(c["yearly_price"] / 1.005 ** (12 * y) for y in range(1, math.ceil(horizon / 12) + 1)), 2)
    if c["lifetime_price"] > 0:
        costs["lifetime"] = c["lifetime_price"]
    return cph, velocity, score, min(costs, key=costs.get) if costs else None, costs


def test_metrics_equal_brute_force(spark):
    rng = random.Random(2)
    cases = [
        dict(
            app_name=rng.choice(["Solo", "Tunes Duo", "Flix Family"]), cost=rng.choice([5.0, 19.99, 120.0]),
            months_subscribed=rng.randint(1, 30), weekly_hours=[round(rng.uniform(0, 9), 2) for _ in range(4)],
            frequency=rng.choice(["weekly", "monthly", "quarterly", "yearly", "lifetime"]),
            category=rng.choice(["utility", "productivity", "entertainment", "gaming"]),
            value_mode=rng.choice(["time_based", "presence_based", "outcome_based"]),
            engagement_type=rng.choice(["passive", "active", "generative"]), is_shared_plan=rng.random() < 0.5,
            monthly_price=rng.choice([0.0, 9.99]), yearly_price=rng.choice([0.0, 89.99]), lifetime_price=rng.choice([0.0, 199.0]),
        )
        for _ in range(60)
    ]
    nested = U.nest_verdict(U.evaluate_usage(frame(spark, cases))).orderBy("user_id").collect()
    for case, row in zip(cases, nested):
        cph, velocity, score, best, costs = brute(case)
        assert math.isclose(row["math"]["cph"], cph) and math.isclose(row["math"]["velocity"], velocity)
        assert (row["value_risk_score"], row["best_plan"]) == (score, best)
        assert (row["breakeven_info"]["plan_costs_npv"] if costs else {}) == costs


def test_long_rows_become_weekly_series(spark):
    long = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 0, 2.0), (1, "a", 3, 4.0)], "user_id int, app_name string, week int, hours double")
    assert U.weekly_hours(long, ["user_id", "app_name"]).first()["weekly_hours"] == [3.0, 0.0, 0.0, 4.0]


def test_prices(spark):
    texts = ["4.99", '{"currency": "USD", "price": 3}', '{"a": "x", "b": 7.5}', "free", '{"a": "x"}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(U.coerce_price(F.col("t")))
    assert [r[0] for r in df.collect()] == [4.99, 3.0, 7.5, 0.0, 0.0, 0.0]
    rows = [(True, 10.0, 10.0, 0.0, 0.0), (True, 12.1, 10.0, 0.0, 0.0), (True, 5.0, 0.0, 0.0, 0.0), (False, 10.0, 10.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "v boolean, cost double, m double, y double, l double")
    found = df.select(U.verify_pricing(*[F.col(c) for c in ("v", "cost", "m", "y", "l")]).alias("x")).select("x.*").collect()
    assert [(r["pricing_verified"], r["monthly"]) for r in found] == [(True, 10.0), (False, 10.0), (True, 0.0), (False, 0.0)]


def test_evaluation_has_no_python_and_one_join(spark):
    plan = U.evaluate_usage(frame(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
