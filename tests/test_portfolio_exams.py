import pytest

from spendcadence.operators import exams as EX
from spendcadence.operators import portfolio as PF


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [
        (1, "A", "entertainment", 2.0, 10.0, 5.0, "KEEP MONTHLY", False), (1, "B", "entertainment", 1.0, 5.0, 5.0, "KEEP MONTHLY", False),
        (1, "C", "entertainment", 9999.99, 7.5, 0.0, "CANCEL", False), (1, "D", "entertainment", 9999.99, 3.0, 0.0, "CANCEL", False),
        (1, "E", "utility", 0.1, 3.0, 30.0, "KEEP MONTHLY", True), (2, "A", "gaming", 1.0, 4.0, 4.0, "KEEP MONTHLY", False),
    ]
    return spark.createDataFrame(
        rows, "user_id int, app_name string, category string, cph double, personal_burden double, raw_hours double, action string, is_presence boolean"
    )


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_rank_with_ties(verdicts, hot_rows):
    ranked = PF.rank_by_value(verdicts, hot_rows=hot_rows).orderBy("rank").collect()
    assert [(r["app_name"], r["rank"], r["is_best_value"], r["is_worst_value"]) for r in ranked] == [
        ("B", 1, True, False), ("A", 2, False, False), ("C", 3, False, False), ("D", 4, False, True)]


def test_insight_and_summary(verdicts):
    insight = PF.category_insight(verdicts)
    row = insight.first()
    assert (row["subscription_count"], row["total_monthly_cost"], row["savings_keep_best_only"], row["savings_drop_worst"]) == (4, 25.5, 20.5, 3.0)
    assert row["recommendation"] == (
        "You have 4 entertainment subscriptions costing $25.50/mo total. B is your best value at $1.00/hr. "
        "Dropping D alone saves $3.00/mo ($36.00/yr)."
    )
    found = {r["user_id"]: (r["saturated_categories"], r["total_potential_savings_annual"]) for r in PF.portfolio_summary(verdicts, insight).collect()}
    assert found == {1: (1, 36.0), 2: (0, 0.0)}


def test_exam_alert(spark, verdicts):
    events = spark.createDataFrame(
        [(1, 1, "Final exam", "room 4", "d"), (1, 2, "Latest news", None, "d"), (2, 3, "Lunch", "", "d"), (3, 4, "Quiz", "", "d"),
         (4, 5, "exam", "", "d")],
        "user_id int, event_id int, summary string, description string, start string",
    )
    exams = EX.match_exam_events(events)
    assert {(r["event_id"], r["keyword_matched"]) for r in exams.collect()} == {(1, "exam"), (2, "test"), (4, "quiz"), (5, "exam")}
    students = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    alerts = {r["user_id"]: r for r in EX.exam_alert(exams, EX.pausable_subscriptions(verdicts), students).collect()}
    assert set(alerts) == {1, 3}
    assert alerts[1]["message"] == (
        "🎓 2 exam(s) detected in the next 30 days. Consider pausing A, B, C, D to save $25.50/mo during this period."
    )
    assert alerts[3]["total_monthly_savings"] == 0.0 and "none of your subscriptions" in alerts[3]["message"]
