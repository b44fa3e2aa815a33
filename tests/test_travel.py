import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import travel as TV
from spendcadence.operators import travel_features as TF

AWAY = "user_id int, seq long, reason string, departure_date date, return_date date, destination string, trigger_type string, confidence string"
RANK = {"high": 3, "medium": 2, "low": 1}


def brute(rows, gap=3):
    out = []
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        user, _, reason, start, end, place, trigger, confidence = r
        last = out[-1] if out and out[-1][0] == user else None
        if last and (start - last[2]).days <= gap:
            last[2] = max(last[2], end)
            if last[3] == "Unknown" and place != "Unknown":
                last[3] = place
            if RANK[confidence] > RANK[last[6]]:
                last[4], last[5], last[6] = reason, trigger, confidence
        else:
            out.append([user, start, end, place, reason, trigger, confidence])
    return {tuple(x) for x in out}


def periods(df):
    rows = TF.merge_away_periods(df).collect()
    return {(r["user_id"], r["departure_date"], r["return_date"], r["destination"], r["reason"], r["trigger_type"], r["confidence"]) for r in rows}


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def test_sample_and_gap_edge(spark):
    spans = [(1, 5), (8, 9), (13, 20), (14, 15), (23, 23), (27, 28)]
    rows = [(1, i, f"r{i}", day(a), day(b), "Unknown", "travel", "low") for i, (a, b) in enumerate(spans)]
    found = periods(spark.createDataFrame(rows, AWAY))
    assert {(p[1].day, p[2].day) for p in found} == {(1, 9), (13, 23), (27, 28)}


def test_random_periods_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        start = rng.randint(1, 400)
        rows.append((rng.randint(1, 4), i, f"r{i}", day(start), day(start + rng.randint(0, 6)), rng.choice(["Unknown", "Rome", "Oslo"]),
                     rng.choice(["travel", "work"]), rng.choice(list(RANK))))
    expected = brute(rows)
    for _ in range(2):
        rng.shuffle(rows)
        assert periods(spark.createDataFrame(rows, AWAY)) == expected


def test_undated_and_backward_rows(spark):
    rows = [(1, 1, "a", None, day(3), "Rome", "travel", "low"), (1, 2, "b", day(10), day(8), "Unknown", "travel", "low")]
    found = TF.merge_away_periods(spark.createDataFrame(rows, AWAY)).collect()
    assert sorted((r["reason"], r["return_date"]) for r in found) == [("a", day(3)), ("b", day(10))]


def test_savings_actions_and_alternatives(spark):
    subs = spark.createDataFrame(
        [(1, "Gym", "physical", True, True, 60.0, 10.0, True), (1, "Pool", "physical", False, True, 60.0, 0.0, True),
         (1, "Cable", "regional_service", False, True, 60.0, 12.0, True), (1, "Club", "physical", False, True, 60.0, 25.0, True),
         (1, "Flix", "portable", True, True, 60.0, 0.0, False), (1, "Dear", "physical", True, True, 60.0, 90.0, True)],
        "user_id int, name string, location_type string, can_pause boolean, can_cancel_and_rejoin boolean, monthly_cost double, "
        "cancellation_penalty double, is_local boolean",
    )
    away = spark.createDataFrame(
        [(1, 1, "trip", day(10), day(30), "Rome", "travel", "high"), (1, 2, "short", day(40), day(53), "Oslo", "travel", "high"),
         (1, 3, "past", day(1), day(20), "Nice", "travel", "high")], AWAY)
    recs = TV.travel_savings(subs, away, "2024-01-10")
    found = {r["subscription"]: r for r in recs.collect()}
    assert {k: r["action"] for k, r in found.items()} == {
        "Gym": TV.PAUSE[0], "Pool": TV.REJOIN[0], "Cable": TV.REJOIN_PENALTY[0], "Club": TV.CONSIDER[0]}
    assert found["Cable"]["action_detail"] == "Rejoin fee is $12.00, but you still save $28.00 net."
    assert (found["Gym"]["days_away"], found["Gym"]["months_away"], found["Gym"]["net_savings"]) == (20, 1, 30.0)
    assert TV.total_savings(recs).first()["total_savings"] == 30.0 + 40.0 + 28.0 + 15.0
    options = spark.createDataFrame(
        [("Gym", "Rome", [("x", 9.0), ("y", None), ("z", 0.0)], "x", "tip")],
        "subscription string, destination string, options array<struct<name:string,estimated_monthly_cost:double>>, best_value_option string, tip string")
    costs = {r["subscription"]: r for r in TV.alternative_cost(TV.attach_alternatives(recs, options)).collect()}
    assert (costs["Gym"]["cheapest_monthly"], costs["Gym"]["net_after_alternative"]) == (9.0, 31.0)
    assert costs["Pool"]["alternatives"]["alternatives_found"] is False and costs["Pool"]["cheapest_monthly"] is None


def test_top_n_keeps_the_rest_as_a_count(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    top = TV.top_n(df, ["k"], ["id"], 5)
    assert {(r["k"], r["more"]) for r in top.collect()} == {(1, 329), (0, 661)} and top.count() == 10
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "summary,location,description,place",
    [
        ("Trip", "Rome, Italy", "", "Rome, Italy"), ("Flight to New York City", "Zoom call", "", "New York City"),
        ("Weekend in Oslo,", "home", "", "Oslo"), ("Call", "", "visiting: Paris soon", "Paris soon"), ("lunch at Joe", "", "", "Joe"),
        ("go to X", "", "", "Unknown"), ("call", "", "", "Unknown"),
    ],
)
def test_destination(spark, summary, location, description, place):
    df = spark.createDataFrame([(summary, location, description)], "summary string, location string, description string")
    assert TF.with_destination(df).first()["destination"] == place


def test_features(spark):
    text = "flight to jfk airport, usa hotel sea meeting"
    df = spark.createDataFrame([(text,), ("usage",)], "text string")
    row, other = TF.event_features(df).collect()
    assert (row["travel_keyword_count"], row["local_keyword_count"], row["has_airport_code"], row["has_foreign_country"]) == (3, 1, 1, 1)
    assert (row["text_length"], row["travel_ratio"], other["has_foreign_country"], other["travel_ratio"]) == (len(text), 0.75, 0, 0.0)


def test_a_pair_that_many_share_is_joined_in_slots(spark):
    places = ["Boston"] * 60 + ["Miami"] * 7 + ["Unknown"] * 9 + [""] * 5 + [None] * 6 + ["Nowhere"] * 15
    rows = [(i, "Gym" if i % 13 else None, place, "portable" if i % 5 == 0 else "local") for i, place in enumerate(places)]
    recs = spark.createDataFrame(rows, "user_id int, subscription string, destination string, location_type string")
    found = spark.createDataFrame(
        [("Gym", "Boston", ["a"], "a", "t"), ("Gym", "Miami", [], None, "u")],
        "subscription string, destination string, options array<string>, best_value_option string, tip string",
    )
    eligible = F.col("destination").isin("Boston", "Miami", "Nowhere") & (F.col("location_type") != "portable")
    left, right = TV.pairs_in_slots(recs, found, eligible, hot_rows=5)
    heavy = sum(1 for i, name, place, kind in rows if place == "Boston" and kind != "portable" and name)
    slots = -(-heavy // 5)
    assert right.filter("destination = 'Boston'").count() == slots
    boston = left.filter(eligible & (F.col("destination") == "Boston") & F.col("subscription").isNotNull())
    assert boston.agg(F.countDistinct("_slot")).first()[0] > slots // 2
    many = TV.attach_alternatives(recs, found, hot_rows=5).select("user_id", "alternatives")
    one = TV.attach_alternatives(recs, found).select("user_id", "alternatives")
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect())) and many.count() == len(rows)
    told = {r["user_id"]: r["alternatives"] for r in many.collect()}
    for i, name, place, kind in rows:
        if kind == "portable" or place in ("", None, "Unknown"):
            assert told[i] is None
        else:
            assert told[i]["alternatives_found"] == (name == "Gym" and place in ("Boston", "Miami"))
