import math
import random

from spendcadence.operators import risk as RK


def test_scores_equal_brute_force(spark):
    rng = random.Random(5)
    subs, pay, costs = [], [], []
    for a in range(20):
        pay.append((a, float(rng.choice([0, 50000, 150000])), rng.randint(1, 31), rng.choice(["monthly", "biweekly"]), 3))
        subs += [(a, f"S{i}", 10.0 * i, rng.randint(1, 31), i, 4, i / 4) for i in range(4)]
        costs += [(a, f"E{i}", float(rng.randint(1000, 40000)), rng.randint(1, 31)) for i in range(rng.randint(0, 5))]
    s = spark.createDataFrame(subs, "account_id int, name string, amount double, renewal_day int, past_failures long, total_months long, fail_rate double")
    p = spark.createDataFrame(pay, "account_id int, amount double, pay_day int, frequency string, occurrences long")
    e = spark.createDataFrame(costs, "account_id int, name string, amount double, day int")
    found = {(r["account_id"], r["subscription"]): r for r in RK.risk_report(s, p, e).collect()}
    assert len(found) == len(subs)
    for a, name, _, day, fails, months, rate in subs:
        _, salary, pay_day, freq, _ = pay[a]
        since = day - pay_day if day >= pay_day else 30 - pay_day + day
        position = min(since / (30 if freq == "monthly" else 14), 1.0)
        mine = [(x, d) for aa, _, x, d in costs if aa == a]
        before = sum(x for x, d in mine if d <= day)
        near = sum(x for x, d in mine if min(abs(d - day), 30 - abs(d - day)) <= 3)
        share = lambda v: min(v / salary, 1.0) if salary > 0 else 0.5
        raw = 0.35 * position + 0.25 * share(near) + 0.25 * rate + 0.15 * share(before)
        score = round(1 / (1 + math.exp(-8 * (raw - 0.45))), 2)
        row = found[(a, name)]
        assert row["risk_score"] == score
        level = "low" if score <= 0.3 else "moderate" if score <= 0.55 else "high" if score <= 0.75 else "critical"
        assert row["risk_level"] == level and row["fail_history"] == f"{fails}/{months}"
        zone = "safe" if position <= 0.3 else "moderate" if position <= 0.6 else "high" if position <= 0.8 else "critical"
        assert row["breakdown"]["zone_level"] == zone and row["breakdown"]["cluster_amount"] == near


def test_map_and_summary(spark):
    p = spark.createDataFrame([(1, 1000.0, 25, "monthly", 2)], "account_id int, amount double, pay_day int, frequency string, occurrences long")
    s = spark.createDataFrame([(1, "B", 10.0, 3, 0, 4, 0.0), (1, "A", 20.0, 3, 0, 4, 0.0)],
                              "account_id int, name string, amount double, renewal_day int, past_failures long, total_months long, fail_rate double")
    e = spark.createDataFrame([(1, "Rent", 400.0, 1)], "account_id int, name string, amount double, day int")
    days = {r["day"]: r for r in RK.paycycle_map(p, s).collect()}
    assert len(days) == 30 and days[3]["subscription"] == "A" and days[25]["is_payday"] and days[24]["zone"] == "critical"
    row = RK.account_summary(RK.risk_report(s, p, e), p, e).first()
    assert (row["total_subscriptions"], row["total_sub_cost"], row["total_expenses"], row["income_remaining"]) == (2, 30.0, 400.0, 570.0)
