import pytest

from spendcadence.operators.classify import category_counts, classify_transactions

CASES = [
    # description, debit, credit, category, subscription, recurring, vendor
    ("NETFLIX.COM", 10.0, 0.0, "subscription", True, True, "Netflix"),
    ("YouTubePremium", 10.0, 0.0, "subscription", True, True, "YouTube"),
    ("BILL PAYMENT FLOW", 10.0, 0.0, "utilities", False, True, "BILL PAYMENT FLOW"),
    ("POS PURCHASE HI-LO FOODS", 10.0, 0.0, "dining", False, False, "Food"),
    ("POS PURCHASE HI-LO", 10.0, 0.0, "groceries", False, False, "Hi-Lo"),
    ("FUNDS TRANSFER FROM X", 0.0, 10000.0, "salary", False, True, "FUNDS TRANSFER FROM X"),
    ("FUNDS TRANSFER FROM X", 0.0, 9999.99, "transfer", False, False, "FUNDS TRANSFER FROM X"),
    ("TREATMENT CENTRE", 5.0, 0.0, "atm_withdrawal", False, False, "TREATMENT CENTRE"),
    ("ATM NETFLIX", 5.0, 0.0, "atm_withdrawal", True, True, "Netflix"),
    ("current account", 5.0, 0.0, "rent", False, True, "Rent"),
    ("ATM deposit", 0.0, 20000.0, "atm_withdrawal", False, True, "ATM deposit"),
    ("MORTGAGE 7", 5.0, 0.0, "loan_payment", False, True, "MORTGAGE 7"),
    ("something", 5.0, 0.0, "other", False, False, "something"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(1, i, d, debit, credit) for i, (d, debit, credit, *_) in enumerate(CASES)]
    return classify_transactions(spark.createDataFrame(rows, "account_id long, seq long, description string, debit double, credit double"))


def test_every_rule(classified):
    found = [tuple(r) for r in classified.orderBy("seq").select("category", "is_subscription", "is_recurring", "vendor_name").collect()]
    assert found == [tuple(c[3:]) for c in CASES]


def test_wide_tables(spark):
    rows = [(1, 1, "JPS ELECTRIC", 5.0, 0.0), (1, 2, "POS PURCHASE TOTAL GAS", 5.0, 0.0)]
    df = spark.createDataFrame(rows, "account_id long, seq long, description string, debit double, credit double")
    wide = {r["seq"]: (r["category"], r["vendor_name"]) for r in classify_transactions(df, wide=True).collect()}
    assert wide == {1: ("subscription", "JPS"), 2: ("transport", "Total")}


def test_counts(classified):
    counts = {r["category"]: r["transactions"] for r in category_counts(classified).collect()}
    assert counts["subscription"] == 2 and sum(counts.values()) == len(CASES)


def test_one_projection_without_shuffle(classified):
    plan = classified._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
