"""Rule-based classification of transactions (no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.functions.fence import compute_once

SALARY_THRESHOLD = 10_000.0


def with_cased(df: DataFrame, text: str = "description") -> DataFrame:
    """Add ``_up`` and ``_low``, the texts the rules look at."""
    return df.withColumn("_up", F.upper(F.coalesce(F.col(text), F.lit("")))).withColumn("_low", F.lower("_up"))


def match_subscription(rules: Sequence[tuple[str, str]] = R.SUBSCRIPTION_RULES) -> Column:
    """Display name of the subscription service, null for none and for bill payments."""
    return F.when(~T.contains_any("_up", ["BILL PAYMENT"]), T.first_rule("_low", rules))


def match_tx_pattern() -> Column:
    """Category of the first statement phrase in the description."""
    return T.first_rule("_up", R.TRANSACTION_RULES)


def match_vendor(rules: Sequence[tuple[str, str]] = R.VENDOR_RULES) -> Column:
    """Index of the first vendor keyword in the description."""
    return T.first_rule("_low", [(keyword, i) for i, (keyword, _) in enumerate(rules)])


def vendor_category(index: Column, rules: Sequence[tuple[str, str]] = R.VENDOR_RULES) -> Column:
    return F.get(F.array(*[F.lit(category) for _, category in rules]), index)


def vendor_title(index: Column, rules: Sequence[tuple[str, str]] = R.VENDOR_RULES) -> Column:
    """The keyword itself, title-cased, is the vendor's display name."""
    return F.get(F.array(*[F.lit(keyword.title()) for keyword, _ in rules]), index)


def is_salary_credit(credit: Column, category: Column, threshold: float = SALARY_THRESHOLD) -> Column:
    """A large credit that no other rule explains."""
    return (credit > 0) & (credit >= threshold) & category.isin("transfer", "other")


def is_cash_machine() -> Column:
    return T.contains_any("_up", ["ABM", "ATM"])


def is_recurring_category(category: Column) -> Column:
    return category.isin(*R.EXPENSE_CATEGORIES)


def classify_transactions(
    tx: DataFrame, wide: bool = False, salary_threshold: float = SALARY_THRESHOLD
) -> DataFrame:
    """Add ``category, is_subscription, is_recurring, vendor_name``.

    ``wide`` selects the longer rule tables.  Pure projection: the steps are
    separate selects so that each rule chain is evaluated once per row.
    """
    subscriptions = R.SUBSCRIPTION_RULES_WIDE if wide else R.SUBSCRIPTION_RULES
    vendors = R.VENDOR_RULES_WIDE if wide else R.VENDOR_RULES
    named = with_cased(tx).withColumn("_service", match_subscription(subscriptions))
    service = F.col("_service")
    phrased = named.withColumn(
        "_category",
        F.when(service.isNotNull(), F.lit("subscription")).otherwise(
            F.coalesce(match_tx_pattern(), F.lit("other"))
        ),
    )
    category, vendor = F.col("_category"), F.col("_vendor")
    vended = phrased.withColumn(
        "_vendor", F.when(category.isin("shopping", "other"), match_vendor(vendors))
    ).withColumn("_category", F.coalesce(vendor_category(vendor, vendors), category))
    salary = is_salary_credit(F.col("credit"), category, salary_threshold)
    paid = vended.withColumn("_salary", salary).withColumn(
        "_final",
        F.when(is_cash_machine(), F.lit("atm_withdrawal"))
        .when(F.col("_salary"), F.lit("salary"))
        .otherwise(category),
    )
    final = F.col("_final")
    return compute_once(
        paid,
        {
            "category": final,
            "is_subscription": service.isNotNull(),
            "is_recurring": service.isNotNull() | F.col("_salary") | is_recurring_category(final),
            "vendor_name": F.coalesce(vendor_title(vendor, vendors), service, F.col("description")),
        },
        drop=("_low", "_up", "_service", "_category", "_vendor", "_salary", "_final"),
    )


def category_counts(classified: DataFrame, key: str = "account_id") -> DataFrame:
    """Transactions per category."""
    return classified.groupBy(key, "category").agg(F.count(F.lit(1)).alias("transactions"))
