"""Queries over transactions: classification, patterns, price changes, renewals and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.operators import changes as CH
from spendcadence.operators import classify as CL
from spendcadence.operators import patterns as PT
from spendcadence.operators import renewals as RN
from spendcadence.operators import risk as RK
from spendcadence.plans import adapters as A
from spendcadence.plans import oracle_base as S
from spendcadence.plans.registry import query
from spendcadence.session import stored
from spendcadence.sinks import reports as RP


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return CL.classify_transactions(A.transactions(spark, sf))


# Rule lookups also run over the whole document texts, which hit far more keywords.
_TEXTS_SQL = "(SELECT o_orderkey AS id, description FROM orders JOIN (SELECT seq, description FROM tx) ON seq = o_orderkey " \
             "UNION ALL SELECT -1 - doc_id, text FROM documents)"


def _descriptions(spark: SparkSession, sf: str) -> DataFrame:
    tx = A.transactions(spark, sf).select(F.col("seq").alias("id"), "description")
    docs = A.table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("description"))
    return tx.unionByName(docs)


@query(
    "cls_01_match_subscription",
    S.build(
        f"""SELECT id, CASE WHEN NOT contains(upper(description), 'BILL PAYMENT')
                       THEN {S.first_rule('lower(description)', R.SUBSCRIPTION_RULES)} END AS service,
                   CASE WHEN NOT contains(upper(description), 'BILL PAYMENT')
                       THEN {S.first_rule('lower(description)', R.SUBSCRIPTION_RULES_WIDE)} END AS service_wide FROM {_TEXTS_SQL}""",
        ["tx"],
    ),
)
def match_subscription(spark: SparkSession, sf: str) -> DataFrame:
    return CL.with_cased(_descriptions(spark, sf)).select(
        "id",
        CL.match_subscription().alias("service"),
        CL.match_subscription(R.SUBSCRIPTION_RULES_WIDE).alias("service_wide"),
    )


@query(
    "cls_02_match_tx_pattern",
    S.build(f"SELECT id, {S.first_rule('upper(description)', R.TRANSACTION_RULES)} AS category FROM {_TEXTS_SQL}", ["tx"]),
)
def match_tx_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return CL.with_cased(_descriptions(spark, sf)).select("id", CL.match_tx_pattern().alias("category"))


def _vendor_sql(rules, suffix: str) -> str:
    return (
        f"{S.first_rule('lower(description)', rules)} AS category{suffix}, "
        f"{S.first_rule('lower(description)', [(k, k.title()) for k, _ in rules])} AS vendor{suffix}"
    )


@query(
    "cls_03_match_vendor",
    S.build(
        f"SELECT id, {_vendor_sql(R.VENDOR_RULES, '')}, {_vendor_sql(R.VENDOR_RULES_WIDE, '_wide')} FROM {_TEXTS_SQL}", ["tx"]
    ),
)
def match_vendor(spark: SparkSession, sf: str) -> DataFrame:
    found = CL.with_cased(_descriptions(spark, sf)).withColumns(
        {"narrow": CL.match_vendor(), "wide": CL.match_vendor(R.VENDOR_RULES_WIDE)}
    )
    return found.select(
        "id",
        CL.vendor_category(F.col("narrow")).alias("category"),
        CL.vendor_title(F.col("narrow")).alias("vendor"),
        CL.vendor_category(F.col("wide"), R.VENDOR_RULES_WIDE).alias("category_wide"),
        CL.vendor_title(F.col("wide"), R.VENDOR_RULES_WIDE).alias("vendor_wide"),
    )


@query(
    "cls_04_flag_salary_credit",
    S.build("SELECT account_id, seq, credit FROM cls WHERE category = 'salary'", ["cls"]),
)
def flag_salary_credit(spark: SparkSession, sf: str) -> DataFrame:
    tx = CL.with_cased(A.transactions(spark, sf))
    category = F.coalesce(CL.match_tx_pattern(), F.lit("other"))
    return tx.filter(CL.is_salary_credit(F.col("credit"), category)).select("account_id", "seq", "credit")


@query(
    "cls_05_atm_override",
    S.build(
        f"SELECT id, (contains(upper(description), 'ABM') OR contains(upper(description), 'ATM')) AS cash FROM {_TEXTS_SQL}", ["tx"]
    ),
)
def atm_override(spark: SparkSession, sf: str) -> DataFrame:
    return CL.with_cased(_descriptions(spark, sf)).select("id", CL.is_cash_machine().alias("cash"))


@query("cls_06_flag_recurring", S.build("SELECT account_id, seq, is_recurring FROM cls", ["cls"]))
def flag_recurring(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("account_id", "seq", "is_recurring")


_CLS_COLUMNS = ["account_id", "seq", "category", "is_subscription", "is_recurring", "vendor_name"]


@query("cls_07_classify_transactions", S.build(f"SELECT {', '.join(_CLS_COLUMNS)} FROM cls", ["cls"]))
def classify_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select(*_CLS_COLUMNS)


@query(
    "cls_07_classify_transactions_wide",
    S.build(f"SELECT {', '.join(_CLS_COLUMNS)} FROM cls", ["cls"], {"cls": S.classified_wide()}),
)
def classify_transactions_wide(spark: SparkSession, sf: str) -> DataFrame:
    return CL.classify_transactions(A.transactions(spark, sf), wide=True).select(*_CLS_COLUMNS)


@query("cls_08_title_case", S.build(f"SELECT seq, {S.title('vendor_name')} AS title FROM cls", ["cls"]))
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("seq", T.title_case(F.col("vendor_name")).alias("title"))


@query("cls_09_vendor_key", S.build("SELECT seq, lower(trim(vendor_name)) AS vendor FROM cls", ["cls"]))
def vendor_key(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("seq", T.vendor_key(F.col("vendor_name")).alias("vendor"))


@query(
    "cls_10_category_counts",
    S.build("SELECT account_id, category, count(*) AS transactions FROM cls GROUP BY ALL", ["cls"]),
)
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return CL.category_counts(classified(spark, sf)).orderBy("account_id", F.desc("transactions"), "category")


# --- patterns -------------------------------------------------------------------


@query(
    "pat_01_cluster_amounts",
    S.build(
        f"""SELECT account_id, leader_no, leaders[leader_no] AS leader, {S.iso('date')} AS date, count(*) AS occurrences,
                   sum(credit) AS total FROM clustered GROUP BY ALL""",
        ["clustered"],
    ),
)
def cluster_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return PT.cluster_amounts(A.transactions(spark, sf))


@query("pat_02_salary_group", S.build("SELECT account_id, leader_no, occurrences, total FROM salary", ["salary"]))
def salary_group(spark: SparkSession, sf: str) -> DataFrame:
    totals = PT.cluster_totals(PT.cluster_amounts(A.transactions(spark, sf)))
    return PT.salary_group(totals).select("account_id", "leader_no", "occurrences", "total")


_MODAL = """SELECT account_id, vendor, day AS modal_day
  FROM (SELECT account_id, lower(trim(vendor_name)) AS vendor, day(date)::INT AS day,
               row_number() OVER (PARTITION BY account_id, lower(trim(vendor_name)) ORDER BY count(*) DESC, day(date)) AS r
        FROM cls GROUP BY account_id, lower(trim(vendor_name)), day(date)) WHERE r = 1"""


@query("pat_03_modal_day", S.build(_MODAL, ["cls"]))
def modal_day(spark: SparkSession, sf: str) -> DataFrame:
    return PT.modal_day(PT.vendor_day_counts(classified(spark, sf)), ["account_id", "vendor"])


@query("pat_04_pay_frequency", S.build("SELECT account_id, frequency FROM salary", ["salary"]))
def pay_frequency(spark: SparkSession, sf: str) -> DataFrame:
    best = PT.salary_group(PT.cluster_totals(PT.cluster_amounts(A.transactions(spark, sf))))
    return best.select(
        "account_id",
        PT.pay_frequency(F.col("first_date"), F.col("last_date"), F.col("occurrences")).alias("frequency"),
    )


SALARY_SQL = "SELECT account_id, amount, pay_day, frequency, occurrences FROM salary"


@query("pat_05_detect_salary", S.build(SALARY_SQL, ["salary"]))
def detect_salary(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_salary(A.transactions(spark, sf))


SUBSCRIPTIONS_SQL = """SELECT account_id, name, amount, day AS renewal_day, failures AS past_failures, n AS total_months,
                              failures::DOUBLE / n AS fail_rate FROM subscriptions"""


@query("pat_06_detect_subscriptions", S.build(SUBSCRIPTIONS_SQL, ["subscriptions"]))
def detect_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_subscriptions(classified(spark, sf))


@query(
    "pat_07_renewal_failures",
    S.build(
        "SELECT account_id, name, failures AS past_failures, failures::DOUBLE / n AS fail_rate FROM subscriptions",
        ["subscriptions"],
    ),
)
def renewal_failures(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_subscriptions(classified(spark, sf)).select("account_id", "name", "past_failures", "fail_rate")


@query("pat_08_detect_expenses", S.build("SELECT account_id, name, amount, day FROM expenses", ["expenses"]))
def detect_expenses(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_expenses(classified(spark, sf))


# --- price changes --------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return CH.price_pairs(CH.subscription_charges(classified(spark, sf)))


@query(
    "prc_01_pairwise_price_change",
    S.build(
        f"""SELECT account_id, vendor, {S.iso('date')} AS date, seq, old_amount AS previous, new_amount AS debit, change_amount,
                   change_percent FROM jumps""",
        ["jumps"],
    ),
)
def pairwise_price_change(spark: SparkSession, sf: str) -> DataFrame:
    return CH.pairwise_price_change(_pairs(spark, sf))


_FINDING_SQL = f"""account_id, vendor, {S.iso('date')} AS date, type, old_amount, new_amount, change_amount, change_percent,
  severity, description"""


@query("prc_02_label_price_change", S.build(f"SELECT {_FINDING_SQL} FROM jumps", ["jumps"]))
def label_price_change(spark: SparkSession, sf: str) -> DataFrame:
    return CH.label_price_change(CH.pairwise_price_change(_pairs(spark, sf))).drop("seq")


@query(
    "prc_03_trial_conversion",
    S.build(
        f"""SELECT account_id, vendor, {S.iso('date')} AS date, seq, 'Trial Conversion' AS type, previous AS old_amount,
                   debit AS new_amount, debit - previous AS change_amount, 100::DOUBLE AS change_percent, 'info' AS severity,
                   'Free trial ended. Now billing $' || {S.money('debit')} || '/cycle.' AS description
            FROM pairs WHERE previous = 0 AND debit > 0""",
        ["pairs"],
        {
            "tx": S.tx_with_free_charges(),
            "charges": "SELECT *, lower(trim(vendor_name)) AS vendor FROM cls WHERE is_subscription AND debit >= 0",
        },
    ),
)
def trial_conversion(spark: SparkSession, sf: str) -> DataFrame:
    free = CL.classify_transactions(A.transactions(spark, sf, free_first=True))
    return CH.trial_conversion(CH.price_pairs(CH.subscription_charges(free, include_zero=True)))


@query(
    "prc_04_cusum_drift",
    S.build(
        f"""SELECT account_id, vendor, {S.iso('date')} AS date, seq, old_amount, new_amount, is_up FROM drift""", ["drift"]
    ),
)
def cusum_drift(spark: SparkSession, sf: str) -> DataFrame:
    return CH.cusum_drift(CH.subscription_charges(classified(spark, sf)))


CHANGES_SQL = f"""SELECT account_id, {S.title('vendor')} AS subscription, type, {S.iso('date')} AS date, old_amount, new_amount,
                   change_amount, change_percent, severity, description
            FROM (SELECT account_id, vendor, type, date, old_amount, new_amount, change_amount, change_percent, severity, description
                  FROM jumps
                  UNION ALL
                  SELECT account_id, vendor, type, date, old_amount, new_amount, change_amount, change_percent, severity, description
                  FROM drift d WHERE NOT EXISTS (SELECT 1 FROM jumps j WHERE j.account_id = d.account_id AND j.vendor = d.vendor
                                                 AND j.date = d.date))"""


@query("prc_05_detect_price_changes", S.build(CHANGES_SQL, ["jumps", "drift"]))
def detect_price_changes(spark: SparkSession, sf: str) -> DataFrame:
    return CH.detect_price_changes(classified(spark, sf)).orderBy("account_id", "date", "subscription")


# --- renewals -------------------------------------------------------------------


@query(
    "ren_01_charge_intervals",
    S.build(
        f"""SELECT account_id, vendor, gap::INT AS gap, count(*) AS times FROM gaps WHERE gap > 0 GROUP BY ALL""", ["gaps"]
    ),
)
def charge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    days = RN.charge_days(classified(spark, sf))
    gaps = days.select("account_id", "vendor", F.explode(RN.charge_intervals(F.col("days"))).alias("gap"))
    return gaps.groupBy("account_id", "vendor", "gap").agg(F.count(F.lit(1)).alias("times"))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return RN.interval_profile(RN.charge_days(classified(spark, sf)))


@query(
    "ren_02_median_interval",
    S.build("SELECT account_id, vendor, list_median(gaps)::DOUBLE AS median FROM intervals WHERE m > 0", ["intervals"]),
)
def median_interval(spark: SparkSession, sf: str) -> DataFrame:
    days = RN.charge_days(classified(spark, sf)).withColumn("gaps", F.array_sort(RN.charge_intervals(F.col("days"))))
    return days.filter(F.size("gaps") > 0).select(
        "account_id", "vendor", RN.median_interval(F.col("gaps")).alias("median")
    )


@query(
    "ren_03_index_iqr",
    S.build("SELECT account_id, vendor, iqr::INT AS iqr FROM intervals WHERE iqr IS NOT NULL", ["intervals"]),
)
def index_iqr(spark: SparkSession, sf: str) -> DataFrame:
    profile = _profile(spark, sf)
    return profile.filter(F.col("method") == "median_iqr").select(
        "account_id", "vendor", RN.index_iqr(F.col("gaps")).alias("iqr")
    )


@query(
    "ren_04_interval_confidence",
    S.build("SELECT account_id, vendor, band_days, confidence_label FROM profile WHERE n >= 3", ["profile"]),
)
def interval_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).filter("data_points >= 3").select("account_id", "vendor", "band_days", "confidence_label")


@query(
    "ren_05_cold_start_prior",
    S.build("SELECT account_id, vendor, n AS data_points, median_interval_days, band_days, method FROM profile", ["profile"]),
)
def cold_start_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select("account_id", "vendor", "data_points", "median_interval_days", "band_days", "method")


@query(
    "ren_06_roll_forward",
    S.build(
        f"SELECT account_id, vendor, {S.iso('last_date')} AS last_charge_date, {S.iso('next_date')} AS next_charge_date FROM profile",
        ["profile"],
    ),
)
def roll_forward(spark: SparkSession, sf: str) -> DataFrame:
    last = F.element_at("days", -1)
    today = F.to_date(F.lit(A.TODAY_RENEWALS))
    return _profile(spark, sf).select(
        "account_id", "vendor", last.alias("last_charge_date"),
        RN.roll_forward(last, F.col("median_interval_days"), today).alias("next_charge_date"),
    )


_PREDICTION_SQL = f"""
  SELECT account_id, {S.title('vendor')} AS subscription, {S.iso('next_date')} AS next_charge_date,
         date_diff('day', DATE '2001-08-15', next_date)::INT AS days_until_charge, median_interval_days,
         {S.iso('next_date - band_days')} AS earliest, {S.iso('next_date + band_days')} AS latest, band_days,
         confidence_label, method, n AS data_points, {S.iso('last_date')} AS last_charge_date FROM profile"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return RN.predict_renewals(classified(spark, sf), A.TODAY_RENEWALS)


@query("ren_07_predict_renewals", S.build(_PREDICTION_SQL, ["profile"]))
def predict_renewals(spark: SparkSession, sf: str) -> DataFrame:
    flat = predictions(spark, sf).select("*", "confidence_window.*").drop("confidence_window")
    dated = flat.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest", "latest")})
    return dated.orderBy("days_until_charge", "account_id", "subscription")


@query(
    "ren_08_charge_urgency",
    S.build(
        f"""SELECT account_id, subscription, CASE WHEN days_until_charge <= 3 THEN 'urgent' WHEN days_until_charge <= 7 THEN 'soon'
                   ELSE 'later' END AS urgency FROM ({_PREDICTION_SQL})""",
        ["profile"],
    ),
)
def charge_urgency(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select(
        "account_id", "subscription", RN.charge_urgency(F.col("days_until_charge")).alias("urgency")
    )


# --- risk -----------------------------------------------------------------------


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = classified(spark, sf)
    return PT.detect_subscriptions(rows), PT.detect_salary(rows), PT.detect_expenses(rows)


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return PT.detect_salary(A.transactions(spark, sf)).select(
        "account_id", "pay_day", "frequency", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day")
    )


_DAYS_SQL = "(SELECT account_id, pay_day, frequency, unnest(range(1, 32))::INT AS day FROM salary)"


@query(
    "rsk_01_payday_distance",
    S.build(
        f"""SELECT account_id, day, {S.SINCE.format(d='day')}::INT AS days_since, {S.UNTIL.format(d='day')}::INT AS days_until
            FROM {_DAYS_SQL}""",
        ["salary"],
    ),
)
def payday_distance(spark: SparkSession, sf: str) -> DataFrame:
    day, pay_day = F.col("day"), F.col("pay_day")
    return _days(spark, sf).select(
        "account_id", "day", RK.days_since_payday(day, pay_day).alias("days_since"),
        RK.days_until_payday(day, pay_day).alias("days_until"),
    )


@query(
    "rsk_02_paycycle_position",
    S.build(f"SELECT account_id, day, {S.POSITION.format(d='day')} AS position FROM {_DAYS_SQL}", ["salary"]),
)
def paycycle_position(spark: SparkSession, sf: str) -> DataFrame:
    position = RK.paycycle_position(F.col("day"), F.col("pay_day"), F.col("frequency"))
    return _days(spark, sf).select("account_id", "day", position.alias("position"))


@query(
    "rsk_03_paycycle_zone",
    S.build(
        f"""SELECT account_id, day, {S.ZONE_LABEL.format(p='p')} AS label, {S.ZONE_LEVEL.format(p='p')} AS level
            FROM (SELECT account_id, day, {S.POSITION.format(d='day')} AS p FROM {_DAYS_SQL})""",
        ["salary"],
    ),
)
def paycycle_zone(spark: SparkSession, sf: str) -> DataFrame:
    return paycycle_position(spark, sf).select("account_id", "day", RK.paycycle_zone(F.col("position")).alias("z")).select(
        "account_id", "day", "z.*"
    )


def _loads(spark: SparkSession, sf: str) -> DataFrame:
    return RK.renewal_loads(*_inputs(spark, sf))


@query(
    "rsk_04_expenses_before_day",
    S.build("SELECT account_id, name, renewal_day, spent_before, load_factor FROM factors", ["factors"]),
)
def expenses_before_day(spark: SparkSession, sf: str) -> DataFrame:
    return _loads(spark, sf).select(
        "account_id", "name", "renewal_day", "spent_before",
        RK.income_share(F.col("spent_before"), F.col("salary")).alias("load_factor"),
    )


@query(
    "rsk_05_expense_cluster",
    S.build("SELECT account_id, name, renewal_day, cluster_amount, cluster_factor FROM factors", ["factors"]),
)
def expense_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return _loads(spark, sf).select(
        "account_id", "name", "renewal_day", "cluster_amount",
        RK.income_share(F.col("cluster_amount"), F.col("salary")).alias("cluster_factor"),
    )


@query("rsk_06_renewal_risk", S.build("SELECT account_id, name AS subscription, risk_score FROM risks", ["risks"]))
def renewal_risk(spark: SparkSession, sf: str) -> DataFrame:
    return RK.score_renewals(_loads(spark, sf)).select("account_id", "subscription", "risk_score")


@query(
    "rsk_07_risk_label",
    S.build(
        """SELECT account_id, name AS subscription, risk_label, lower(risk_label) AS risk_level, advice,
                  past_failures || '/' || total_months AS fail_history FROM risks""",
        ["risks"],
    ),
)
def risk_label(spark: SparkSession, sf: str) -> DataFrame:
    return RK.score_renewals(_loads(spark, sf)).select(
        "account_id", "subscription", "risk_label", "risk_level", "advice", "fail_history"
    )


RISK_SQL = f"""SELECT account_id, name AS subscription, amount, renewal_day, risk_score, risk_label, lower(risk_label) AS risk_level,
                   advice, past_failures || '/' || total_months AS fail_history, paycycle_factor, cluster_factor, fail_rate,
                   load_factor, {S.ZONE_LABEL.format(p='paycycle_factor')} AS zone_label,
                   {S.ZONE_LEVEL.format(p='paycycle_factor')} AS zone_level,
                   {S.SINCE.format(d='renewal_day')}::INT AS days_since_payday, {S.UNTIL.format(d='renewal_day')}::INT AS days_until_payday,
                   cluster_amount FROM risks"""


@query("rsk_08_risk_report", S.build(RISK_SQL, ["risks"]))
def risk_report(spark: SparkSession, sf: str) -> DataFrame:
    return RK.risk_report(*_inputs(spark, sf)).select("*", "breakdown.*").drop("breakdown")


@query(
    "rsk_09_paycycle_map",
    S.build(
        f"""SELECT d.account_id, d.day, d.position, {S.ZONE_LEVEL.format(p='d.position')} AS zone, d.is_payday, s.subscription
            FROM (SELECT account_id, day, {S.POSITION.format(d='day')} AS position, day = pay_day AS is_payday
                  FROM {_DAYS_SQL} WHERE day <= 30) d
            LEFT JOIN (SELECT account_id, day, min(name) AS subscription FROM subscriptions GROUP BY ALL) s USING (account_id, day)""",
        ["salary", "subscriptions"],
    ),
)
def paycycle_map(spark: SparkSession, sf: str) -> DataFrame:
    subscriptions, salary, _ = _inputs(spark, sf)
    return RK.paycycle_map(salary, subscriptions)


@query(
    "rsk_10_account_summary",
    S.build(
        """SELECT account_id, coalesce(n, 0)::BIGINT AS total_subscriptions, coalesce(high, 0)::BIGINT AS high_risk_count,
                  coalesce(cost, 0)::DOUBLE AS total_sub_cost, coalesce(spent, 0)::DOUBLE AS total_expenses,
                  (CAST(p.amount AS DECIMAL(18, 2)) - coalesce(spent, 0) - coalesce(cost, 0))::DOUBLE AS income_remaining
           FROM salary p
           LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (WHERE risk_label IN ('HIGH', 'CRITICAL')) AS high,
                             sum(CAST(amount AS DECIMAL(18, 2))) AS cost FROM risks GROUP BY ALL) USING (account_id)
           LEFT JOIN (SELECT account_id, sum(CAST(amount AS DECIMAL(18, 2))) AS spent FROM expenses GROUP BY ALL) USING (account_id)""",
        ["risks", "salary", "expenses"],
    ),
)
def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    subscriptions, salary, expenses = _inputs(spark, sf)
    risks = RK.score_renewals(RK.renewal_loads(subscriptions, salary, expenses))
    return RK.account_summary(risks, salary, expenses)


# --- sinks ----------------------------------------------------------------------


def statement_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All sections read one classified table, which is written once below the checkpoint folder.

    So is the salary that four of them need: inside the union each would work out all accounts' salaries in one task.
    """
    rows = stored(classified(spark, sf))
    salary = stored(PT.detect_salary(rows))
    subscriptions, expenses = PT.detect_subscriptions(rows), PT.detect_expenses(rows)
    risks = RK.score_renewals(RK.renewal_loads(subscriptions, salary, expenses))
    return RP.statement_report(
        rows, salary, expenses, risks, RK.paycycle_map(salary, subscriptions), CH.detect_price_changes(rows),
        RN.predict_renewals(rows, A.TODAY_RENEWALS), RK.account_summary(risks, salary, expenses),
        CL.category_counts(rows), parts=max(1, -(-rows.count() // RP.ROWS_PER_TASK)),
    )


def _names(path: str):
    return F.array_join(path, ",")


@query(
    "snk_01_statement_report",
    S.build(
        f"""SELECT account_id, '' AS month, amount AS salary, categories, subscriptions, expenses,
                   (CASE WHEN amount IS NULL THEN 0 ELSE 30 END)::INT AS paycycle_days, NULL::BIGINT AS transactions,
                   NULL AS transaction_texts, NULL AS price_changes, predictions
            FROM (SELECT account_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM cls GROUP BY ALL)
            LEFT JOIN (SELECT account_id, amount FROM salary) USING (account_id)
            LEFT JOIN (SELECT account_id, string_agg(name, ',' ORDER BY risk_score DESC, name) AS subscriptions
                       FROM risks GROUP BY ALL) USING (account_id)
            LEFT JOIN (SELECT account_id, string_agg(name, ',' ORDER BY name) AS expenses FROM expenses GROUP BY ALL) USING (account_id)
            LEFT JOIN (SELECT account_id, string_agg(subscription, ',' ORDER BY days_until_charge, subscription) AS predictions
                       FROM ({_PREDICTION_SQL}) GROUP BY ALL) USING (account_id)
            UNION ALL
            SELECT account_id, month, NULL, NULL, NULL, NULL, 0, n, texts, changes, NULL
            FROM (SELECT account_id, strftime(date, '%Y-%m') AS month, count(*) AS n,
                         md5(string_agg(description, '|' ORDER BY seq)) AS texts FROM cls GROUP BY ALL)
            LEFT JOIN (SELECT account_id, substr(date, 1, 7) AS month,
                              string_agg(type, ',' ORDER BY date, subscription, type, new_amount) AS changes
                       FROM ({CHANGES_SQL}) GROUP BY ALL) USING (account_id, month)""",
        ["cls", "salary", "risks", "expenses", "jumps", "drift", "profile"],
    ),
)
def statement_report(spark: SparkSession, sf: str) -> DataFrame:
    transactions = F.col("transactions")
    return statement_documents(spark, sf).select(
        "account_id",
        "month",
        F.col("salary.amount").alias("salary"),
        _names("categories.category").alias("categories"),
        _names("subscriptions.subscription").alias("subscriptions"),
        _names("expenses.name").alias("expenses"),
        F.coalesce(F.size("paycycle_map"), F.lit(0)).alias("paycycle_days"),
        F.when(transactions.isNotNull(), F.size(transactions).cast("bigint")).alias("transactions"),
        F.md5(F.array_join("transactions.description", "|")).alias("transaction_texts"),
        _names("price_changes.type").alias("price_changes"),
        _names("renewal_predictions.subscription").alias("predictions"),
    )


@query(
    "snk_02_transaction_export",
    S.build(
        f"SELECT account_id, {S.iso('date')} AS date, description, debit, credit, category, vendor_name, is_subscription FROM cls",
        ["cls"],
    ),
)
def transaction_export(spark: SparkSession, sf: str) -> DataFrame:
    return RP.transaction_export(classified(spark, sf))
