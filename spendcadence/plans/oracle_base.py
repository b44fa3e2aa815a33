"""SQL building blocks: the adapters and shared steps as common table expressions."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Sequence

import pyspark

from spendcadence.functions import rules as R
from spendcadence.plans import adapters as A


def quote(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return f"{value}::DOUBLE" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def pick(index: str, values: Sequence[object]) -> str:
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"(CASE {index} {arms} END)"


def first_rule(text: str, rules: Sequence[tuple[str, object]]) -> str:
    arms = " ".join(f"WHEN contains({text}, {quote(k)}) THEN {quote(v)}" for k, v in rules)
    return f"(CASE {arms} END)"


def any_of(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def count_of(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {quote(w)})::INT" for w in words) + ")"


def lookup(key: str, table: dict[str, float], default: float) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {float(v)}::DOUBLE" for k, v in table.items())
    return f"(CASE {key} {arms} ELSE {float(default)}::DOUBLE END)"


def title(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda run: upper(run[1:1]) || lower(run[2:])), '')"
    )


def money(value: str) -> str:
    return f"printf('%.2f', round_even(({value})::DOUBLE, 2))"


def iso(date: str) -> str:
    return f"strftime({date}, '%Y-%m-%d')"


def _tx(free_first: bool) -> str:
    debit = "base + drift + (CASE WHEN seq % 17 = 0 THEN base ELSE 0 END)"
    if free_first:
        debit = f"CASE WHEN seq % 31 = 0 THEN 0 ELSE {debit} END"
    return f"""
      SELECT account_id, seq, date, description,
             CASE WHEN k IN (7, 11) THEN 0 ELSE {debit} END::DOUBLE AS debit,
             CASE k WHEN 7 THEN base + 1000 * (seq % 3) + (CASE WHEN seq % 29 = 0 THEN 20000 ELSE 0 END)
                    WHEN 11 THEN base + 100 * (seq % 5) ELSE 0 END::DOUBLE AS credit,
             0::DOUBLE AS balance
      FROM (SELECT o_custkey // 10 AS account_id, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date,
                   o_orderkey % 12 AS k, {pick('o_orderkey % 12', [t for t, _, _ in A.TX_KINDS])} AS description,
                   {pick('o_orderkey % 12', [float(b) for _, b, _ in A.TX_KINDS])} AS base,
                   (year(o_orderdate) - 1995) * 25 AS drift
            FROM orders)"""


def _classified(source: str, wide: bool = False) -> str:
    subs = R.SUBSCRIPTION_RULES_WIDE if wide else R.SUBSCRIPTION_RULES
    vendors = R.VENDOR_RULES_WIDE if wide else R.VENDOR_RULES
    return f"""
      SELECT account_id, seq, date, description, debit, credit, balance,
             CASE WHEN atm THEN 'atm_withdrawal' WHEN salary THEN 'salary' ELSE c2 END AS category,
             service IS NOT NULL AS is_subscription,
             (service IS NOT NULL OR salary OR (NOT atm AND NOT salary
               AND c2 IN ('utilities', 'loan_payment', 'insurance', 'rent'))) AS is_recurring,
             coalesce(vendor, service, description) AS vendor_name
      FROM (SELECT *, (credit > 0 AND credit >= 10000 AND c2 IN ('transfer', 'other')) AS salary,
                   (contains(up, 'ABM') OR contains(up, 'ATM')) AS atm
        FROM (SELECT *, coalesce(CASE WHEN c1 IN ('shopping', 'other') THEN {first_rule('low', vendors)} END, c1) AS c2,
                     CASE WHEN c1 IN ('shopping', 'other')
                          THEN {first_rule('low', [(k, k.title()) for k, _ in vendors])} END AS vendor
          FROM (SELECT *, CASE WHEN service IS NOT NULL THEN 'subscription'
                               ELSE coalesce({first_rule('up', R.TRANSACTION_RULES)}, 'other') END AS c1
            FROM (SELECT *, CASE WHEN NOT contains(up, 'BILL PAYMENT') THEN {first_rule('low', subs)} END AS service
              FROM (SELECT *, upper(description) AS up, lower(upper(description)) AS low FROM {source})))))"""


DATE_FORMATS = [
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%-d-%-m-%Y", "%-d %b %Y", "%d %B %Y", "%b %-d, %Y", "%B %d, %Y", "%d/%m/%y",
    "%-m/%-d/%y", "%Y/%m/%d",
]
PARSE_FORMATS = {
    0: ["%Y-%m-%d"], 1: ["%d/%m/%Y", "%m/%d/%Y"], 2: ["%d/%m/%Y", "%m/%d/%Y"], 3: ["%d-%m-%Y"], 4: ["%d %b %Y"],
    5: ["%d %B %Y"], 6: ["%b %d, %Y"], 7: ["%B %d, %Y"], 8: ["%d/%m/%y", "%m/%d/%y"], 9: ["%d/%m/%y", "%m/%d/%y"],
    10: ["%Y/%m/%d"],
}


def date_text(date: str, choice: str) -> str:
    arms = " ".join(f"WHEN {i} THEN strftime({date}, '{f}')" for i, f in enumerate(DATE_FORMATS))
    return f"(CASE {choice} {arms} ELSE '' END)"


def parse_date(text: str, choice: str) -> str:
    arms = " ".join(
        f"WHEN {i} THEN coalesce({', '.join(f'try_strptime({text}, {quote(f)})' for f in formats)})"
        for i, formats in PARSE_FORMATS.items()
    )
    return f"CAST((CASE {choice} {arms} END) AS DATE)"


def amount_text(value: str) -> str:
    return (
        f"(CASE WHEN {value} = 0 THEN '' WHEN seq % 37 = 0 THEN 'n/a' WHEN seq % 3 = 0 THEN printf('%.2f', {value}) "
        f"WHEN seq % 3 = 1 THEN '$' || format('{{:,.2f}}', {value}) ELSE 'J$ ' || printf('%.2f', {value}) END)"
    )


def signed_amount(text: str) -> str:
    return f"try_cast(regexp_replace({text}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def parse_amount(text: str) -> str:
    return f"coalesce(abs({signed_amount(text)}), 0)::DOUBLE"


PAGES = """
  SELECT account_id, CAST(period AS VARCHAR) AS statement_id, page_no,
         (CASE WHEN page_no = 1 THEN 'Statement Period: ' || upper(strftime(first_day, '%d%b%y')) || ' to '
                    || upper(strftime(last_day(first_day + INTERVAL 2 MONTH), '%d%b%y'))
               ELSE 'Account statement' END)
         || chr(10) || body || chr(10) || 'Page ' || page_no AS text
  FROM (SELECT account_id, period, page_no, string_agg(lines, chr(10) ORDER BY date, seq) AS body,
               make_date(((period * 3 + 10) // 12)::BIGINT, ((period * 3 + 10) % 12 + 1)::BIGINT, 1) AS first_day
        FROM (SELECT *, ((row_number() OVER (PARTITION BY account_id, period ORDER BY date, seq) - 1) // 20 + 1)::INT
                        AS page_no,
                     upper(strftime(date, '%d%b')) || ' ' || description || ' J$ ' || amount || ' '
                     || (CASE WHEN credit > 0 THEN '+' ELSE '-' END)
                     || (CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 7 = 0 THEN ' J$ ' || amount
                              ELSE ' J$ ' || format('{:,.2f}', (1000 + seq % 5000)::DOUBLE) END)
                     || (CASE WHEN seq % 5 = 0 THEN chr(10) || '  REF ' || seq ELSE '' END)
                     || (CASE WHEN seq % 23 = 0 THEN chr(10) || 'GCT/GOVT TAX REF' ELSE '' END)
                     || (CASE WHEN seq % 13 = 0
                              THEN chr(10) || upper(strftime(date, '%d%b')) || ' SERVICE CHARGE J$ 50.00 -' ELSE '' END)
                     || (CASE WHEN seq % 19 = 0 THEN chr(10) || '31FEB GHOST ENTRY J$ 1.00 -' ELSE '' END)
                     || (CASE WHEN seq % 11 = 0 THEN chr(10) || '*** reconciled' ELSE '' END) AS lines
              FROM (SELECT account_id, seq, description, credit, CAST(date + INTERVAL 20 YEAR AS DATE) AS date,
                           format('{:,.2f}', greatest(debit, credit)) AS amount,
                           (year(date + INTERVAL 20 YEAR) * 12 + month(date) - 11) // 3 AS period
                    FROM tx))
        GROUP BY account_id, period, page_no)"""

LINES = """
  SELECT *, lead(line) OVER (PARTITION BY account_id, statement_id, page_no ORDER BY pos) AS next_line
  FROM (SELECT account_id, statement_id, page_no, (i - 1)::INT AS pos, trim(parts[i]) AS line
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT *, string_split(text, chr(10)) AS parts FROM pages)))"""

TX_PATTERN = r"^(\d{2})([A-Z]{3})\s+(.+?)\s+J\$\s+([\d,]+\.\d{2})\s*([+\-])"
PERIOD_PATTERN = r"Statement Period:.*?(\d{2}[A-Z]{3})(\d{2})\s+to\s+(\d{2}[A-Z]{3})(\d{2})"
MONTH_NO = "(CASE WHEN {m} IN ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC') " \
           "THEN (strpos('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', {m}) + 2) // 3 ELSE 1 END)"

MATCHED = f"""
  SELECT *, regexp_extract(line, '{TX_PATTERN}', 1)::INT AS day, regexp_extract(line, '{TX_PATTERN}', 2) AS month_text,
         trim(regexp_extract(line, '{TX_PATTERN}', 3)) AS description,
         replace(regexp_extract(line, '{TX_PATTERN}', 4), ',', '')::DOUBLE AS amount,
         regexp_extract(line, '{TX_PATTERN}', 5) AS sign
  FROM lines WHERE regexp_matches(line, '{TX_PATTERN}')"""

PERIODS = f"""
  SELECT account_id, statement_id,
         {MONTH_NO.format(m=f"substr(regexp_extract(text, '{PERIOD_PATTERN}', 1), 3, 3)")}::INT AS start_month,
         2000 + regexp_extract(text, '{PERIOD_PATTERN}', 2)::INT AS start_year,
         2000 + regexp_extract(text, '{PERIOD_PATTERN}', 4)::INT AS statement_year
  FROM pages WHERE page_no = 1 AND regexp_matches(text, '{PERIOD_PATTERN}')"""

DATED = f"""
  SELECT m.*, try_cast(
           (CASE WHEN p.start_year < p.statement_year AND {MONTH_NO.format(m='month_text')} >= p.start_month
                 THEN p.start_year ELSE p.statement_year END)
           || '-' || {MONTH_NO.format(m='month_text')} || '-' || day AS DATE) AS date
  FROM matched m JOIN periods p USING (account_id, statement_id)"""

CONTINUED = r"""
  SELECT * REPLACE (CASE WHEN next_line IS NOT NULL AND next_line <> '' AND NOT regexp_matches(next_line, '^\d{2}[A-Z]{3}\s')
                         AND NOT starts_with(next_line, '*') AND NOT starts_with(next_line, 'Page ')
                         AND NOT contains(description, 'SERVICE CHARGE') AND NOT contains(description, 'GCT')
                    THEN description || ' | ' || next_line ELSE description END AS description)
  FROM dated WHERE date IS NOT NULL"""

# What a parse of the rendered pages must give back, stated without any parsing.
EXPECTED_PARSE = """
  SELECT account_id, CAST(quarter AS VARCHAR) AS statement_id,
         row_number() OVER (PARTITION BY account_id ORDER BY quarter, date, place) AS seq, date,
         description || (CASE WHEN place % 5 = 0 THEN ' | REF ' || place ELSE '' END) AS description, debit, credit,
         (CASE WHEN place % 3 = 0 OR place % 7 = 0 OR 1000 + place % 5000 = greatest(debit, credit) THEN 0
               ELSE 1000 + place % 5000 END)::DOUBLE AS balance
  FROM (SELECT account_id, seq AS place, CAST(date + INTERVAL 20 YEAR AS DATE) AS date, description, debit, credit,
               (year(date + INTERVAL 20 YEAR) * 12 + month(date) - 11) // 3 AS quarter FROM tx)
  WHERE NOT (place % 23 = 0 AND place % 5 <> 0)"""

CSV_ROWS = f"""
  SELECT account_id, seq, {date_text('date', 'seq % 12')} AS date_text, description,
         {amount_text('debit')} AS debit_text, {amount_text('credit')} AS credit_text,
         (CASE WHEN debit > 0 THEN '-' || printf('%.2f', debit) ELSE format('{{:,.2f}}', credit) END) AS signed_text,
         printf('%.1f', (100 + seq % 900)::DOUBLE) AS balance_text
  FROM tx"""

CSV_PARSED = f"""
  SELECT account_id, seq, {parse_date('date_text', 'seq % 12')} AS date, description,
         (CASE WHEN account_id % 4 = 3 THEN greatest(-{signed_amount('signed_text')}, 0)
               ELSE {parse_amount('debit_text')} END)::DOUBLE AS debit,
         (CASE WHEN account_id % 4 = 3 THEN greatest({signed_amount('signed_text')}, 0)
               ELSE {parse_amount('credit_text')} END)::DOUBLE AS credit,
         {parse_amount('balance_text')} AS balance
  FROM csvrows"""

SUB_CHARGES = "SELECT *, lower(trim(vendor_name)) AS vendor FROM cls WHERE is_subscription AND debit > 0"

LEADER_STEPS = """
  SELECT account_id, rn, credit, seq, [credit] AS leaders FROM credits WHERE rn = 1
  UNION ALL
  SELECT c.account_id, c.rn, c.credit, c.seq,
         CASE WHEN len(list_filter(s.leaders, lambda l: abs(c.credit - l) / l < 0.05::DOUBLE)) > 0 THEN s.leaders
              ELSE list_append(s.leaders, c.credit) END
  FROM leadersteps s JOIN credits c ON c.account_id = s.account_id AND c.rn = s.rn + 1"""

CLUSTERED = """
  SELECT c.account_id, c.seq, c.date, c.credit,
         list_position(list_transform(f.leaders, lambda l: abs(c.credit - l) / l < 0.05::DOUBLE), true)::INT AS leader_no,
         f.leaders
  FROM credits c JOIN (SELECT account_id, arg_max(leaders, rn) AS leaders FROM leadersteps GROUP BY account_id) f
    USING (account_id)"""

SALARY = """
  SELECT account_id, round_even(total / n, 2) AS amount, pay_day,
         CASE WHEN date_diff('day', d0, d1)::DOUBLE / (n - 1) <= 18 THEN 'biweekly' ELSE 'monthly' END AS frequency,
         n AS occurrences, leader_no, total
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, total DESC, leader_no) AS best
        FROM (SELECT account_id, leader_no, count(*) AS n, sum(credit) AS total, min(date) AS d0, max(date) AS d1
              FROM clustered GROUP BY ALL HAVING count(*) >= 2))
  JOIN (SELECT account_id, leader_no, day::INT AS pay_day
        FROM (SELECT account_id, leader_no, day(date) AS day,
                     row_number() OVER (PARTITION BY account_id, leader_no ORDER BY count(*) DESC, day(date)) AS r
              FROM clustered GROUP BY account_id, leader_no, day(date)) WHERE r = 1) USING (account_id, leader_no)
  WHERE best = 1"""


def _vendor_pattern(where: str) -> str:
    return f"""
  SELECT g.account_id, g.vendor, {title('g.vendor')} AS name, round_even(total / n, 2) AS amount, m.day,
         (SELECT count(*) FROM cls c WHERE c.account_id = g.account_id AND lower(trim(c.vendor_name)) = g.vendor
            AND {where.replace('@', 'c.')} AND abs(day(c.date) - m.day) > 2)::BIGINT AS failures, n
  FROM (SELECT account_id, lower(trim(vendor_name)) AS vendor, count(*) AS n, sum(debit) AS total
        FROM cls WHERE {where.replace('@', '')} GROUP BY ALL) g
  JOIN (SELECT account_id, vendor, day::INT AS day
        FROM (SELECT account_id, lower(trim(vendor_name)) AS vendor, day(date) AS day,
                     row_number() OVER (PARTITION BY account_id, lower(trim(vendor_name))
                                        ORDER BY count(*) DESC, day(date)) AS r
              FROM cls WHERE {where.replace('@', '')} GROUP BY account_id, lower(trim(vendor_name)), day(date)) WHERE r = 1) m USING (account_id, vendor)"""


SUBSCRIPTIONS = _vendor_pattern("@is_subscription")
EXPENSES = _vendor_pattern(
    "@category IN ('utilities', 'loan_payment', 'insurance', 'rent') AND @is_recurring AND @debit > 0"
)

PAIRS = """
  SELECT account_id, vendor, date, seq, debit, lag(debit) OVER (PARTITION BY account_id, vendor ORDER BY date, seq) AS previous
  FROM charges"""

PERCENT = "((debit - previous) / previous * 100)"
JUMPS = f"""
  SELECT account_id, vendor, date, seq, previous AS old_amount, debit AS new_amount, debit - previous AS change_amount,
         {PERCENT} AS change_percent,
         CASE WHEN {PERCENT} > 50 THEN 'Plan Upgrade' WHEN {PERCENT} > 0 THEN 'Price Increase'
              WHEN {PERCENT} < -50 THEN 'Plan Downgrade' ELSE 'Price Decrease' END AS type,
         CASE WHEN {PERCENT} > 20 THEN 'warning' ELSE 'info' END AS severity,
         CASE WHEN {PERCENT} > 50 THEN 'Significant price jump: $' || {money('previous')} || ' → $' || {money('debit')}
                || ' (+' || printf('%.0f', round_even({PERCENT}, 0)) || '%). Likely a plan change.'
              WHEN {PERCENT} > 0 THEN 'Price increased from $' || {money('previous')} || ' to $' || {money('debit')}
                || ' (+' || printf('%.1f', round_even({PERCENT}, 1)) || '%).'
              WHEN {PERCENT} < -50 THEN 'Significant price drop: $' || {money('previous')} || ' → $' || {money('debit')}
                || ' (' || printf('%.0f', round_even({PERCENT}, 0)) || '%). Likely a plan change.'
              ELSE 'Price decreased from $' || {money('previous')} || ' to $' || {money('debit')}
                || ' (' || printf('%.1f', round_even({PERCENT}, 1)) || '%).' END AS description
  FROM pairs WHERE previous > 0 AND debit > 0 AND abs(debit - previous) / previous > 0.05::DOUBLE"""

SERIES = """
  SELECT c.account_id, c.vendor, c.date, c.seq, c.debit AS x, g.mean, g.std,
         row_number() OVER (PARTITION BY c.account_id, c.vendor ORDER BY c.date, c.seq) AS rn
  FROM charges c JOIN (
    SELECT account_id, vendor, count(*) AS n, sum(round(debit * 100)::BIGINT)::DOUBLE / count(*) / 100::DOUBLE AS mean,
           sqrt(greatest((count(*)::HUGEINT * sum(round(debit * 100)::HUGEINT * round(debit * 100)::HUGEINT)
             - sum(round(debit * 100)::HUGEINT) * sum(round(debit * 100)::HUGEINT))::DOUBLE, 0)) / count(*) / 100::DOUBLE AS std
    FROM charges GROUP BY ALL HAVING count(*) >= 3) g USING (account_id, vendor)
  WHERE std > 0"""

DRIFT_STEPS = """
  SELECT account_id, vendor, rn, date, seq, x, mean, std,
         greatest(0::DOUBLE, 0::DOUBLE + (x - mean) - 0.5::DOUBLE * std) AS pos,
         greatest(0::DOUBLE, 0::DOUBLE + (mean - x) - 0.5::DOUBLE * std) AS neg
  FROM series WHERE rn = 1
  UNION ALL
  SELECT n.account_id, n.vendor, n.rn, n.date, n.seq, n.x, n.mean, n.std,
         greatest(0::DOUBLE, (CASE WHEN s.pos > 1.5::DOUBLE * s.std THEN 0::DOUBLE ELSE s.pos END) + (n.x - n.mean) - 0.5::DOUBLE * n.std),
         greatest(0::DOUBLE, (CASE WHEN s.neg > 1.5::DOUBLE * s.std THEN 0::DOUBLE ELSE s.neg END) + (n.mean - n.x) - 0.5::DOUBLE * n.std)
  FROM driftsteps s JOIN series n ON n.account_id = s.account_id AND n.vendor = s.vendor AND n.rn = s.rn + 1"""

DRIFT = f"""
  SELECT account_id, vendor, date, seq, mean AS old_amount, x AS new_amount, x - mean AS change_amount,
         CASE WHEN mean > 0 THEN (x - mean) / mean * 100 ELSE 0 END AS change_percent, up AS is_up,
         CASE WHEN up THEN 'Sustained Price Drift (Up)' ELSE 'Sustained Price Drift (Down)' END AS type,
         CASE WHEN up THEN 'warning' ELSE 'info' END AS severity,
         'CUSUM detected sustained ' || (CASE WHEN up THEN 'upward' ELSE 'downward' END) || ' drift. Baseline: $'
           || {money('mean')} || ', Current: $' || {money('x')} || '.' AS description
  FROM (SELECT *, TRUE AS up FROM driftsteps WHERE pos > 1.5::DOUBLE * std
        UNION ALL SELECT *, FALSE AS up FROM driftsteps WHERE neg > 1.5::DOUBLE * std)"""

CHARGE_DAYS = """
  SELECT account_id, vendor, count(*) AS n, max(date) AS last_date FROM charges GROUP BY ALL"""

GAPS = """
  SELECT account_id, vendor, date, date_diff('day', lag(date) OVER (PARTITION BY account_id, vendor ORDER BY date, seq), date)
           AS gap
  FROM charges"""

INTERVALS = f"""
  SELECT d.account_id, d.vendor, d.n, d.last_date, coalesce(len(gaps), 0) AS m, gaps,
         CASE WHEN d.n >= 2 AND len(gaps) > 0 THEN list_median(gaps) ELSE 30 END::DOUBLE AS median_interval_days,
         CASE WHEN d.n >= 3 AND len(gaps) > 0
              THEN gaps[least(3 * len(gaps) // 4, len(gaps) - 1) + 1] - gaps[len(gaps) // 4 + 1] END AS iqr
  FROM chargedays d LEFT JOIN (
    SELECT account_id, vendor, list(gap ORDER BY gap) AS gaps FROM gaps WHERE gap > 0 GROUP BY ALL) USING (account_id, vendor)"""

PROFILE = """
  SELECT *, CASE WHEN n = 2 THEN 5 WHEN iqr IS NOT NULL THEN greatest(round_even(1.5::DOUBLE * iqr, 0)::INT, 2) ELSE 7 END AS band_days,
         CASE WHEN n = 2 THEN 'medium' WHEN iqr IS NULL THEN 'low' WHEN iqr <= 2 THEN 'high' WHEN iqr <= 7 THEN 'medium'
              ELSE 'low' END AS confidence_label,
         CASE WHEN n < 2 THEN 'cold_start' WHEN n = 2 THEN 'single_interval' WHEN iqr IS NOT NULL THEN 'median_iqr'
              ELSE 'fallback' END AS method,
         CAST(last_date + to_days((floor(median_interval_days) * greatest(1, ceil(date_diff('day', last_date,
           DATE '2001-08-15') / floor(median_interval_days))))::INT) AS DATE) AS next_date
  FROM intervals"""

LOADS = """
  SELECT s.account_id, s.name, s.amount, s.day AS renewal_day, s.failures AS past_failures, s.n AS total_months,
         s.failures::DOUBLE / s.n AS fail_rate, p.amount AS salary, p.pay_day, p.frequency,
         coalesce(sum(CASE WHEN e.day <= s.day THEN CAST(e.amount AS DECIMAL(18, 2)) END), 0)::DOUBLE AS spent_before,
         coalesce(sum(CASE WHEN least(abs(e.day - s.day), 30 - abs(e.day - s.day)) <= 3
                           THEN CAST(e.amount AS DECIMAL(18, 2)) END), 0)::DOUBLE AS cluster_amount
  FROM subscriptions s JOIN salary p USING (account_id) LEFT JOIN expenses e USING (account_id)
  GROUP BY ALL"""

SINCE = "(CASE WHEN {d} >= pay_day THEN {d} - pay_day ELSE 30 - pay_day + {d} END)"
UNTIL = "(CASE WHEN {d} < pay_day THEN pay_day - {d} ELSE 30 - {d} + pay_day END)"
POSITION = "least(" + SINCE + " / (CASE WHEN frequency = 'monthly' THEN 30::DOUBLE ELSE 14::DOUBLE END), 1::DOUBLE)"
ZONE_LABEL = "(CASE WHEN {p} <= 0.3::DOUBLE THEN 'SAFE ZONE' WHEN {p} <= 0.6::DOUBLE THEN 'MID-CYCLE' " \
             "WHEN {p} <= 0.8::DOUBLE THEN 'CAUTION ZONE' ELSE 'DANGER ZONE' END)"
ZONE_LEVEL = "(CASE WHEN {p} <= 0.3::DOUBLE THEN 'safe' WHEN {p} <= 0.6::DOUBLE THEN 'moderate' " \
             "WHEN {p} <= 0.8::DOUBLE THEN 'high' ELSE 'critical' END)"

FACTORS = f"""
  SELECT *, {POSITION.format(d='renewal_day')} AS paycycle_factor,
         CASE WHEN salary > 0 THEN least(cluster_amount / salary, 1::DOUBLE) ELSE 0.5::DOUBLE END AS cluster_factor,
         CASE WHEN salary > 0 THEN least(spent_before / salary, 1::DOUBLE) ELSE 0.5::DOUBLE END AS load_factor
  FROM loads"""

RISKS = f"""
  SELECT *, CASE WHEN risk_score <= 0.30::DOUBLE THEN 'LOW' WHEN risk_score <= 0.55::DOUBLE THEN 'MODERATE'
                 WHEN risk_score <= 0.75::DOUBLE THEN 'HIGH' ELSE 'CRITICAL' END AS risk_label,
         CASE WHEN risk_score <= 0.30::DOUBLE THEN 'Your renewal should go through fine.'
              WHEN risk_score <= 0.55::DOUBLE THEN 'Check your balance a day before renewal.'
              WHEN risk_score <= 0.75::DOUBLE THEN 'High risk of insufficient funds. Transfer money to your card.'
              ELSE 'This renewal will likely fail. Add funds immediately.' END AS advice
  FROM (SELECT *, round_even(1 / (1 + exp(-8 * (0.35::DOUBLE * paycycle_factor + 0.25::DOUBLE * cluster_factor
                                   + 0.25::DOUBLE * fail_rate + 0.15::DOUBLE * load_factor - 0.45::DOUBLE))), 2) AS risk_score
        FROM factors)"""


# --- usage ---------------------------------------------------------------------

_APP = f"""(CASE WHEN user_id % 17 = 0 THEN '{A.UNKNOWN_APP} ' || type_index
            ELSE {pick('(user_id * 5 + type_index) % 12', [r[0] for r in A.CATALOG])} END)"""

USAGE_LONG = f"""
  SELECT user_id, {_APP} AS app_name, least((day(ts) - 1) // 7, 3)::INT AS week,
         CASE WHEN user_id % 13 = 0 AND event_type = 'error' THEN 0 ELSE CAST(value AS DECIMAL(18, 2)) END AS hours
  FROM (SELECT *, list_position({A.EVENT_TYPES!r}, event_type) - 1 AS type_index FROM events)"""

USAGE = f"""
  SELECT user_id, app_name, h0, h1, h2, h3, (1 + user_id % 30)::INT AS months_subscribed,
         (10 + user_id % 20)::DOUBLE AS wage, {pick('user_id % 3', [0.07, 0.10, 0.15])} AS style,
         {lookup('app_name', {r[0]: r[1] for r in A.CATALOG}, A.UNKNOWN_APP_COST)} AS cost
  FROM (SELECT user_id, app_name, {', '.join(f"coalesce(sum(hours) FILTER (WHERE week = {w}), 0)::DOUBLE / 30 AS h{w}" for w in range(4))}
        FROM usagelong GROUP BY user_id, app_name)"""

CATALOG = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(quote(v) for v in row) + ")" for row in A.CATALOG
) + """) AS t(app_name, list_cost, frequency, category, value_mode, engagement_type, is_multi_device, has_free_tier,
  is_shared_plan, student_plan_price, claimed, m, y, l)"""

PROFILED = """
  SELECT u.*, coalesce(frequency, 'monthly') AS frequency, coalesce(category, 'entertainment') AS category,
         coalesce(value_mode, 'time_based') AS value_mode, coalesce(engagement_type, 'active') AS engagement_type,
         coalesce(is_multi_device, FALSE) AS is_multi_device, coalesce(has_free_tier, FALSE) AS has_free_tier,
         coalesce(is_shared_plan, FALSE) AS is_shared_plan, coalesce(student_plan_price, 0)::DOUBLE AS student_plan_price,
         coalesce(claimed, FALSE) AS claimed, coalesce(m, 0)::DOUBLE AS claimed_m, coalesce(y, 0)::DOUBLE AS claimed_y,
         coalesce(l, 0)::DOUBLE AS claimed_l,
         CASE WHEN claimed THEN m ELSE 0 END::DOUBLE AS monthly_price, CASE WHEN claimed THEN y ELSE 0 END::DOUBLE AS yearly_price,
         CASE WHEN claimed THEN l ELSE 0 END::DOUBLE AS lifetime_price,
         coalesce(claimed AND ((m <= 0 AND y <= 0 AND l <= 0) OR (m > 0 AND abs(cost - m) / greatest(m, 0.01) < 0.20)
           OR (y > 0 AND abs(cost - y) / greatest(y, 0.01) < 0.20) OR (l > 0 AND abs(cost - l) / greatest(l, 0.01) < 0.20)),
           FALSE) AS pricing_verified
  FROM usage u LEFT JOIN catalog USING (app_name)"""

_CYCLE = {"weekly": 0.23, "monthly": 1.0, "quarterly": 3.0, "biannual": 6.0, "yearly": 12.0}
_NPV_MONTH = "sum(1 / power(1.005::DOUBLE, t))"

METRICS = f"""
  SELECT *, (cost_up > 1.5::DOUBLE * std AND std > 0) AS surge, (cost_down > 1.5::DOUBLE * std AND std > 0) AS dropped,
         CASE WHEN raw_hours = 0 OR std = 0 THEN FALSE
              ELSE (greatest(h0, h1, h2, h3) - mean) / std > 1.5::DOUBLE AND greatest(h0, h1, h2, h3) / raw_hours > 0.40::DOUBLE END AS is_binge,
         CASE WHEN lifetime_price > 0 AND monthly_price > 0 THEN ceil(lifetime_price / monthly_price) ELSE 0 END::INT AS breakeven_lifetime,
         CASE WHEN yearly_price > 0 AND monthly_price > 0 THEN ceil(yearly_price / monthly_price) ELSE 0 END::INT AS breakeven_yearly,
         CASE WHEN confidence >= 0.8::DOUBLE THEN 'HIGH' WHEN confidence >= 0.6::DOUBLE THEN 'MODERATE' ELSE 'LOW' END AS confidence_label,
         greatest(least(round_even((0.35::DOUBLE * least(velocity * 50, 100) + 0.40::DOUBLE
           * (CASE WHEN cancel_threshold > 0 THEN greatest((1 - cph / (cancel_threshold * 2)) * 100, 0) ELSE 50 END)
           + 0.10::DOUBLE * (least(months_subscribed / 12::DOUBLE, 1) * 100) + 0.15::DOUBLE * 50)
           * {lookup('category', {"productivity": 1.2, "utility": 1.1, "entertainment": 0.8, "gaming": 0.7}, 1.0)}, 0)::INT, 100), 0)
           AS value_risk_score,
         CASE WHEN monthly_price > 0 THEN round_even(monthly_price * list_sum(list_transform(range(1, projected_months + 1),
           lambda t: 1 / power(1.005::DOUBLE, t))), 2) END AS npv_monthly,
         CASE WHEN yearly_price > 0 THEN round_even(yearly_price * list_sum(list_transform(
           range(1, ceil(projected_months / 12)::INT + 1), lambda t: 1 / power(1.005::DOUBLE, 12 * t))), 2) END AS npv_yearly,
         CASE WHEN lifetime_price > 0 THEN lifetime_price END AS npv_lifetime
  FROM (SELECT *, CASE WHEN eff_hours > 0 THEN personal_burden / eff_hours ELSE 9999.99::DOUBLE END AS cph,
               greatest(0.3::DOUBLE, 1::DOUBLE - (CASE WHEN is_multi_device THEN 0.3::DOUBLE ELSE 0 END)
                 - (CASE WHEN raw_hours < 2 AND NOT is_presence THEN 0.2::DOUBLE ELSE 0 END)
                 - (CASE WHEN velocity < 0.2::DOUBLE OR velocity > 2 THEN 0.1::DOUBLE ELSE 0 END)) AS confidence,
               least(least(velocity, 1.5::DOUBLE) * exp(-{lookup('category', {"utility": 0.05, "productivity": 0.10,
                 "entertainment": 0.20, "gaming": 0.35}, 0.20)} * (1::DOUBLE / greatest(months_subscribed, 1))), 1) AS p_break_even,
               CASE WHEN velocity < 0.3::DOUBLE THEN 3 WHEN velocity < 0.5::DOUBLE THEN 6 WHEN velocity < 0.8::DOUBLE THEN 12
                    ELSE 36 END AS projected_months,
               greatest(u1, u2, u3, u4) AS cost_up, greatest(w1, w2, w3, w4) AS cost_down
    FROM (SELECT *, greatest(0, u3 + (h3 - mean) - 0.5::DOUBLE * std) AS u4, greatest(0, w3 + (mean - h3) - 0.5::DOUBLE * std) AS w4
    FROM (SELECT *, greatest(0, u2 + (h2 - mean) - 0.5::DOUBLE * std) AS u3, greatest(0, w2 + (mean - h2) - 0.5::DOUBLE * std) AS w3
    FROM (SELECT *, greatest(0, u1 + (h1 - mean) - 0.5::DOUBLE * std) AS u2, greatest(0, w1 + (mean - h1) - 0.5::DOUBLE * std) AS w2
    FROM (SELECT *, greatest(0, (h0 - mean) - 0.5::DOUBLE * std) AS u1, greatest(0, (mean - h0) - 0.5::DOUBLE * std) AS w1,
                 normalized_cost / divisor AS personal_burden,
                 CASE WHEN is_presence THEN 30 ELSE raw_hours * weight END::DOUBLE AS eff_hours
    FROM (SELECT *, sqrt(((h0 - mean) * (h0 - mean) + (h1 - mean) * (h1 - mean) + (h2 - mean) * (h2 - mean)
                         + (h3 - mean) * (h3 - mean)) / 4) AS std,
                 CASE WHEN is_presence OR raw_hours = 0 THEN 1::DOUBLE ELSE ema / mean END AS velocity,
                 CASE WHEN value_mode = 'outcome_based' THEN greatest(base_weight, 1.5::DOUBLE) ELSE base_weight END AS weight
    FROM (SELECT *, h0 + h1 + h2 + h3 AS raw_hours, (h0 + h1 + h2 + h3) / 4 AS mean,
                 0.3::DOUBLE * h3 + 0.7::DOUBLE * (0.3::DOUBLE * h2 + 0.7::DOUBLE * (0.3::DOUBLE * h1 + 0.7::DOUBLE * h0)) AS ema,
                 value_mode = 'presence_based' AS is_presence,
                 cost / {lookup('frequency', _CYCLE, 1.0)} AS normalized_cost,
                 CASE WHEN contains(lower(app_name), 'duo') OR contains(lower(app_name), 'couple') THEN 2
                      WHEN contains(lower(app_name), 'family') OR contains(lower(app_name), 'party')
                        OR contains(lower(app_name), 'group') THEN 4
                      WHEN is_shared_plan THEN 3 ELSE 1 END AS divisor,
                 {lookup('engagement_type', {"passive": 0.33, "active": 1.0, "generative": 1.5}, 1.0)} AS base_weight,
                 wage * style * (CASE value_mode WHEN 'presence_based' THEN 1.5::DOUBLE WHEN 'outcome_based' THEN 2::DOUBLE
                   ELSE 1::DOUBLE END) AS cancel_threshold
          FROM profiled)))))))"""

_UNIT = "(CASE WHEN is_presence THEN 'day' ELSE 'hr' END)"
_SAVING = "((monthly_price - yearly_price / 12) / monthly_price * 100)"
_PCT = "printf('%.0f', round_even(p_break_even * 100, 0))"
_GATES = [
    ("raw_hours = 0 AND NOT is_presence", "'CANCEL'", "'Zero usage detected in the tracking period.'"),
    ("confidence < 0.6::DOUBLE AND cph > cancel_threshold AND NOT is_presence", "'VERIFY USAGE'",
     "'Low confidence in screen-time data. Verify actual usage before canceling.'"),
    ("dropped AND cost_down / std > 2 AND NOT is_presence", "'WARNING: USAGE CLIFF'",
     "'CUSUM detected a significant usage drop (magnitude: ' || printf('%.1f', round_even(cost_down / std, 1)) || 'σ). "
     "Monitor closely — this may indicate you''re about to stop using ' || app_name || '.'"),
    ("is_binge AND frequency = 'monthly' AND category IN ('entertainment', 'gaming')", "'SUBSCRIBE & CHURN'",
     "'Statistical binge detected — usage is heavily concentrated. Cancel now and only resubscribe when needed.'"),
    ("cph > cancel_threshold AND is_multi_device", "'WARNING: VERIFY USAGE'",
     f"'Mobile CPH is high ($' || {money('cph')} || '/hr), but ' || app_name || ' is a TV/desktop app. Verify total household time.'"),
    ("best_plan = 'lifetime' AND lifetime_price > 0 AND velocity >= 0.8::DOUBLE AND breakeven_lifetime > 0 "
     "AND months_subscribed >= breakeven_lifetime * 0.6::DOUBLE", "'SWITCH TO LIFETIME'",
     f"'Stable usage over ' || months_subscribed || ' months. Lifetime ($' || {money('lifetime_price')} || ') breaks even at month ' "
     "|| breakeven_lifetime || '. NPV analysis confirms this is the cheapest long-term option.'"),
    (f"best_plan = 'yearly' AND yearly_price > 0 AND monthly_price > 0 AND frequency = 'monthly' AND velocity >= 0.7::DOUBLE "
     f"AND {_SAVING} > 5", "'UPGRADE TO ANNUAL'",
     f"'Yearly billing ($' || {money('yearly_price / 12')} || '/mo) saves ' || printf('%.0f', round_even({_SAVING}, 0)) "
     f"|| '% vs monthly ($' || {money('monthly_price')} || '/mo). Usage trend supports commitment.'"),
    ("student_plan_price > 0 AND personal_burden > student_plan_price + 0.05::DOUBLE", "'SWITCH TO STUDENT PLAN'",
     f"'Student tier (~$' || {money('student_plan_price')} || '/mo) is cheaper than your current ' || frequency || ' rate.'"),
    ("cph > cancel_threshold", "CASE WHEN has_free_tier THEN 'DOWNGRADE TO FREE' ELSE 'CANCEL' END",
     f"'Cost ($' || {money('cph')} || '/' || {_UNIT} || ') exceeds your personal threshold ($' || {money('cancel_threshold')} || ').'"),
    ("velocity < 0.5::DOUBLE AND NOT is_presence", "'WATCH ' || upper(frequency) || ' (DECAYING)'",
     f"'Value is okay, but EMA trend shows usage declining (velocity: ' || {money('velocity')} || ').'"),
    ("locked AND student_plan_price > 0 AND personal_burden <= student_plan_price + 0.5::DOUBLE", "'KEEP ' || upper(frequency)",
     "'Already on the best price (Student Tier). Habit is locked in.'"),
    ("locked AND best_plan IS NOT NULL AND best_plan <> frequency", "'UPGRADE TO ' || upper(best_plan)",
     f"'Habit is locked in (' || {_PCT} || '% break-even prob). NPV analysis shows ' || best_plan || ' is the optimal plan.'"),
    ("locked", "'KEEP ' || upper(frequency)",
     f"'Locked-in habit (' || {_PCT} || '% break-even prob). Current plan is already optimal.'"),
]

BEST_PLAN = """(CASE WHEN npv_monthly IS NULL AND npv_yearly IS NULL AND npv_lifetime IS NULL THEN NULL
    WHEN npv_monthly = least(npv_monthly, npv_yearly, npv_lifetime) THEN 'monthly'
    WHEN npv_yearly = least(npv_monthly, npv_yearly, npv_lifetime) THEN 'yearly' ELSE 'lifetime' END)"""

VERDICTS = f"""
  SELECT *, CASE {' '.join(f'WHEN {test} THEN {action}' for test, action, _ in _GATES)} ELSE 'KEEP ' || upper(frequency) END AS action,
         CASE {' '.join(f'WHEN {test} THEN {reason}' for test, _, reason in _GATES)}
              ELSE 'Satisfactory value ($' || {money('cph')} || '/' || {_UNIT} || ').' END AS reason,
         CASE WHEN value_risk_score > 70 THEN 'Low Risk' WHEN value_risk_score >= 40 THEN 'Medium Risk' ELSE 'High Risk' END
           AS value_risk_label
  FROM (SELECT *, {BEST_PLAN} AS best_plan,
               (p_break_even > 0.8::DOUBLE AND eff_hours > 5 AND frequency NOT IN ('yearly', 'lifetime') AND NOT is_binge) AS locked
        FROM metrics)"""

INSIGHTS = f"""
  SELECT *, drop_worst * 12 AS drop_worst_annual, keep_best * 12 AS keep_best_annual,
         'You have ' || n || ' ' || replace(category, '_', ' ') || ' subscriptions costing $' || {money('total_cost')}
           || '/mo total. ' || best_name || ' is your best value at $' || {money('best_cph')} || '/hr. Dropping ' || worst_name
           || ' alone saves $' || {money('drop_worst')} || '/mo ($' || {money('drop_worst * 12')} || '/yr).' AS recommendation
  FROM (SELECT user_id, category, count(*) AS n, sum(CAST(personal_burden AS DECIMAL(28, 10)))::DOUBLE AS total_cost,
               sum(CAST(raw_hours AS DECIMAL(28, 10)))::DOUBLE AS total_hours,
               max(app_name) FILTER (WHERE r = 1) AS best_name, max(cph) FILTER (WHERE r = 1) AS best_cph,
               max(app_name) FILTER (WHERE r = c) AS worst_name, max(cph) FILTER (WHERE r = c) AS worst_cph,
               max(personal_burden) FILTER (WHERE r = c) AS drop_worst,
               coalesce(sum(CAST(personal_burden AS DECIMAL(28, 10))) FILTER (WHERE r > 1), 0)::DOUBLE AS keep_best
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY cph, app_name) AS r,
                     count(*) OVER (PARTITION BY user_id, category) AS c FROM verdicts)
        GROUP BY user_id, category HAVING count(*) >= 2)"""

# --- calendar -------------------------------------------------------------------

CALENDAR = f"""
  SELECT user_id, event_id, k, {pick('k', [r[0] for r in A.EVENT_KINDS])} AS summary,
         CASE WHEN event_id % 3 = 0 THEN {pick('k', [r[2] for r in A.EVENT_KINDS])}
              ELSE {pick('k', [r[1] for r in A.EVENT_KINDS])} END AS location,
         {pick('k', [r[3] for r in A.EVENT_KINDS])} AS description,
         strftime(start_date, '%Y-%m-%d') || (CASE WHEN event_id % 4 = 0 THEN 'T09:00:00-05:00' ELSE '' END) AS start,
         strftime(end_date, '%Y-%m-%d') || (CASE WHEN event_id % 4 = 0 THEN 'T09:00:00-05:00' ELSE '' END) AS "end",
         start_date, end_date, (k < 4)::INT AS is_travel, {pick('k', [r[4] for r in A.EVENT_KINDS])} AS trigger_type,
         {pick('event_id % 3', ['high', 'medium', 'low'])} AS confidence
  FROM (SELECT o_custkey // 10 AS user_id, o_orderkey AS event_id, o_orderkey % 10 AS k, CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + (o_orderkey % 25)::INT AS end_date FROM orders)"""

TEXTS = """
  SELECT *, lower(concat_ws(' ', nullif(trim(summary), ''), nullif(trim(location), ''), nullif(trim(description), ''))) AS text
  FROM calendar"""


def destination(summary: str, location: str, description: str) -> str:
    def after(text: str, word: str) -> str:
        found = f"rtrim(trim(regexp_extract({text}, '\\b{word}\\s+([A-Z][a-zA-Z\\s,]+)', 1)), ',')"
        return f"(CASE WHEN length({found}) > 2 THEN {found} END)"

    def named(text: str) -> str:
        pattern = r"(?:destination|location|at|visiting)\s*:?\s*([A-Z][a-zA-Z\s,]+)"
        return f"nullif(trim(regexp_extract({text}, '{pattern}', 1)), '')"

    return (
        f"coalesce(CASE WHEN trim({location}) <> '' AND NOT {any_of(f'lower({location})', R.VIRTUAL_LOCATION_WORDS)} "
        f"THEN trim({location}) END, {after(summary, 'to')}, {after(summary, 'in')}, {named(description)}, {named(summary)}, 'Unknown')"
    )


TRIGGER = "(CASE " + " ".join(
    f"WHEN {any_of('text', words)} THEN {quote(label)}" for label, words in R.TRIGGER_GROUPS
) + " ELSE 'other' END)"

AWAY = f"""
  SELECT user_id, event_id AS seq, summary AS reason, start_date AS departure_date, end_date AS return_date,
         {destination('summary', 'location', 'description')} AS destination, {TRIGGER} AS trigger_type, confidence
  FROM texts WHERE is_travel = 1"""

PERIODS_MERGED = """
  SELECT user_id, min(departure_date) AS departure_date, max(return_date) AS return_date,
         first(reason ORDER BY rank DESC, departure_date, seq) AS reason,
         first(trigger_type ORDER BY rank DESC, departure_date, seq) AS trigger_type,
         first(confidence ORDER BY rank DESC, departure_date, seq) AS confidence,
         coalesce(first(destination ORDER BY departure_date, seq) FILTER (WHERE destination <> 'Unknown'), 'Unknown') AS destination,
         count(*) AS events
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY departure_date, seq ROWS UNBOUNDED PRECEDING) AS island,
               CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank
        FROM (SELECT *, CASE WHEN date_diff('day', max(return_date) OVER (PARTITION BY user_id ORDER BY departure_date, seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), departure_date) <= 3 THEN 0 ELSE 1 END AS fresh
              FROM away))
  GROUP BY user_id, island"""

LOCALS = f"""
  SELECT c_custkey // 10 AS user_id, {pick('c_custkey % 6', [n for n, _ in A.LOCAL_KINDS])} || ' ' || c_custkey % {A.SERVICES} AS name,
         {pick('c_custkey % 6', [w for _, w in A.LOCAL_KINDS])} AS location_type, (20 + c_custkey % 80)::DOUBLE AS monthly_cost,
         c_custkey % 6 <> 4 AS is_local, c_custkey % 3 = 0 AS can_pause, c_custkey % 2 = 0 AS can_rejoin,
         (10 * (c_custkey % 4))::DOUBLE AS penalty, c_custkey AS key
  FROM customer"""

RECOMMENDATIONS = f"""
  SELECT *, CASE WHEN can_pause THEN 'PAUSE MEMBERSHIP' WHEN can_rejoin AND penalty = 0 THEN 'CANCEL & REJOIN'
                 WHEN can_rejoin AND net_savings > penalty * 2 THEN 'CANCEL & REJOIN (WITH PENALTY)'
                 ELSE 'CONSIDER CANCELING' END AS action,
         CASE WHEN can_pause THEN 'Freeze your membership during this period.'
              WHEN can_rejoin AND penalty = 0 THEN 'Cancel before you leave, resubscribe when you return.'
              WHEN can_rejoin AND net_savings > penalty * 2
                THEN 'Rejoin fee is $' || {money('penalty')} || ', but you still save $' || {money('net_savings')} || ' net.'
              ELSE 'Check with the provider about pause options.' END AS action_detail
  FROM (SELECT s.user_id, s.name AS subscription, p.reason AS away_reason, p.departure_date, p.return_date, p.destination, days_away,
               ceil(days_away / 30)::INT AS months_away, monthly_cost, monthly_cost / 30 * days_away AS potential_savings, penalty,
               monthly_cost / 30 * days_away - penalty AS net_savings, location_type, p.confidence, can_pause, can_rejoin, key
        FROM locals s JOIN (SELECT *, greatest(0, date_diff('day', greatest(departure_date, DATE '1998-01-01'), return_date))
                              AS days_away FROM merged) p USING (user_id)
        WHERE is_local AND monthly_cost > 0 AND days_away >= 14)
  WHERE net_savings > 0"""


def _option_price(i: int) -> str:
    return (
        f"(CASE WHEN (key + {i}) % 5 = 0 THEN NULL WHEN (key + {i}) % 7 = 0 THEN 0 "
        f"ELSE 5 + (key * ({i} + 1) + length(destination)) % 40 END)"
    )


ATTACHED = f"""
  SELECT *, CASE WHEN eligible THEN hit END AS alternatives_found,
         CASE WHEN eligible THEN CASE WHEN hit THEN key % 4 + 1 ELSE 0 END END AS option_count,
         CASE WHEN eligible AND hit THEN least(
             {', '.join(f"CASE WHEN {i} <= key % 4 AND {_option_price(i)} > 0 THEN {_option_price(i)} END" for i in range(3))}
           )::DOUBLE END AS cheapest_monthly
  FROM (SELECT *, destination <> 'Unknown' AND location_type <> 'portable' AS eligible,
               destination IN ('JFK Airport', 'Nassau, Bahamas', 'Boston', 'Miami') AND key % 4 <> 3 AS hit
        FROM recommendations)"""



def stop_words() -> list[str]:
    """The English stop words that Spark ML ships, read from its library."""
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    library = next(p for home in homes for p in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")))
    with zipfile.ZipFile(library) as jar:
        return jar.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()


def term_counts(source: str, key: str) -> str:
    """How often each word and word pair stands in a text: (key, term, n)."""
    stops = ", ".join(quote(w) for w in stop_words())
    return f"""
  SELECT {key}, term, count(*) AS n FROM (
    SELECT {key}, unnest(list_concat(kept, list_transform(range(1, len(kept)), lambda i: kept[i] || ' ' || kept[i + 1]))) AS term
    FROM (SELECT {key}, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}'),
                                    lambda w: NOT list_contains([{stops}], w)) AS kept FROM {source}))
  GROUP BY ALL"""


def vocabulary(counts: str, source: str, where: str = "TRUE") -> str:
    """The 500 most frequent terms of two texts or more: (term, docs, idf)."""
    return f"""
  SELECT term, count(*) AS docs, ln(((SELECT count(*) FROM {source} WHERE {where}) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf
  FROM {counts} WHERE {where} GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 500"""


def tfidf(source: str, key: str) -> str:
    """Weights of unit length: (key, term, weight)."""
    return f"""
  SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 8) AS weight FROM (
    WITH counts AS ({term_counts(source, key)}), vocabulary AS ({vocabulary("counts", source)})
    SELECT {key}, term, (1 + ln(n)) * idf AS w FROM counts JOIN vocabulary USING (term))"""


CTES: dict[str, tuple[str, list[str]]] = {
    "tx": (_tx(False), []),
    "cls": (_classified("tx"), ["tx"]),
    "pages": (PAGES, ["tx"]),
    "lines": (LINES, ["pages"]),
    "matched": (MATCHED, ["lines"]),
    "periods": (PERIODS, ["pages"]),
    "dated": (DATED, ["matched", "periods"]),
    "continued": (CONTINUED, ["dated"]),
    "parsed": (EXPECTED_PARSE, ["tx"]),
    "csvrows": (CSV_ROWS, ["tx"]),
    "csvparsed": (CSV_PARSED, ["csvrows"]),
    "charges": (SUB_CHARGES, ["cls"]),
    "credits": (
        "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS rn FROM tx WHERE credit > 0", ["tx"]
    ),
    "leadersteps": (LEADER_STEPS, ["credits"]),
    "clustered": (CLUSTERED, ["leadersteps"]),
    "salary": (SALARY, ["clustered"]),
    "subscriptions": (SUBSCRIPTIONS, ["cls"]),
    "expenses": (EXPENSES, ["cls"]),
    "pairs": (PAIRS, ["charges"]),
    "jumps": (JUMPS, ["pairs"]),
    "series": (SERIES, ["charges"]),
    "driftsteps": (DRIFT_STEPS, ["series"]),
    "drift": (DRIFT, ["driftsteps"]),
    "chargedays": (CHARGE_DAYS, ["charges"]),
    "gaps": (GAPS, ["charges"]),
    "intervals": (INTERVALS, ["chargedays", "gaps"]),
    "profile": (PROFILE, ["intervals"]),
    "loads": (LOADS, ["subscriptions", "salary", "expenses"]),
    "factors": (FACTORS, ["loads"]),
    "risks": (RISKS, ["factors"]),
    "usagelong": (USAGE_LONG, []),
    "usage": (USAGE, ["usagelong"]),
    "catalog": (CATALOG, []),
    "profiled": (PROFILED, ["usage", "catalog"]),
    "metrics": (METRICS, ["profiled"]),
    "verdicts": (VERDICTS, ["metrics"]),
    "insights": (INSIGHTS, ["verdicts"]),
    "calendar": (CALENDAR, []),
    "texts": (TEXTS, ["calendar"]),
    "termcounts": (term_counts("texts", "event_id"), ["texts"]),
    "vocabulary": (vocabulary("termcounts", "texts"), ["termcounts", "texts"]),
    "trainrows": (
        """SELECT * FROM texts WHERE event_id NOT IN (SELECT event_id FROM (
             SELECT event_id, row_number() OVER (PARTITION BY is_travel ORDER BY md5('42:' || event_id))
                      <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY is_travel)) AS is_test FROM calendar) WHERE is_test)""",
        ["texts", "calendar"],
    ),
    "traincounts": (term_counts("trainrows", "event_id"), ["trainrows"]),
    "folds": (
        """SELECT *, ((row_number() OVER (PARTITION BY is_travel ORDER BY md5('42:fold:' || event_id)) - 1) % 5)::INT AS fold
           FROM texts""",
        ["texts"],
    ),
    "foldcounts": ("SELECT fold, termcounts.* FROM termcounts JOIN folds USING (event_id)", ["termcounts", "folds"]),
    "away": (AWAY, ["texts"]),
    "merged": (PERIODS_MERGED, ["away"]),
    "locals": (LOCALS, []),
    "recommendations": (RECOMMENDATIONS, ["merged", "locals"]),
    "attached": (ATTACHED, ["recommendations"]),
}

RECURSIVE = {"leadersteps", "driftsteps"}


def build(body: str, needs: Sequence[str], replace: dict[str, str] | None = None) -> str:
    """``body`` behind the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in CTES[name][1]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body
    text = {name: (replace or {}).get(name, CTES[name][0]) for name in ordered}
    recursive = "RECURSIVE " if RECURSIVE & set(ordered) else ""
    return f"WITH {recursive}" + ",\n".join(f"{name} AS ({text[name]})" for name in ordered) + f"\n{body}"


def tx_from_pages() -> str:
    """Transactions as they come out of the statement pages."""
    return EXPECTED_PARSE.replace("FROM tx", f"FROM ({_tx(False)})")


def tx_from_csv() -> str:
    """Transactions as they come out of the CSV rows."""
    rows = CSV_ROWS.replace("FROM tx", f"FROM ({_tx(False)})")
    return f"SELECT * FROM ({CSV_PARSED.replace('FROM csvrows', f'FROM ({rows})')}) WHERE date IS NOT NULL AND (debit > 0 OR credit > 0)"


def tx_with_free_charges() -> str:
    return _tx(True)


def classified_wide() -> str:
    return _classified("tx", wide=True)
