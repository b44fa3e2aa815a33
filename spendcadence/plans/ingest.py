"""Queries over statement pages, CSV rows, calendar JSON and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.plans import adapters as A
from spendcadence.plans import oracle_base as S
from spendcadence.plans.registry import query
from spendcadence.session import stored
from spendcadence.sources import events as E
from spendcadence.sources import profiles as P
from spendcadence.sources import statement_csv as C
from spendcadence.sources import statement_text as X

DEFAULT_YEAR = 2020
LINE_KEY = ["account_id", "statement_id", "page_no", "pos"]
KEY_SQL = "account_id, statement_id, page_no, pos"


@query(
    "src_01_statement_pages",
    S.build("SELECT account_id, statement_id, page_no, length(text) AS n_chars, md5(text) AS digest FROM pages", ["pages"]),
)
def statement_pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.statement_pages(spark, sf).select(
        "account_id", "statement_id", "page_no", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )


@query("src_02_explode_lines", S.build(f"SELECT {KEY_SQL}, line FROM lines", ["lines"]))
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.explode_lines(A.statement_pages(spark, sf)).select(*LINE_KEY, "line")


@query("src_03_statement_period", S.build("SELECT * FROM periods", ["periods"]))
def statement_period(spark: SparkSession, sf: str) -> DataFrame:
    return X.statement_period(A.statement_pages(spark, sf))


@query("src_04_match_tx_lines", S.build(f"SELECT {KEY_SQL}, day, month_text, description, amount, sign FROM matched", ["matched"]))
def match_tx_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.explode_lines(A.statement_pages(spark, sf))
    return X.match_tx_lines(lines).select(*LINE_KEY, "day", "month_text", "description", "amount", "sign")


@query(
    "src_05_extract_balance",
    S.build(
        rf"""SELECT {KEY_SQL}, CASE WHEN found <> amount THEN found ELSE 0 END::DOUBLE AS balance
             FROM (SELECT *, try_cast(replace(regexp_extract(line, 'J\$\s+([\d,]+\.\d{{2}})\s*$', 1), ',', '') AS DOUBLE) AS found
                   FROM matched)""",
        ["matched"],
    ),
)
def extract_balance(spark: SparkSession, sf: str) -> DataFrame:
    matched = X.match_tx_lines(X.explode_lines(A.statement_pages(spark, sf)))
    return matched.select(*LINE_KEY, X.extract_balance(F.col("line"), F.col("amount")).alias("balance"))


@query("src_06_resolve_tx_date", S.build(f"SELECT {KEY_SQL}, {S.iso('date')} AS date FROM dated WHERE date IS NOT NULL", ["dated"]))
def resolve_tx_date(spark: SparkSession, sf: str) -> DataFrame:
    return X.dated_lines(A.statement_pages(spark, sf), DEFAULT_YEAR).select(*LINE_KEY, "date")


@query("src_07_append_continuation", S.build(f"SELECT {KEY_SQL}, description FROM continued", ["continued"]))
def append_continuation(spark: SparkSession, sf: str) -> DataFrame:
    dated = X.dated_lines(A.statement_pages(spark, sf), DEFAULT_YEAR)
    return dated.select(
        *LINE_KEY, X.append_continuation().alias("description")
    )


@query(
    "src_08_drop_fee_lines",
    S.build(
        f"""SELECT {KEY_SQL}, description FROM continued WHERE NOT contains(description, 'SERVICE CHARGE')
            AND NOT contains(description, 'GCT/GOVT TAX') AND NOT contains(description, 'GCT TAX')""",
        ["continued"],
    ),
)
def drop_fee_lines(spark: SparkSession, sf: str) -> DataFrame:
    described = append_continuation(spark, sf)
    return described.filter(~X.is_fee_line())


@query(
    "src_09_split_debit_credit",
    S.build(
        f"""SELECT {KEY_SQL}, CASE sign WHEN '-' THEN amount ELSE 0 END::DOUBLE AS debit,
                   CASE sign WHEN '+' THEN amount ELSE 0 END::DOUBLE AS credit FROM matched""",
        ["matched"],
    ),
)
def split_debit_credit(spark: SparkSession, sf: str) -> DataFrame:
    matched = X.match_tx_lines(X.explode_lines(A.statement_pages(spark, sf)))
    debit, credit = X.split_debit_credit(F.col("amount"), F.col("sign"))
    return matched.select(*LINE_KEY, debit.alias("debit"), credit.alias("credit"))


PARSED = ["account_id", "statement_id", "date", "description", "debit", "credit", "balance"]


@query(
    "src_10_parse_statements",
    S.build(f"SELECT * REPLACE ({S.iso('date')} AS date) FROM parsed", ["parsed"]),
)
def parse_statements(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_pages(spark, sf)


def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions of the pages, which are rendered once, as periods and long accounts are read from them too."""
    return X.parse_statements(stored(A.statement_pages(spark, sf)), DEFAULT_YEAR)


def parsed_csv(spark: SparkSession, sf: str) -> DataFrame:
    layouts = [C.read_statement_rows(layout, ["account_id", "seq"]) for layout in A.csv_layouts(spark, sf)]
    return C.union_statements(layouts)


@query(
    "src_11_statement_csv",
    S.build(
        f"""SELECT * REPLACE ({S.iso('date')} AS date) FROM csvparsed
            WHERE date IS NOT NULL AND (debit > 0 OR credit > 0)""",
        ["csvparsed"],
    ),
)
def statement_csv(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_csv(spark, sf)


@query(
    "src_12_parse_date_multi",
    S.build(f"SELECT seq, date_text, {S.iso(S.parse_date('date_text', 'seq % 12'))} AS date FROM csvrows", ["csvrows"]),
)
def parse_date_multi(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.csv_rows(spark, sf).select("seq", F.col("date").alias("date_text"))
    return T.with_parsed_date(rows, "date_text", "date")


@query(
    "src_13_parse_amount",
    S.build(
        f"""SELECT seq, {S.parse_amount('debit_text')} AS debit, {S.parse_amount('credit_text')} AS credit,
                   {S.parse_amount('signed_text')} AS amount FROM csvrows""",
        ["csvrows"],
    ),
)
def parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    return A.csv_rows(spark, sf).select(
        "seq", *[T.parse_amount(F.col(c)).alias(c) for c in ("debit", "credit", "amount")]
    )


_FALLBACK = f"""
  SELECT seq, CASE WHEN d = 0 AND c = 0 AND s < 0 THEN -s ELSE d END::DOUBLE AS debit,
         CASE WHEN d = 0 AND c = 0 AND s > 0 THEN s ELSE c END::DOUBLE AS credit, date
  FROM (SELECT seq, {S.parse_amount('debit_text')} AS d, {S.parse_amount('credit_text')} AS c,
               coalesce({S.signed_amount('signed_text')}, 0) AS s, {S.parse_date('date_text', 'seq % 12')} AS date FROM csvrows)"""


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.with_parsed_date(A.csv_rows(spark, sf), "date", "date")
    debit, credit = C.signed_amount_fallback(
        T.parse_amount(F.col("debit")), T.parse_amount(F.col("credit")),
        F.coalesce(T.signed_amount(F.col("amount")), F.lit(0.0)),
    )
    return rows.select("seq", debit.alias("debit"), credit.alias("credit"), "date")


@query("src_14_signed_amount_fallback", S.build(f"SELECT seq, debit, credit FROM ({_FALLBACK})", ["csvrows"]))
def signed_amount_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("seq", "debit", "credit")


@query(
    "src_15_valid_tx_filter",
    S.build(
        f"""SELECT seq, {S.iso('date')} AS date, debit, credit FROM ({_FALLBACK})
            WHERE date IS NOT NULL AND (debit > 0 OR credit > 0)""",
        ["csvrows"],
    ),
)
def valid_tx_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sides(spark, sf)
    return rows.filter(C.valid_tx(F.col("date"), F.col("debit"), F.col("credit"))).select("seq", "date", "debit", "credit")


def _text_lines(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    patterns = ["dd/MM/yyyy", "d-M-yyyy", "d MMM yyyy", "dd/MM/yy", "yyyy-MM-dd"]
    chain = None
    for i, pattern in enumerate(patterns):
        text = F.date_format("date", pattern)
        chain = F.when(seq % 6 == i, text) if chain is None else chain.when(seq % 6 == i, text)
    day = chain.otherwise("undated")
    parts = [
        day,
        F.col("description"),
        F.when(seq % 4 > 0, F.format_number(F.greatest("debit", "credit"), 2)),
        F.when(seq % 4 > 1, F.format_number(10.0 + seq % 90, 2)),
        F.when(seq % 4 > 2, F.format_number(100000.0 + seq, 2)),
    ]
    return A.transactions(spark, sf).select("seq", F.concat_ws("  ", *parts).alias("line"))


@query(
    "src_16_parse_text_line",
    S.build(
        f"""SELECT seq, {S.iso('date')} AS date,
              trim(regexp_replace(replace(replace(replace(rest, a1, ''), coalesce(a2, a1), ''), coalesce(a3, a1), ''),
                   '\\s+', ' ', 'g')) AS description,
              replace(a1, ',', '')::DOUBLE AS debit, coalesce(replace(a2, ',', '')::DOUBLE, 0) AS credit,
              coalesce(replace(a3, ',', '')::DOUBLE, 0) AS balance
            FROM (SELECT seq, date, concat_ws('  ', description, a1, a2, a3) AS rest, a1, a2, a3
                  FROM (SELECT seq, date, description, format('{{:,.2f}}', greatest(debit, credit)) AS a1,
                               CASE WHEN seq % 4 > 1 THEN format('{{:,.2f}}', (10 + seq % 90)::DOUBLE) END AS a2,
                               CASE WHEN seq % 4 > 2 THEN format('{{:,.2f}}', (100000 + seq)::DOUBLE) END AS a3
                        FROM tx WHERE seq % 4 > 0 AND seq % 6 < 4))""",
        ["tx"],
    ),
)
def parse_text_line(spark: SparkSession, sf: str) -> DataFrame:
    return C.parse_text_lines(_text_lines(spark, sf)).select("seq", "date", "description", "debit", "credit", "balance")


@query(
    "src_17_parse_cell_row",
    S.build(
        f"""SELECT seq, {S.iso('date')} AS date, description, greatest(debit, credit) AS debit,
                   CASE WHEN seq % 4 = 2 THEN 10 + seq % 90 ELSE 0 END::DOUBLE AS credit
            FROM tx WHERE seq % 4 IN (0, 2)""",
        ["tx"],
    ),
)
def parse_cell_row(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    day = F.date_format("date", "yyyy-MM-dd")
    amount = F.format_string("%.2f", F.greatest("debit", "credit"))
    second = F.format_string("%.2f", 10.0 + seq % 90)
    cells = (
        F.when(seq % 4 == 0, F.array(day, amount, F.col("description"), F.lit("")))
        .when(seq % 4 == 1, F.array(day, F.col("description"), amount, F.lit(None).cast("string")))
        .when(seq % 4 == 2, F.array(amount, F.lit(""), second, day, F.col("description")))
        .otherwise(F.array(F.lit(""), F.col("description"), F.lit("-")))
    )
    parsed = A.transactions(spark, sf).withColumn("_tx", C.parse_cell_row(cells))
    return parsed.filter(F.col("_tx").isNotNull()).select("seq", "_tx.*")


_TOGETHER = """
  SELECT account_id, statement_id, date, description, debit, credit, balance FROM parsed
  UNION ALL
  SELECT account_id, '0-csv-' || seq % 3, date, description, debit, credit, balance FROM csvparsed
  WHERE date IS NOT NULL AND (debit > 0 OR credit > 0)"""


def _files(spark: SparkSession, sf: str) -> list[DataFrame]:
    csv = parsed_csv(spark, sf).withColumn("statement_id", F.concat(F.lit("0-csv-"), (F.col("seq") % 3).cast("string")))
    return [parsed_pages(spark, sf).select(*PARSED), csv.select(*PARSED)]


@query(
    "src_18_union_statements",
    S.build(f"SELECT account_id, statement_id, {S.iso('date')} AS date, description, debit, credit, balance FROM ({_TOGETHER})", ["parsed", "csvparsed"]),
)
def union_statements(spark: SparkSession, sf: str) -> DataFrame:
    return C.union_statements(_files(spark, sf))


@query(
    "src_18_first_files",
    S.build(
        f"""SELECT account_id, statement_id, {S.iso('date')} AS date, description, debit, credit, balance
            FROM (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY statement_id) AS nth FROM ({_TOGETHER}))
            WHERE nth <= 4""",
        ["parsed", "csvparsed"],
    ),
)
def first_files(spark: SparkSession, sf: str) -> DataFrame:
    """With the limit of a file dialog: four files an account."""
    return C.union_statements(_files(spark, sf), max_files=4)


_FLAT_EVENTS = """
  SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN summary ELSE 'No Title' END AS summary,
         CASE WHEN contains(start, 'T') OR event_id % 41 <> 0 THEN start ELSE '' END AS start,
         CASE WHEN contains("end", 'T') OR event_id % 41 <> 0 THEN "end" ELSE '' END AS "end",
         location, description FROM calendar"""


def _flat_events(spark: SparkSession, sf: str) -> DataFrame:
    items = A.calendar_json(spark, sf).select(F.from_json("json", E.EVENT_SCHEMA).alias("item")).select("item.*")
    return E.flatten_events(items)


@query("src_19_calendar_events", S.build(_FLAT_EVENTS, ["calendar"]))
def calendar_events(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_events(spark, sf)


@query(
    "src_20_events_in_horizon",
    S.build(
        f"""SELECT user_id, event_id, summary, {S.iso('start_date')} AS start_date, {S.iso('end_date')} AS end_date
            FROM calendar WHERE start_date < DATE '1998-01-01' + 182
              AND (end_date > DATE '1998-01-01' OR start_date >= DATE '1998-01-01')""",
        ["calendar"],
    ),
)
def events_in_horizon(spark: SparkSession, sf: str) -> DataFrame:
    events = E.events_in_horizon(A.calendar_events(spark, sf), A.TODAY_TRAVEL, 6)
    return events.select("user_id", "event_id", "summary", "start_date", "end_date").orderBy("start_date", "event_id")


@query(
    "src_21_events_preview",
    S.build(
        f"""SELECT user_id, position::INT AS position, CASE WHEN start = '' THEN '?' ELSE substr(start, 1, 10) END AS date, summary, location
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS position FROM ({_FLAT_EVENTS}))
            WHERE position <= 15""",
        ["calendar"],
    ),
)
def events_preview(spark: SparkSession, sf: str) -> DataFrame:
    return E.events_preview(_flat_events(spark, sf))


@query("src_22_labeled_events", S.build("SELECT event_id, text, is_travel AS label, trigger_type FROM texts", ["texts"]))
def labeled_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.labeled_events(A.labeled_rows(spark, sf))


_REPLIES = """
  SELECT user_id, app_name, frequency IS NOT NULL AND user_id % 5 <> 3 AS decoded, frequency, category, value_mode,
         engagement_type, is_multi_device, has_free_tier, is_shared_plan, student_plan_price::DOUBLE AS student_plan_price,
         claimed AS pricing_verified, m::DOUBLE AS monthly_price, y::DOUBLE AS yearly_price, l::DOUBLE AS lifetime_price
  FROM usage LEFT JOIN catalog USING (app_name)"""
PROFILE_FIELDS = list(P.DEFAULT_PROFILE)
_DECODED = ", ".join(f"CASE WHEN decoded THEN {c} END AS {c}" for c in P.DEFAULT_PROFILE)


@query(
    "src_23_decode_profile_json",
    S.build(f"SELECT user_id, app_name, decoded, {_DECODED} FROM ({_REPLIES})", ["usage", "catalog"]),
)
def decode_profile_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every reply, decoded or not; the fields of one that isn't are null."""
    decoded = P.decode_profile_json(A.raw_replies(spark, sf))
    return decoded.select(
        "user_id", "app_name", "decoded", *[F.when(F.col("decoded"), F.col(c)).alias(c) for c in PROFILE_FIELDS]
    )


def _defaults_sql() -> str:
    fields = ", ".join(
        f"CASE WHEN decoded THEN {c} ELSE {S.quote(v)} END AS {c}" for c, v in P.DEFAULT_PROFILE.items()
    )
    return f"SELECT user_id, app_name, {fields} FROM ({_REPLIES})"


@query("src_24_profile_defaults", S.build(_defaults_sql(), ["usage", "catalog"]))
def profile_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Every app: an undecodable reply, and one that never came, give the default record."""
    decoded = decode_profile_json(spark, sf)
    return P.apply_defaults(decoded).select("user_id", "app_name", *PROFILE_FIELDS)
