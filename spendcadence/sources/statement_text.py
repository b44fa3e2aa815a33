"""Bank-statement page text to transactions.

One row per page comes in; a page is the unit of work, so everything up to the
exploded lines happens inside the row.  The period joins the pages before their
lines are exploded, so each text travels once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.functions.fence import compute_once
from spendcadence.operators.ordered import HOT_ROWS, with_rank

STATEMENT = ["account_id", "statement_id"]
DEFAULT_CURRENCY = r"J\$"
PART_SEPARATOR = "\x1f"

# Statement patterns; {currency} is a parameter.
PERIOD = r"Statement Period:.*?(\d{2}[A-Z]{3})(\d{2})\s+to\s+(\d{2}[A-Z]{3})(\d{2})"
TX_LINE = r"^(\d{2})([A-Z]{3})\s+(.+?)\s+{currency}\s+([\d,]+\.\d{2})\s*([+\-])"
BALANCE = r"{currency}\s+([\d,]+\.\d{2})\s*$"
DATED = r"^\d{2}[A-Z]{3}\s"


def read_statement_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a Parquet table ``account_id, statement_id, page_no, text``."""
    return spark.read.parquet(path).select(*STATEMENT, "page_no", "text")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages from text files named ``<account>_<statement>_<page>.txt``, one page per file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    parts = r"^(\d+)_(.+)_(\d+)\.txt$"
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(name, parts, 1).try_cast("bigint").alias("account_id"),
        F.regexp_extract(name, parts, 2).alias("statement_id"),
        F.regexp_extract(name, parts, 3).try_cast("int").alias("page_no"),
        F.col("value").alias("text"),
    )


def explode_lines(pages: DataFrame) -> DataFrame:
    """Trimmed lines with their position and the next line of the same page."""
    lines = F.transform(F.split("text", "\n"), T.strip)
    placed = pages.filter(F.col("text") != "").withColumn("_lines", lines)
    entries = F.transform(
        "_lines",
        lambda line, i: F.struct(
            i.cast("int").alias("pos"), line.alias("line"), F.get(F.col("_lines"), i + 1).alias("next_line")
        ),
    )
    own = [c for c in pages.columns if c != "text"]
    return placed.select(*own, F.inline(entries))


def statement_period(pages: DataFrame) -> DataFrame:
    """Start and end of the period, read from page 1; the statement year is the end year."""

    def part(group: int) -> Column:
        return F.regexp_extract("text", PERIOD, group)

    return (
        pages.filter((F.col("page_no") == 1) & F.col("text").rlike(PERIOD))
        .select(
            *STATEMENT,
            T.month_number(F.substring(part(1), 3, 3)).alias("start_month"),
            (part(2).cast("int") + 2000).alias("start_year"),
            (part(4).cast("int") + 2000).alias("statement_year"),
        )
        .withColumn("start_month", F.coalesce("start_month", F.lit(1)))
    )


def match_tx_lines(lines: DataFrame, currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """Lines that open a transaction, split into their parts.

    The pattern runs once per line: a match is rewritten to its five groups
    around a separator, any other line keeps a single part.
    """
    pattern = TX_LINE.replace("{currency}", currency) + r".*$"
    groups = PART_SEPARATOR.join(f"${i}" for i in range(1, 6))
    rewritten = F.when(
        F.col("line").rlike(r"^\d{2}[A-Z]{3}\s"), F.regexp_replace("line", pattern, groups)
    )
    parts = F.col("_parts")
    split = compute_once(lines, {"_parts": F.split(rewritten, PART_SEPARATOR)})
    return compute_once(
        split.filter(F.size(parts) == 5),
        {
            "day": parts[0].cast("int"),
            "month_text": parts[1],
            "description": T.strip(parts[2]),
            "amount": F.replace(parts[3], F.lit(","), F.lit("")).try_cast("double"),
            "sign": parts[4],
        },
        drop=("_parts",),
    )


def extract_balance(line: Column, amount: Column, currency: str = DEFAULT_CURRENCY) -> Column:
    """Amount at the end of the line unless it is the transaction itself; 0 when unknown."""
    found = F.regexp_extract(line, BALANCE.replace("{currency}", currency), 1)
    value = F.regexp_replace(found, ",", "").try_cast("double")
    return F.when(value.isNotNull() & (value != amount), value).otherwise(F.lit(0.0))


def resolve_tx_date(day: Column, month_text: Column, start_month: Column, start_year: Column, year: Column) -> Column:
    """Day and month in the right year of the period; null for impossible dates.

    Months from the start month on belong to the start year when the period
    crosses into a new year.
    """
    month = F.coalesce(T.month_number(month_text), F.lit(1))
    crosses = (start_year < year) & (month >= start_month)
    return T.safe_date(F.when(crosses, start_year).otherwise(year), month, day)


def append_continuation(text: str = "description", following: str = "next_line") -> Column:
    """Join a following free-text line with `` | ``."""
    description, next_line = F.col(text), F.col(following)
    continues = (
        next_line.isNotNull()
        & (next_line != "")
        & ~next_line.rlike(DATED)
        & ~next_line.startswith("*")
        & ~next_line.startswith("Page ")
        & ~T.contains_any(text, R.NO_CONTINUATION_PHRASES)
    )
    return F.when(continues, F.concat(description, F.lit(" | "), next_line)).otherwise(description)


def is_fee_line(text: str = "description") -> Column:
    return T.contains_any(text, R.FEE_PHRASES)


def split_debit_credit(amount: Column, sign: Column) -> tuple[Column, Column]:
    """(debit, credit) from a signed line."""
    return F.when(sign == "-", amount).otherwise(F.lit(0.0)), F.when(sign == "+", amount).otherwise(F.lit(0.0))


def dated_lines(pages: DataFrame, default_year: int, currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """Transaction lines with their resolved date; impossible dates are dropped."""
    with_period = pages.join(statement_period(pages), STATEMENT, "left").withColumns(
        {
            "statement_year": F.coalesce("statement_year", F.lit(default_year)),
            "start_year": F.coalesce("start_year", "statement_year", F.lit(default_year)),
            "start_month": F.coalesce("start_month", F.lit(1)),
        }
    )
    matched = match_tx_lines(explode_lines(with_period), currency)
    date = resolve_tx_date(
        F.col("day"), F.col("month_text"), F.col("start_month"), F.col("start_year"), F.col("statement_year")
    )
    return compute_once(matched, {"date": date}).filter(F.col("date").isNotNull())


def accounts_with_many_lines(pages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Accounts that may have more than ``hot_rows`` transactions, told by their lines; nothing is parsed for it."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = pages.groupBy("account_id").agg(F.sum(breaks + 1).alias("_lines"))
    return lines.filter(F.col("_lines") > hot_rows).select("account_id")


def parse_statements(pages: DataFrame, default_year: int, currency: str = DEFAULT_CURRENCY) -> DataFrame:
    """Pages to transactions.

    ``seq`` numbers an account's transactions from 1 by period, statement, page and line, so that statements of
    one account follow each other.
    """
    debit, credit = split_debit_credit(F.col("amount"), F.col("sign"))
    described = compute_once(
        dated_lines(pages, default_year, currency),
        {"description": append_continuation()},
    )
    placed = described.filter(~is_fee_line()).select(
        *STATEMENT,
        "page_no",
        "pos",
        F.make_date("start_year", "start_month", F.lit(1)).alias("_from"),
        "date",
        "description",
        debit.alias("debit"),
        credit.alias("credit"),
        extract_balance(F.col("line"), F.col("amount"), currency).alias("balance"),
    )
    order = ["_from", "statement_id", "page_no", "pos"]
    numbered = with_rank(
        placed, ["account_id"], order, F.col("_from"), F.lit(0), "seq", hot=accounts_with_many_lines(pages)
    )
    return numbered.select(
        *STATEMENT, F.col("seq").cast("bigint").alias("seq"), "date", "description", "debit", "credit", "balance"
    )
