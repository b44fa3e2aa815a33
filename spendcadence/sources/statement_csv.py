"""Bank-statement CSV, free-text lines and cell rows to transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.functions.fence import compute_once
from spendcadence.operators.ordered import with_rank
from spendcadence.session import stored

# Accepted header spellings, first non-empty one wins.
ALIASES = {
    "date": ["date", "transaction date", "post date", "value date"],
    "description": ["description", "details", "narrative", "particulars"],
    "debit": ["debit", "withdrawal", "dr"],
    "credit": ["credit", "deposit", "cr"],
    "amount": ["amount"],
    "balance": ["balance", "running balance"],
}

TRANSACTION = ["date", "description", "debit", "credit", "balance"]
AMOUNTS = r"[\d,]+\.\d{2}"
LINE_DATES = [r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{1,2}\s+\w{3}\s+\d{2,4})"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with one header layout, as text."""
    return spark.read.option("header", True).csv(path)


FILE_NAME = r"^(\d+)_(.+)\.csv$"


def line_cells(line: Column) -> Column:
    """The cells of a CSV line, however many: separated by commas, in quotes if need be, a quote in quotes doubled."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), '""', '"')
    # A comma before the line makes the first cell begin like the others.
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), quoted(c)).otherwise(c))


def read_statement_files(spark: SparkSession, path: str) -> DataFrame:
    """Text cells of CSV files named ``<account>_<statement>.csv``, each laid out by its own header of any width.

    A row is a line; cells behind the header's last are not used, missing ones are null, and empty lines are left out.  Rows carry account_id, statement_id and seq, which numbers an account's rows by statement and place in the
    file.  Files can be split: a row's place is its block's offset and its number within the block, and blocks of a large file
    are numbered apart.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_row"),
            F.regexp_replace("value", "\r$", "").alias("_line"),
        )
        .filter(F.col("_line") != "")
        .withColumn("_cells", line_cells(F.col("_line")))
        .drop("_line")
    )
    titles = F.transform("_cells", lambda c: F.lower(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", ""))))
    lines = lines.withColumn("_titles", titles)
    heading = F.arrays_overlap("_titles", F.lit(ALIASES["date"])) & F.arrays_overlap("_titles", F.lit(ALIASES["description"]))
    lines = lines.withColumn("_heading", heading)
    headers = (
        lines.filter("_heading")
        .groupBy("_file")
        .agg(F.min_by("_titles", F.struct("_at", "_row")).alias("_header"))
    )

    def cell(spelling: str) -> Column:
        return T.blank_to_null(F.get("_cells", (F.array_position("_header", spelling) - 1).cast("int")))

    laid_out = (
        lines.filter("NOT _heading")
        .join(headers, "_file")
        .select(
            F.regexp_extract("_file", FILE_NAME, 1).try_cast("bigint").alias("account_id"),
            F.regexp_extract("_file", FILE_NAME, 2).alias("statement_id"),
            "_at",
            "_row",
            *[F.coalesce(*[cell(s) for s in spellings]).alias(target) for target, spellings in ALIASES.items()],
        )
    )
    order = ["statement_id", "_at", "_row"]
    numbered = with_rank(laid_out, ["account_id"], order, F.col("statement_id"), F.col("_at"), "seq")
    return numbered.select("account_id", "statement_id", F.col("seq").cast("bigint").alias("seq"), *ALIASES)


def normalise_headers(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Map any known header spelling (case and blanks ignored) to the six standard text columns."""
    by_name = {name.lower().strip().lstrip("﻿"): name for name in raw.columns}
    picked = []
    for target, spellings in ALIASES.items():
        present = [T.blank_to_null(F.col(f"`{by_name[s]}`")) for s in spellings if s in by_name]
        value = F.coalesce(*present) if present else F.lit(None).cast("string")
        picked.append(value.alias(target))
    return raw.select(*keep, *picked)


def signed_amount_fallback(debit: Column, credit: Column, signed: Column) -> tuple[Column, Column]:
    """Use a single signed amount when both sides are 0; its sign tells the side."""
    both_zero = (debit == 0) & (credit == 0)
    return (
        F.when(both_zero & (signed < 0), -signed).otherwise(debit),
        F.when(both_zero & (signed > 0), signed).otherwise(credit),
    )


def valid_tx(date: Column, debit: Column, credit: Column) -> Column:
    return date.isNotNull() & ((debit > 0) | (credit > 0))


def read_statement_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text rows of one header layout to valid transactions."""
    rows = T.with_parsed_date(normalise_headers(raw, keep), "date", "date")
    sides = rows.withColumns(
        {
            "debit": T.parse_amount(F.col("debit")),
            "credit": T.parse_amount(F.col("credit")),
            "_signed": F.coalesce(T.signed_amount(F.col("amount")), F.lit(0.0)),
        }
    )
    debit, credit = signed_amount_fallback(F.col("debit"), F.col("credit"), F.col("_signed"))
    parsed = compute_once(sides, {"debit": debit, "credit": credit}).select(
        *keep,
        "date",
        F.coalesce("description", F.lit("")).alias("description"),
        "debit",
        "credit",
        T.parse_amount(F.col("balance")).alias("balance"),
    )
    return parsed.filter(valid_tx(F.col("date"), F.col("debit"), F.col("credit")))


def parse_text_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Free-text lines that hold a date and an amount, as transactions.

    The first date pattern whose match is a real date wins; the description is
    the text after it without the amounts.
    """
    text = F.col(line)
    staged = df.withColumn("_amounts", F.regexp_extract_all(text, F.lit(f"({AMOUNTS})"), F.lit(1)))
    staged = staged.filter(F.size("_amounts") > 0)
    for i, pattern in enumerate(LINE_DATES):
        staged = T.with_parsed_date(staged.withColumn(f"_d{i}", F.regexp_extract(text, pattern, 1)), f"_d{i}", f"_d{i}")
    tails = [F.regexp_replace(text, "^.*?" + pattern, "") for pattern in LINE_DATES]
    staged = staged.withColumns(
        {
            "date": F.coalesce(*[F.col(f"_d{i}") for i in range(len(LINE_DATES))]),
            "_rest": F.when(F.col("_d0").isNotNull(), tails[0]).otherwise(tails[1]),
        }
    ).filter(F.col("date").isNotNull())
    amounts, count = F.col("_amounts"), F.size("_amounts")

    def number(index: int) -> Column:
        return F.regexp_replace(F.try_element_at(amounts, F.lit(index)), ",", "").try_cast("double")

    cleaned = F.aggregate(amounts, F.col("_rest"), lambda rest, amount: F.replace(rest, amount, F.lit("")))
    return staged.withColumns(
        {
            "description": T.strip(F.regexp_replace(cleaned, r"\s+", " ")),
            "debit": number(1),
            "credit": F.coalesce(number(2), F.lit(0.0)),
            "balance": F.when(count >= 3, number(-1)).otherwise(F.lit(0.0)),
        }
    ).drop("_amounts", "_rest", *[f"_d{i}" for i in range(len(LINE_DATES))])


def parse_cell_row(cells: Column) -> Column:
    """Struct of an unlabelled row: first date, first long text, first and second amount; null if incomplete."""
    start = F.expr("named_struct('date', cast(null as date), 'description', '', 'debit', 0.0D, 'credit', 0.0D)")

    def state(date: Column, description: Column, debit: Column, credit: Column) -> Column:
        return F.struct(
            date.alias("date"), description.alias("description"), debit.alias("debit"), credit.alias("credit")
        )

    def step(row: Column, cell: Column) -> Column:
        date, text, debit, credit = row["date"], row["description"], row["debit"], row["credit"]
        found = T.parse_date(cell)
        amount = T.parse_amount(cell)
        open_text = text == ""
        plain_number = F.regexp_replace(cell, "[,.]", "").rlike(r"^\d+$")
        long_text = (F.length(cell) > 10) & ~plain_number
        return (
            F.when(cell.isNull() | (cell == ""), row)
            .when(date.isNull() & found.isNotNull(), state(found, text, debit, credit))
            .when(
                (amount > 0) & open_text,
                F.when(long_text, state(date, cell, debit, credit))
                .when(debit == 0, state(date, text, amount, credit))
                .otherwise(state(date, text, debit, amount)),
            )
            .when((F.length(cell) > 3) & open_text, state(date, cell, debit, credit))
            .otherwise(row)
        )

    folded = F.aggregate(cells, start, step)
    return F.when(valid_tx(folded["date"], folded["debit"], folded["credit"]), folded)


def limit_files(files: DataFrame, key: str = "account_id", order: str = "statement_id", n: int = 4) -> DataFrame:
    """The first n statement files per account (a group limit below the shuffle)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return files.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def union_statements(
    parsed: Sequence[DataFrame], key: str = "account_id", file: str = "statement_id", max_files: int | None = None
) -> DataFrame:
    """Transactions of several files per account; ``max_files`` keeps the first so many files of each.

    To find those, transactions are written once below the checkpoint folder, so that no file is parsed twice.
    """
    together = parsed[0]
    for more in parsed[1:]:
        together = together.unionByName(more)
    if max_files is None:
        return together
    together = stored(together)
    kept = limit_files(together.select(key, file).distinct(), key, file, max_files)
    return together.join(kept, [key, file], "left_semi")
