"""Text, date and number parsing as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.functions.fence import compute_once

# English month names; strptime accepts both spellings.
MONTHS = [
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"),
    ("may", "may"), ("jun", "june"), ("jul", "july"), ("aug", "august"),
    ("sep", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
]


WHITE_SPACE = " \t\n\r\f\v"


def _quoted(value: object) -> str:
    """A Spark SQL literal."""
    if isinstance(value, (bool, int)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


# The three helpers below take a column *name* and build one SQL text: a rule
# table becomes a single expression instead of hundreds of calls into the JVM,
# and the name makes sure that the tested text is computed once, by the caller.


def contains_any(text: str, words: Sequence[str]) -> Column:
    """True when at least one of the words is a substring of the named column."""
    return F.expr("(" + " OR ".join(f"contains({text}, {_quoted(word)})" for word in words) + ")")


def count_contained(text: str, words: Sequence[str]) -> Column:
    """How many of the words are substrings of the named column (each word counts once)."""
    return F.expr("(" + " + ".join(f"cast(contains({text}, {_quoted(word)}) as int)" for word in words) + ")")


def first_rule(text: str, rules: Sequence[tuple[str, object]]) -> Column:
    """Label of the first rule, in list order, whose keyword is a substring of the named column.

    One lazily evaluated CASE, so it stays inside whole-stage codegen; an
    alternation regex would pick the leftmost position instead of the first rule.
    """
    arms = " ".join(f"WHEN contains({text}, {_quoted(keyword)}) THEN {_quoted(label)}" for keyword, label in rules)
    return F.expr(f"CASE {arms} END")


def strip(text: Column) -> Column:
    """Remove white space, not only blanks, at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters (``hi-lo`` -> ``Hi-Lo``)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda run: F.initcap(run))
    return F.array_join(cased, "")


def vendor_key(vendor: Column) -> Column:
    """Grouping key of a vendor display name."""
    return F.lower(strip(vendor))


def month_number(name: Column) -> Column:
    """1..12 from an abbreviated or full English month name, else null."""
    names = ", ".join(_quoted(spelling) for pair in MONTHS for spelling in pair)
    place = F.array_position(F.expr(f"array({names})"), F.lower(name))
    return F.nullif(F.ceil(place / 2).cast("int"), F.lit(0))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A DATE, or null when the parts do not name a real day (never raises)."""
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")
    ).try_cast("date")


# Shapes of date texts; the shape picks the branch, so no format is tried by
# raising and catching, which would dominate the cost of a large load.
YEAR_FIRST = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
YEAR_FIRST_DASH = r"^\d{4}-\d{1,2}-\d{1,2}$"
SLASHES = r"^\d{1,2}/\d{1,2}/\d{4}$"
SLASHES_SHORT = r"^\d{1,2}/\d{1,2}/\d{2}$"
DAY_FIRST_DASH = r"^\d{1,2}-\d{1,2}-\d{4}$"
DAY_NAME = r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$"
NAME_DAY = r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$"


def date_tokens(trimmed: Column) -> Column:
    """The three parts of a date text."""
    return F.split(trimmed, r"[-/]|,?\s+")


def _either(first: Column, second: Column, year: Column) -> Column:
    """Day before month when that is a real day, else month before day."""
    return F.coalesce(safe_date(year, second, first), safe_date(year, first, second))


def date_from_tokens(trimmed: Column, tokens: Column) -> Column:
    """First of eleven statement date formats that fits, else null."""
    a, b, c = (F.get(tokens, i) for i in range(3))
    # Two-digit years: 69..99 belong to the 1900s, 00..68 to the 2000s.
    full_year = F.concat(F.when(c >= "69", F.lit("19")).otherwise(F.lit("20")), c)
    return (
        F.when(trimmed.rlike(YEAR_FIRST), safe_date(a, b, c))
        .when(trimmed.rlike(SLASHES), _either(a, b, c))
        .when(trimmed.rlike(DAY_FIRST_DASH), safe_date(c, b, a))
        .when(trimmed.rlike(DAY_NAME), safe_date(c, month_number(b), a))
        .when(trimmed.rlike(NAME_DAY), safe_date(c, month_number(a), b))
        .when(trimmed.rlike(SLASHES_SHORT), _either(a, b, full_year))
    )


def with_parsed_date(df: DataFrame, text: str, name: str) -> DataFrame:
    """Replace or add ``name`` = date of a text column.

    The trimmed text and its tokens are columns of their own, so that they are
    computed once and the projection stays small enough to be code-generated.
    """
    staged = df.withColumn("_text", strip(F.col(text))).withColumn("_tokens", date_tokens(F.col("_text")))
    date = date_from_tokens(F.col("_text"), F.col("_tokens"))
    return compute_once(staged, {name: date}, drop=("_text", "_tokens"))


def parse_date(text: Column) -> Column:
    """:func:`with_parsed_date` as one expression, for use inside array folds."""
    return F.element_at(
        F.transform(
            F.array(strip(text)), lambda t: F.element_at(
                F.transform(F.array(date_tokens(t)), lambda tokens: date_from_tokens(t, tokens)), 1
            )
        ),
        1,
    )


def with_event_date(df: DataFrame, text: str, name: str, today: str) -> DataFrame:
    """Calendar date text as ``yyyy-MM-dd``; unknown shapes stay as they are, empty means today."""
    staged = df.withColumn("_text", F.substring_index(strip(F.col(text)), "T", 1)).withColumn(
        "_tokens", date_tokens(F.col("_text"))
    )
    t, tokens = F.col("_text"), F.col("_tokens")
    a, b, c = (F.get(tokens, i) for i in range(3))
    parsed = (
        F.when(t.rlike(SLASHES), _either(a, b, c))
        .when(t.rlike(YEAR_FIRST_DASH), safe_date(a, b, c))
        .when(t.rlike(DAY_NAME) & (F.length(b) == 3), safe_date(c, month_number(b), a))
        .when(t.rlike(NAME_DAY) & F.lower(a).isin(*[full for _, full in MONTHS]), safe_date(c, month_number(a), b))
    )
    shown = (
        F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit(today))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), t))
    )
    return compute_once(staged, {name: shown}, drop=("_text", "_tokens"))


def signed_amount(text: Column) -> Column:
    """Number in a money text with its sign; null when there is none."""
    cleaned = F.regexp_replace(text, r"[^0-9.\-]", "")
    return cleaned.try_cast("double")


def parse_amount(text: Column) -> Column:
    """Absolute value of a money text, 0 when unreadable."""
    return F.coalesce(F.abs(signed_amount(text)), F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Round ties to the even digit."""
    return F.bround(value, digits)


def money(value: Column) -> Column:
    """Two decimals as text."""
    return F.format_string("%.2f", F.bround(value.cast("double"), 2))


def as_cents_decimal(value: Column) -> Column:
    """Two-decimal money as an exact type, so that sums do not depend on order."""
    return value.cast("decimal(18,2)")
