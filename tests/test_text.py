import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendcadence.functions import text as T


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_title_case(spark):
    given = ["hi-lo", "Disney+", "iCloud", "HBO Max", "a1b o'neil", ""]
    assert column(spark, given, T.title_case) == [v.title() for v in given]


DATES = [
    "2024-01-05", "5/1/2024", "01/13/2024", "13-1-2024", "5 Jan 2024", "5 january 2024", "Jan 5, 2024", "January 5, 2024",
    "05/01/24", "1/13/24", "2024/1/5", " 2024-01-05 ", "31/02/2024", "", "soon", "2024-13-01", "5 Foo 2024", "01/02/70",
    "2024-1/5", "05-01-24",
]


def python_date(text):
    formats = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%d/%m/%y",
               "%m/%d/%y", "%Y/%m/%d"]
    for fmt in formats:
        try:
            return dt.datetime.strptime(text.strip(), fmt).date()
        except ValueError:
            continue
    return None


def test_parse_date_both_forms(spark):
    expected = [python_date(d) for d in DATES]
    assert column(spark, DATES, T.parse_date) == expected
    df = spark.createDataFrame(list(enumerate(DATES)), "i int, v string")
    staged = T.with_parsed_date(df, "v", "d").orderBy("i").collect()
    assert [r["d"] for r in staged] == expected


def test_parse_event_date(spark):
    given = ["2025-06-15T10:00:00-05:00", "2025-06-15", "15/06/2025", "06/15/2025", "15 Jun 2025", "June 15, 2025", "", None,
             "mid June", "15 June 2025"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    found = [r["d"] for r in T.with_event_date(df, "v", "d", "2025-01-01").orderBy("i").collect()]
    assert found == ["2025-06-15"] * 6 + ["2025-01-01", "2025-01-01", "mid June", "15 June 2025"]


@pytest.mark.parametrize(
    "text,value", [("$1,234.50", 1234.5), ("-12.00", 12.0), ("J$ 3.5", 3.5), ("n/a", 0.0), ("", 0.0), ("1.2.3", 0.0), ("5-", 0.0)]
)
def test_parse_amount(spark, text, value):
    assert column(spark, [text], T.parse_amount) == [value]


def test_rule_order_beats_position(spark):
    df = spark.createDataFrame([("calm youtube",), ("island grill",), ("none",)], "t string")
    rules = [("youtube", "first"), ("calm", "second"), ("grill", "third"), ("island grill", "never")]
    assert [r[0] for r in df.select(T.first_rule("t", rules)).collect()] == ["first", "third", None]
