"""Operator inputs derived from the given tables, by formulas that Spark and SQL can both state.

Everything is keyed by many accounts or users and grows with the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendcadence.operators.travel_features import combine_text, travel_to_away
from spendcadence.operators.usage import weekly_hours
from spendcadence.sources.profiles import attach_profiles, verify_profiles

TODAY_RENEWALS = "2001-08-15"
TODAY_TRAVEL = "1998-01-01"

# (description, base amount, side) by order key modulo 12
TX_KINDS = [
    ("NETFLIX.COM LOS GATOS", 1500, "debit"),
    ("SPOTIFY AB STOCKHOLM", 900, "debit"),
    ("ADOBE CREATIVE CLOUD", 3200, "debit"),
    ("POS PURCHASE JUICI PATTIES", 650, "debit"),
    ("POS PURCHASE MEGAMART", 5200, "debit"),
    ("BILL PAYMENT JPS", 8800, "debit"),
    ("ABM WITHDRAWAL BRANCH 4", 5000, "debit"),
    ("FUNDS TRANSFER FROM EMPLOYER", 150000, "salary"),
    ("LOAN PAYMENT 8841", 21000, "debit"),
    ("INSURANCE PREMIUM", 4300, "debit"),
    ("LANDLORD JONES", 60000, "debit"),
    ("FUNDS TRANSFER FROM FRIEND", 4000, "friend"),
]

# app, cost, cycle, category, value mode, engagement, multi-device, free tier, shared, student price, verified, tiers
CATALOG = [
    ("StreamFlix", 15.99, "monthly", "entertainment", "time_based", "passive", True, False, False, 0.0, True, 15.99, 0.0, 0.0),
    ("TuneBox Duo", 12.99, "monthly", "entertainment", "time_based", "passive", False, True, False, 5.99, True, 12.99, 129.99, 0.0),
    ("CloudVault", 29.99, "yearly", "utility", "presence_based", "passive", True, False, False, 0.0, True, 2.99, 29.99, 0.0),
    ("PixelForge", 54.99, "monthly", "productivity", "outcome_based", "generative", False, False, False, 19.99, True, 54.99, 599.88, 0.0),
    ("NoteNest", 4.99, "monthly", "productivity", "time_based", "generative", False, True, False, 0.0, True, 4.99, 39.99, 79.99),
    ("GuardVPN Family", 11.99, "monthly", "utility", "presence_based", "passive", False, False, True, 0.0, False, 0.0, 0.0, 0.0),
    ("QuestArena", 9.99, "monthly", "gaming", "time_based", "active", False, False, False, 0.0, True, 9.99, 59.99, 0.0),
    ("LinguaLeap", 2.49, "weekly", "productivity", "time_based", "active", False, True, False, 11.0, True, 9.99, 119.99, 149.99),
    ("FitPulse", 30.0, "quarterly", "utility", "time_based", "active", False, False, False, 0.0, False, 10.0, 96.0, 0.0),
    ("MovieNight Family", 17.99, "monthly", "entertainment", "time_based", "passive", True, False, True, 0.0, True, 17.99, 0.0, 0.0),
    ("PhotoLab", 199.0, "lifetime", "productivity", "outcome_based", "generative", False, False, False, 0.0, True, 9.99, 99.99, 199.0),
    ("ArcadePlus", 49.99, "yearly", "gaming", "time_based", "active", False, True, False, 0.0, True, 4.99, 49.99, 0.0),
]
CATALOG_SCHEMA = (
    "app_name string, cost double, frequency string, category string, value_mode string, engagement_type string, "
    "is_multi_device boolean, has_free_tier boolean, is_shared_plan boolean, student_plan_price double, "
    "pricing_verified boolean, monthly_price double, yearly_price double, lifetime_price double"
)
UNKNOWN_APP, UNKNOWN_APP_COST = "Mystery App", 7.5
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# (summary, location, location every third time, description, trigger) by order key modulo 10
EVENT_KINDS = [
    ("Flight to Miami", "JFK Airport", "", "Summer trip to visit family", "travel"),
    ("Vacation in Bahamas", "Nassau, Bahamas", "", "Family beach vacation all inclusive", "vacation"),
    ("Conference talk", "Boston", "Zoom", "Presenting research at Boston Campus", "work"),
    ("Study abroad semester", "Toronto, Canada", "Online", "Fall semester", "study"),
    ("Team standup", "Zoom", "Zoom", "Daily sync with the engineering team", ""),
    ("Dentist appointment", "", "", "Annual checkup", ""),
    ("Final exam CS101", "Hall B", "", "Bring student card", ""),
    ("Gym workout", "", "", "Leg day", ""),
    ("Assignment due", "", "Online", "Upload before midnight", ""),
    ("Grocery shopping", "", "", "Weekly groceries", ""),
]

# (name, location type) by customer key modulo 6
LOCAL_KINDS = [
    ("City Gym", "physical"),
    ("Plaza Parking", "physical"),
    ("Island Data Plan", "regional_service"),
    ("Home Cable", "regional_service"),
    ("Movie Streaming", "portable"),
    ("Hub Cowork", "physical"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: str, values: list) -> Column:
    """The value at a zero-based position of a fixed list."""
    return F.expr(pick_sql(index, values))


def pick_sql(index: str, values: list) -> str:
    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return f"{value!r}D" if isinstance(value, float) else f"'{value}'"

    return f"get(array({', '.join(literal(v) for v in values)}), cast({index} as int))"


def transactions(spark: SparkSession, sf_dir: str, free_first: bool = False) -> DataFrame:
    """One transaction per order; about a hundred per account."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey div 10 AS account_id",
        "o_orderkey AS seq",
        "cast(o_orderdate as date) AS date",
        f"{pick_sql('o_orderkey % 12', [text for text, _, _ in TX_KINDS])} AS description",
        "o_orderkey % 12 AS kind",
        f"{pick_sql('o_orderkey % 12', [float(amount) for _, amount, _ in TX_KINDS])} AS base",
    )
    debit = "base + (year(date) - 1995) * 25 + if(seq % 17 = 0, base, 0D)"
    if free_first:
        debit = f"if(seq % 31 = 0, 0D, {debit})"
    return rows.selectExpr(
        "account_id",
        "seq",
        "date",
        "description",
        f"if(kind IN (7, 11), 0D, {debit}) AS debit",
        """CASE kind WHEN 7 THEN base + 1000 * (seq % 3) + if(seq % 29 = 0, 20000D, 0D)
                     WHEN 11 THEN base + 100 * (seq % 5) ELSE 0D END AS credit""",
        "0D AS balance",
    )


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions rendered as statement text, twenty per page, three months per statement from November on."""
    tx = transactions(spark, sf_dir).withColumn("date", F.add_months("date", 240))
    month_index = F.year("date") * 12 + F.month("date") - 11
    numbered = tx.withColumn("period", F.floor(month_index / 3))
    order = Window.partitionBy("account_id", "period").orderBy("date", "seq")
    seq = F.col("seq")
    stamp = F.upper(F.date_format("date", "ddMMM"))
    amount = F.format_number(F.greatest("debit", "credit"), 2)
    sign = F.when(F.col("credit") > 0, "+").otherwise("-")
    balance = F.when(seq % 3 == 0, F.lit("")).when(seq % 7 == 0, F.concat(F.lit(" J$ "), amount)).otherwise(
        F.concat(F.lit(" J$ "), F.format_number(1000 + seq % 5000, 2))
    )
    main = F.concat(stamp, F.lit(" "), F.col("description"), F.lit(" J$ "), amount, F.lit(" "), sign, balance)
    lines = F.array_compact(
        F.array(
            main,
            F.when(seq % 5 == 0, F.concat(F.lit("  REF "), seq.cast("string"))),
            F.when(seq % 23 == 0, F.lit("GCT/GOVT TAX REF")),
            F.when(seq % 13 == 0, F.concat(stamp, F.lit(" SERVICE CHARGE J$ 50.00 -"))),
            F.when(seq % 19 == 0, F.lit("31FEB GHOST ENTRY J$ 1.00 -")),
            F.when(seq % 11 == 0, F.lit("*** reconciled")),
        )
    )
    paged = numbered.withColumn("page_no", F.floor((F.row_number().over(order) - 1) / 20).cast("int") + 1).withColumn(
        "lines", lines
    )
    start = F.make_date(
        F.floor((F.col("period") * 3 + 10) / 12).cast("int"), ((F.col("period") * 3 + 10) % 12 + 1).cast("int"), F.lit(1)
    )
    head = F.when(
        F.col("page_no") == 1,
        F.concat(
            F.lit("Statement Period: "), F.upper(F.date_format(start, "ddMMMyy")), F.lit(" to "),
            F.upper(F.date_format(F.last_day(F.add_months(start, 2)), "ddMMMyy")),
        ),
    ).otherwise(F.lit("Account statement"))
    return (
        paged.groupBy("account_id", "period", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("date", "seq", "lines"))).alias("rows"))
        .select(
            "account_id",
            F.col("period").cast("string").alias("statement_id"),
            "page_no",
            F.concat_ws(
                "\n", head, F.array_join(F.flatten(F.col("rows.lines")), "\n"),
                F.concat(F.lit("Page "), F.col("page_no").cast("string")),
            ).alias("text"),
        )
    )


CSV_LAYOUTS = [
    {"date": "Date", "description": "Description", "debit": "Debit", "credit": "Credit", "balance": "Balance"},
    {"date": " Transaction Date", "description": "Details", "debit": "Withdrawal", "credit": "Deposit",
     "balance": "Running Balance"},
    {"date": "POST DATE", "description": "Narrative", "debit": "DR", "credit": "CR", "balance": "Balance"},
    {"date": "Value Date", "description": "Particulars", "amount": "Amount", "balance": "Balance"},
]
DATE_PATTERNS = [
    "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d-M-yyyy", "d MMM yyyy", "dd MMMM yyyy", "MMM d, yyyy",
    "MMMM dd, yyyy", "dd/MM/yy", "M/d/yy", "yyyy/MM/dd",
]


def date_text(date: Column, choice: Column) -> Column:
    """A date in one of the eleven formats; other choices give an empty text."""
    chain = None
    for i, pattern in enumerate(DATE_PATTERNS):
        text = F.date_format(date, pattern)
        chain = F.when(choice == i, text) if chain is None else chain.when(choice == i, text)
    return chain.otherwise(F.lit(""))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as text cells, before they are laid out under a bank's headers."""
    seq = F.col("seq")

    def amount_text(value: Column) -> Column:
        two = F.format_string("%.2f", value)
        return (
            F.when(value == 0, F.lit(""))
            .when(seq % 37 == 0, F.lit("n/a"))
            .when(seq % 3 == 0, two)
            .when(seq % 3 == 1, F.concat(F.lit("$"), F.format_number(value, 2)))
            .otherwise(F.concat(F.lit("J$ "), two))
        )

    signed = F.when(
        F.col("debit") > 0, F.concat(F.lit("-"), F.format_string("%.2f", F.col("debit")))
    ).otherwise(F.format_number(F.col("credit"), 2))
    return transactions(spark, sf_dir).select(
        "account_id",
        "seq",
        date_text(F.col("date"), seq % 12).alias("date"),
        F.col("description").alias("description"),
        amount_text(F.col("debit")).alias("debit"),
        amount_text(F.col("credit")).alias("credit"),
        signed.alias("amount"),
        F.format_string("%.1f", 100 + seq % 900.0).alias("balance"),
    )


def csv_layouts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The text rows of each header layout, one bank per account."""
    rows = csv_rows(spark, sf_dir)
    return [
        rows.filter(F.col("account_id") % 4 == i).select(
            "account_id", "seq", *[F.col(source).alias(header) for source, header in layout.items()]
        )
        for i, layout in enumerate(CSV_LAYOUTS)
    ]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def usage_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours per (user, app, week of the month) from the event stream; days 29 to 31 belong to the last week."""
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    apps = pick_sql("(user_id * 5 + type_index) % 12", [row[0] for row in CATALOG])
    typed = table(spark, sf_dir, "events").selectExpr(
        "user_id", "ts", "event_type", "value", f"array_position(array({types}), event_type) - 1 AS type_index"
    )
    return typed.selectExpr(
        "user_id",
        f"if(user_id % 17 = 0, concat('{UNKNOWN_APP} ', type_index), {apps}) AS app_name",
        "cast(least(floor((dayofmonth(ts) - 1) / 7), 3) as int) AS week",
        """cast(if(user_id % 13 = 0 AND event_type = 'error', 0, cast(value as decimal(18,2))) as decimal(18,2))
           AS hours""",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, app): four weekly hours, cost, months, wage and style."""
    prices = F.create_map(*[x for row in CATALOG for x in (F.lit(row[0]), F.lit(row[1]))])
    user = F.col("user_id")
    return weekly_hours(usage_long(spark, sf_dir), ["user_id", "app_name"]).select(
        "user_id",
        "app_name",
        F.coalesce(F.try_element_at(prices, F.col("app_name")), F.lit(UNKNOWN_APP_COST)).alias("cost"),
        (1 + user % 30).cast("int").alias("months_subscribed"),
        F.transform("weekly_hours", lambda h: h / 30).alias("weekly_hours"),
        (10 + user % 20).cast("double").alias("wage"),
        pick("user_id % 3", [0.07, 0.10, 0.15]).alias("style"),
    )


def profiled_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage joined with the checked catalog."""
    return verify_profiles(attach_profiles(usage(spark, sf_dir), catalog(spark)))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("user_id") % 4 == 0).select("user_id").distinct()


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (user, app) a model reply about the app: plain, fenced, broken, with a nested price, or none at all."""
    user = F.col("user_id")
    monthly = F.when(
        user % 5 == 4, F.concat(F.lit('{"currency": "USD", "price": '), F.col("monthly_price").cast("string"), F.lit("}"))
    ).otherwise(F.col("monthly_price").cast("string"))
    flags = ["is_multi_device", "has_free_tier", "is_shared_plan", "pricing_verified"]
    texts = ["frequency", "category", "value_mode", "engagement_type"]
    body = F.concat(
        F.lit("{"),
        *[F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('", ')) for c in texts],
        *[F.concat(F.lit(f'"{c}": '), F.col(c).cast("string"), F.lit(", ")) for c in flags],
        F.lit('"student_plan_price": '), F.col("student_plan_price").cast("string"),
        F.lit(', "pricing_tiers": {"monthly": '), monthly,
        F.lit(', "yearly": "'), F.col("yearly_price").cast("string"),
        F.lit('", "lifetime": '), F.col("lifetime_price").cast("string"), F.lit("}}"),
    )
    fence = "```"
    reply = (
        F.when(user % 5 == 1, F.concat(F.lit(fence + "json\n"), body, F.lit("\n" + fence)))
        .when(user % 5 == 2, F.concat(F.lit(fence + "\n"), body, F.lit("\n" + fence)))
        .when(user % 5 == 3, F.concat(F.lit("Sorry, "), F.substring(body, 1, 40)))
        .otherwise(body)
    )
    return usage(spark, sf_dir).select("user_id", "app_name").join(
        F.broadcast(catalog(spark)), "app_name", "left"
    ).select("user_id", "app_name", "cost", reply.alias("reply"))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One calendar event per order, lasting up to 24 days."""
    seq = F.col("o_orderkey")
    kind, third = seq % 10, seq % 3 == 0
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (seq % 25).cast("int"))
    moment = F.when(seq % 4 == 0, F.lit("T09:00:00-05:00")).otherwise(F.lit(""))
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey div 10").alias("user_id"),
        seq.alias("event_id"),
        kind.alias("kind"),
        pick("o_orderkey % 10", [row[0] for row in EVENT_KINDS]).alias("summary"),
        F.when(third, pick("o_orderkey % 10", [row[2] for row in EVENT_KINDS]))
        .otherwise(pick("o_orderkey % 10", [row[1] for row in EVENT_KINDS]))
        .alias("location"),
        pick("o_orderkey % 10", [row[3] for row in EVENT_KINDS]).alias("description"),
        F.concat(F.date_format(start, "yyyy-MM-dd"), moment).alias("start"),
        F.concat(F.date_format(end, "yyyy-MM-dd"), moment).alias("end"),
        start.alias("start_date"),
        end.alias("end_date"),
        (kind < 4).cast("int").alias("is_travel"),
        pick("o_orderkey % 10", [row[4] for row in EVENT_KINDS]).alias("trigger_type"),
        pick("o_orderkey % 3", ["high", "medium", "low"]).alias("confidence"),
    )


def calendar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested JSON text; some lack a summary, a time or a location."""
    seq = F.col("event_id")

    def moment(name: str) -> Column:
        timed = F.contains(name, F.lit("T"))
        return F.struct(
            F.when(timed, F.col(name)).alias("dateTime"),
            F.when(~timed & (seq % 41 != 0), F.col(name)).alias("date"),
        )

    item = F.struct(
        "user_id", "event_id",
        F.when(seq % 9 != 0, F.col("summary")).alias("summary"),
        F.when(F.col("location") != "", F.col("location")).alias("location"),
        "description", moment("start").alias("start"), moment("end").alias("end"),
    )
    return calendar_events(spark, sf_dir).select(F.to_json(item).alias("json"))


def away_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel events in the shape of away periods, before merging."""
    travel = calendar_events(spark, sf_dir).filter("is_travel = 1")
    text = combine_text(F.col("summary"), F.col("location"), F.col("description"))
    return travel_to_away(travel.withColumn("text", text), TODAY_TRAVEL)


SERVICES = 840  # names of local services; a multiple of every number that options are derived with


def local_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classified subscription per customer; names repeat across users, so that many share a service."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.expr("c_custkey div 10").alias("user_id"),
        F.concat(pick("c_custkey % 6", [name for name, _ in LOCAL_KINDS]), F.lit(" "), (key % SERVICES).cast("string")).alias("name"),
        pick("c_custkey % 6", [name for name, _ in LOCAL_KINDS]).alias("kind"),
        pick("c_custkey % 6", [where for _, where in LOCAL_KINDS]).alias("location_type"),
        (20 + key % 80).cast("double").alias("monthly_cost"),
        (key % 6 != 4).alias("is_local"),
        (key % 3 == 0).alias("can_pause"),
        (key % 2 == 0).alias("can_cancel_and_rejoin"),
        (10.0 * (key % 4)).alias("cancellation_penalty"),
    )


OPTION = "array<struct<name:string,type:string,estimated_cost:string,estimated_monthly_cost:double,url:string,notes:string>>"


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers per (subscription, destination): 0 to 3 options, some without a price; derived from customers."""
    places = F.explode(F.array(*[F.lit(p) for p in ("JFK Airport", "Nassau, Bahamas", "Boston", "Miami")]))
    services = table(spark, sf_dir, "customer").select((F.col("c_custkey") % SERVICES).alias("key")).distinct()
    base = services.select(
        "key",
        F.concat(pick("key % 6", [n for n, _ in LOCAL_KINDS]), F.lit(" "), F.col("key").cast("string")).alias(
            "subscription"
        ),
        places.alias("destination"),
    )

    def option(i: int) -> Column:
        price = F.when((F.col("key") + i) % 5 == 0, F.lit(None)).when((F.col("key") + i) % 7 == 0, 0.0).otherwise(
            (5 + (F.col("key") * (i + 1) + F.length("destination")) % 40).cast("double")
        )
        return F.struct(
            F.concat(F.lit(f"Option {i} "), "destination").alias("name"),
            F.lit("day pass").alias("type"),
            F.format_string("$%.0f/month", F.coalesce(price, F.lit(0.0))).alias("estimated_cost"),
            price.alias("estimated_monthly_cost"),
            F.lit("https://example.com").alias("url"),
            F.lit("").alias("notes"),
        )

    every = F.array(option(0), option(1), option(2)).cast(OPTION)
    return base.filter(F.col("key") % 4 != 3).select(
        "subscription",
        "destination",
        F.slice(every, F.lit(1), (F.col("key") % 4).cast("int") + F.lit(1)).alias("options"),
        F.concat(F.lit("Option 0 "), "destination").alias("best_value_option"),
        F.lit("Book ahead.").alias("tip"),
    )


def labeled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the column names of a labelled training file."""
    return calendar_events(spark, sf_dir).select(
        "event_id",
        F.col("summary").alias("event_summary"),
        F.col("location").alias("event_location"),
        F.col("description").alias("event_description"),
        F.col("is_travel").cast("string").alias("is_travel"),
        F.concat(F.lit(" "), "trigger_type", F.lit(" ")).alias("trigger_type"),
    )
