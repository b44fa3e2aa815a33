"""Price changes of subscriptions: pairwise jumps and sustained drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcadence.functions import text as T
from spendcadence.operators import ordered as O

TOLERANCE = 0.05
SLACK = 0.5
THRESHOLD = 1.5
DRIFT_BLOCK = 4096  # charges of a series folded apart

# Finding types and texts.
TRIAL = "Trial Conversion"
UPGRADE, INCREASE = "Plan Upgrade", "Price Increase"
DOWNGRADE, DECREASE = "Plan Downgrade", "Price Decrease"
DRIFT_UP, DRIFT_DOWN = "Sustained Price Drift (Up)", "Sustained Price Drift (Down)"
TRIAL_TEXT = "Free trial ended. Now billing $%s/cycle."
UPGRADE_TEXT = "Significant price jump: $%s → $%s (+%.0f%%). Likely a plan change."
INCREASE_TEXT = "Price increased from $%s to $%s (+%.1f%%)."
DOWNGRADE_TEXT = "Significant price drop: $%s → $%s (%.0f%%). Likely a plan change."
DECREASE_TEXT = "Price decreased from $%s to $%s (%.1f%%)."
DRIFT_UP_TEXT = "CUSUM detected sustained upward drift. Baseline: $%s, Current: $%s."
DRIFT_DOWN_TEXT = "CUSUM detected sustained downward drift. Baseline: $%s, Current: $%s."

FINDING = [
    "type", "date", "old_amount", "new_amount", "change_amount", "change_percent", "severity", "description",
]


def subscription_charges(classified: DataFrame, key: str = "account_id", include_zero: bool = False) -> DataFrame:
    """Charges of subscription vendors; free charges only on request."""
    counted = F.col("debit") > 0
    if include_zero:
        counted = counted | ((F.col("debit") == 0) & (F.col("credit") <= 0))
    return classified.filter(F.col("is_subscription") & counted).select(
        key, T.vendor_key(F.col("vendor_name")).alias("vendor"), "date", "seq", "debit"
    )


def price_pairs(
    charges: DataFrame, key: str = "account_id", hot_rows: int = O.HOT_ROWS, block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """Every charge with the previous charge of the same vendor."""
    return O.with_previous(
        charges, [key, "vendor"], "date", "seq", "debit", "previous", hot_rows=hot_rows, block_rows=block_rows
    )


def _relative_change() -> Column:
    return (F.col("debit") - F.col("previous")) / F.col("previous")


def pairwise_price_change(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Charges that differ from the previous one by more than the tolerance."""
    jump = F.when(
        (F.col("previous") > 0) & (F.col("debit") > 0),
        F.abs(F.col("debit") - F.col("previous")) / F.col("previous") > tolerance,
    )
    return pairs.filter(jump).withColumns(
        {"change_amount": F.col("debit") - F.col("previous"), "change_percent": _relative_change() * 100}
    )


def label_price_change(jumps: DataFrame) -> DataFrame:
    """Type, severity and text of a jump."""
    percent = F.col("change_percent")
    up, big = percent > 0, F.abs(percent) > 50
    old, new = T.money(F.col("previous")), T.money(F.col("debit"))
    whole, tenth = F.bround(percent, 0), F.bround(percent, 1)
    return jumps.withColumns(
        {
            "type": F.when(up & big, UPGRADE).when(up, INCREASE).when(big, DOWNGRADE).otherwise(DECREASE),
            "severity": F.when(percent > 20, "warning").otherwise("info"),
            "description": F.when(up & big, F.format_string(UPGRADE_TEXT, old, new, whole))
            .when(up, F.format_string(INCREASE_TEXT, old, new, tenth))
            .when(big, F.format_string(DOWNGRADE_TEXT, old, new, whole))
            .otherwise(F.format_string(DECREASE_TEXT, old, new, tenth)),
        }
    ).withColumnsRenamed({"previous": "old_amount", "debit": "new_amount"})


def trial_conversion(pairs: DataFrame) -> DataFrame:
    """A free charge followed by a paid one (needs free charges in the input)."""
    first_paid = (F.col("previous") == 0) & (F.col("debit") > 0)
    return pairs.filter(first_paid).withColumns(
        {
            "type": F.lit(TRIAL),
            "change_amount": F.col("debit") - F.col("previous"),
            "change_percent": F.lit(100.0),
            "severity": F.lit("info"),
            "description": F.format_string(TRIAL_TEXT, T.money(F.col("debit"))),
        }
    ).withColumnsRenamed({"previous": "old_amount", "debit": "new_amount"})


# --- drift -------------------------------------------------------------------

def _moments(df: DataFrame) -> DataFrame:
    """Mean and population deviation from exact integer cent sums."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    spread = (n.cast("decimal(18,0)") * q - s * s).cast("double")
    return df.withColumns(
        {
            "mean": s.cast("double") / n / 100.0,
            "std": F.sqrt(F.greatest(spread, F.lit(0.0))) / n / 100.0,
        }
    ).drop("n", "s", "q")


def _step(state: np.ndarray, difference: np.ndarray, slack: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, state + difference - slack)


class _Series:
    """Charges of a table, by series or block: how far each is from the mean, and what a side loses and may reach."""

    def __init__(self, rows: pa.Table, starts: np.ndarray, threshold: float, slack: float):
        self.first = starts
        self.sizes = np.diff(np.r_[starts, rows.num_rows])
        std = rows["std"].to_numpy()
        self.difference = rows["debit"].to_numpy() - rows["mean"].to_numpy()
        self.slack, self.limit = slack * std, threshold * std


def _block_ends(keys: list[str], threshold: float, slack: float):
    """(keys, known, up, down): the sums behind each block, where they don't depend on those before it.

    A sum lies from 0 to its limit when a block begins.  What it can be is followed as a range, of which some or all is
    set to 0 by an alarm; once both ends meet (all were clipped to 0 or reset together), it is known from there on.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        held = None  # the keys of the block at hand
        for rows, starts, goes_on in O.grouped(batches, keys):
            s = _Series(rows, starts, threshold, slack)
            count = len(starts)
            new_low, new_high = np.zeros((2, count)), np.tile(s.limit[starts], (2, 1))
            if goes_on:
                new_low[:, 0], new_high[:, 0] = low[:, -1], high[:, -1]
            elif held is not None:
                yield _ends(held, low[:, -1:], high[:, -1:])
            low, high = new_low, new_high
            for t, at in O.side_by_side(s.sizes):
                row = s.first[at] + t
                for side, sign in ((0, 1.0), (1, -1.0)):
                    a = _step(low[side, at], sign * s.difference[row], s.slack[row])
                    b = _step(high[side, at], sign * s.difference[row], s.slack[row])
                    limit = s.limit[row]
                    low[side, at] = np.where(b > limit, 0.0, a)
                    high[side, at] = np.where(a > limit, 0.0, np.minimum(b, limit))
            named = rows.select(keys).take(pa.array(starts))
            if count > 1:
                yield _ends(named.slice(0, count - 1), low[:, :-1], high[:, :-1])
            held = named.slice(count - 1)
        if held is not None:
            yield _ends(held, low[:, -1:], high[:, -1:])

    def _ends(named: pa.Table, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        columns = [named[k].combine_chunks() for k in keys]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array((low == high).all(axis=0)), pa.array(low[0]), pa.array(low[1])], [*keys, "known", "up", "down"]
        )

    return work


def _alarms(keys: list[str], threshold: float, slack: float):
    """Rows of the charges that raise an alarm, with the sides that do; a series starts with its sums _up and _down."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for rows, starts, goes_on in O.grouped(batches, keys):
            s = _Series(rows, starts, threshold, slack)
            before = state
            state = np.stack([rows[c].to_numpy()[starts] for c in ("_up", "_down")])
            if goes_on:
                state[:, 0] = before[:, -1]
            raised = np.zeros((2, rows.num_rows), bool)
            for t, at in O.side_by_side(s.sizes):
                row = s.first[at] + t
                for side, sign in ((0, 1.0), (1, -1.0)):
                    moved = _step(state[side, at], sign * s.difference[row], s.slack[row])
                    over = moved > s.limit[row]
                    raised[side, row] = over
                    state[side, at] = np.where(over, 0.0, moved)
            at = np.flatnonzero(raised.any(axis=0))
            found = rows.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(found[c].combine_chunks() for c in (*keys[:2], "date", "seq", "mean", "debit")), *map(pa.array, raised[:, at])],
                [*keys[:2], "date", "seq", "old_amount", "new_amount", "up", "down"],
            )

    return work


def cusum_drift(
    charges: DataFrame,
    key: str = "account_id",
    threshold: float = THRESHOLD,
    slack: float = SLACK,
    block_rows: int = DRIFT_BLOCK,
) -> DataFrame:
    """Drift alarms per (key, vendor): ``date, seq, old_amount`` (mean), ``new_amount, is_up``.

    A side of the two-sided sum restarts at 0 after its alarm, so the sum is a fold over the ordered series.  A series of
    more than ``block_rows`` charges is cut by date (and by seq within a dense day) into blocks of about so many, which
    are folded apart:

    1. For each block the sums behind it, where they are the same whatever they were before; that is so once every
       possible sum has been clipped to 0 or reset together.
    2. Over one small row a block, each block gets the block its fold starts with, the last one whose start is known.
    3. Blocks are folded from there, those with an unknown start behind the block before.

    The steps are those of the sequential fold, so the alarms are the same to the last bit.
    """
    keys = [key, "vendor"]
    cents = F.round(F.col("debit") * 100).cast("decimal(18,0)")
    moments = charges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents).alias("s"),
        F.sum(cents * cents).alias("q"),
        F.min("date").alias("_from"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("_days"),
        F.min("seq").alias("_low"),
        (F.max("seq") - F.min("seq") + 1).alias("_range"),
        F.count(F.lit(1)).alias("_n"),
    )
    usable = _moments(moments.filter(F.col("n") >= 3)).filter(F.col("std") > 0)
    per_day = F.col("_n") / F.col("_days")
    span = F.greatest(F.lit(1), F.floor(block_rows / per_day))
    day = F.floor(F.datediff("date", "_from") / span)
    part = F.floor((F.col("seq") - F.col("_low")) * F.ceil(per_day / block_rows) / F.col("_range"))
    long = F.col("_n") > block_rows
    series = charges.join(usable, keys).select(
        *keys,
        F.when(long, day).otherwise(0).alias("_day"),
        F.when(long & (per_day > block_rows), part).otherwise(0).alias("_part"),
        "date", "seq", "debit", "mean", "std", long.alias("_long"),
    )
    block = [*keys, "_day", "_part"]
    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in block)
    ends = (
        series.filter("_long")
        .select(*block, "date", "seq", "debit", "mean", "std")
        .repartition(*block)
        .sortWithinPartitions(*block, "date", "seq")
        .mapInArrow(_block_ends(block, threshold, slack), f"{kinds}, known boolean, up double, down double")
    )
    along = Window.partitionBy(*keys).orderBy("_day", "_part")
    before = {c: F.lag(c).over(along) for c in ("known", "up", "down")}
    start = F.struct(
        F.col("_day").alias("day"), F.col("_part").alias("part"),
        F.coalesce(before["up"], F.lit(0.0)).alias("up"), F.coalesce(before["down"], F.lit(0.0)).alias("down"),
    )
    chained = ends.withColumn("_start", F.when(F.coalesce(before["known"], F.lit(True)), start)).select(
        *block, F.last("_start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_start")
    )
    placed = series.join(chained, block, "left").select(
        *keys,
        F.coalesce("_start.day", F.lit(0)).alias("_first_day"),
        F.coalesce("_start.part", F.lit(0)).alias("_first_part"),
        "date", "seq", "debit", "mean", "std",
        F.coalesce("_start.up", F.lit(0.0)).alias("_up"),
        F.coalesce("_start.down", F.lit(0.0)).alias("_down"),
    )
    together = [*keys, "_first_day", "_first_part"]
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in (*keys, "date", "seq"))
    alarms = (
        placed.repartition(*together)
        .sortWithinPartitions(*together, "date", "seq")
        .mapInArrow(
            _alarms(together, threshold, slack), f"{kinds}, old_amount double, new_amount double, up boolean, down boolean"
        )
    )
    sides = F.array_compact(F.array(F.when(F.col("up"), F.lit(True)), F.when(F.col("down"), F.lit(False))))
    return alarms.select(*keys, "date", "seq", "old_amount", "new_amount", F.explode(sides).alias("is_up"))


def label_drift(alarms: DataFrame) -> DataFrame:
    """Alarms in the shape of the pairwise findings."""
    old, new = F.col("old_amount"), F.col("new_amount")
    up = F.col("is_up")
    return alarms.withColumns(
        {
            "type": F.when(up, DRIFT_UP).otherwise(DRIFT_DOWN),
            "change_amount": new - old,
            "change_percent": F.when(old > 0, (new - old) / old * 100).otherwise(F.lit(0.0)),
            "severity": F.when(up, "warning").otherwise("info"),
            "description": F.when(up, F.format_string(DRIFT_UP_TEXT, T.money(old), T.money(new))).otherwise(
                F.format_string(DRIFT_DOWN_TEXT, T.money(old), T.money(new))
            ),
        }
    )


def detect_price_changes(
    classified: DataFrame,
    key: str = "account_id",
    include_zero: bool = False,
    hot_rows: int = O.HOT_ROWS,
    block_rows: int = O.BLOCK_ROWS,
) -> DataFrame:
    """Pairwise findings, plus drift alarms on dates without one for that subscription."""
    charges = subscription_charges(classified, key)
    pairs = price_pairs(subscription_charges(classified, key, include_zero), key, hot_rows, block_rows)
    keep = [key, "vendor", *FINDING]
    jumps = label_price_change(pairwise_price_change(pairs)).select(*keep)
    if include_zero:
        jumps = jumps.unionByName(trial_conversion(pairs).select(*keep))
    drift = label_drift(cusum_drift(charges, key)).select(*keep)
    fresh = drift.join(jumps.select(key, "vendor", "date").distinct(), [key, "vendor", "date"], "left_anti")
    return (
        jumps.unionByName(fresh)
        .withColumn("subscription", T.title_case(F.col("vendor")))
        .select(key, "subscription", *FINDING)
    )
