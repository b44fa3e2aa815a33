import random

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import ordered as O


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for key in range(6):
        n = 400 if key == 0 else rng.randint(1, 12)
        # few days, so a single day of the hot key is cut as well
        seqs = rng.sample(range(5000), n)
        rows += [(key, f"2024-01-{rng.randint(1, 4):02d}", s, float(rng.randint(1, 9))) for s in seqs]
    df = spark.createDataFrame(rows, "k int, day string, seq long, x double").withColumn("day", F.col("day").cast("date"))
    return rows, df


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_previous_equals_brute_force(series, hot_rows):
    rows, df = series
    expected, last = {}, {}
    for k, day, seq, x in sorted(rows):
        expected[(k, seq)] = last.get(k)
        last[k] = x
    out = O.with_previous(df, ["k"], "day", "seq", "x", "prev", hot_rows=hot_rows, block_rows=300)
    assert {(r["k"], r["seq"]): r["prev"] for r in out.collect()} == expected


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_rank_equals_brute_force(series, hot_rows):
    rows, df = series
    expected = {}
    for k in {r[0] for r in rows}:
        ordered = sorted((x, seq) for kk, _, seq, x in rows if kk == k)
        expected.update({(k, seq): i + 1 for i, (x, seq) in enumerate(ordered)})
    out = O.with_rank(df, ["k"], ["x", "seq"], F.floor("x"), F.floor(F.col("seq") / 100), "rank", hot_rows=hot_rows)
    assert {(r["k"], r["seq"]): r["rank"] for r in out.collect()} == expected


def test_hot_blocks_are_bounded(series):
    rows, df = series
    marked = O.mark_blocks(df, ["k"], F.col("day"), F.floor(F.col("seq") / 100), hot_rows=50)
    sizes = marked.groupBy("k", *O.BLOCK).count()
    assert sizes.filter("_block is not null").agg(F.max("count")).first()[0] <= 100
    assert sizes.filter("_block is null").agg(F.max("count")).first()[0] <= 50


@pytest.mark.parametrize("hot_rows", [40, 10_000])
def test_split_rank_equals_brute_force(spark, hot_rows):
    rng = random.Random(3)
    # One key where all but a few values agree up to the tail of the name, one ordinary key, one with a null value.
    rows = [(0, 9.0, f"Application {i:05d}") for i in rng.sample(range(90_000), 700)] + [(0, 1.5, "z"), (0, None, "n")]
    rows += [(1, float(i % 3), f"a{i}") for i in range(20)] + [(2, None, "x"), (2, 0.0, "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, cost double, app string").repartition(5)
    expected = {}
    for k in range(3):
        of_key = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        expected.update({(k, r[2]): i + 1 for i, r in enumerate(of_key)})
    out = O.with_split_rank(df, ["k"], ["cost", "app"], "rank", hot_rows=hot_rows)
    assert out.columns == ["k", "cost", "app", "rank"]
    assert {(r["k"], r["app"]): r["rank"] for r in out.collect()} == expected


def test_seams_bound_blocks_of_equal_cost(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("1 AS k", "9.0D AS cost", "format_string('Application %09d', id) AS app")
    seen = []
    inner = O.mark_blocks
    monkeypatch.setattr(O, "mark_blocks", lambda *a, **kw: seen.append(inner(*a, **kw)) or seen[-1])
    ranked = O.with_split_rank(df, ["k"], ["cost", "app"], "rank", hot_rows=10_000)
    wrong = ranked.filter("rank <> cast(substring(app, 13, 9) AS int) + 1")
    assert wrong.count() == 0 and ranked.count() == 200_000
    largest = seen[0].groupBy("k", *O.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest <= 50_000
