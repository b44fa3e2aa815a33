import math
import random

import pytest
from pyspark.sql import functions as F

from spendcadence.llm import topk


def brute(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = [math.floor(256 * x) for x in v]
        whole[i] = min(e, whole.get(i, e))
    out = []
    for q, a in whole.items():
        if q % every:
            continue
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i)
            for i, b in whole.items()
            if i != q and len(a) == len(b)
        )
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, every=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, _id string, rank int")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k).collect())


def vectors(rng, count, dims, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    # float32 values that Python holds exactly
    return [
        (i, [round((c + rng.gauss(0, spread)) * 1024) / 1024 for c in rng.choice(centres)]) for i in range(count)
    ]


@pytest.mark.parametrize("dims", [1, 16, 50])
def test_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    rows = vectors(random.Random(dims), 150, dims, 0.3)
    rows += [(1000 + i, rows[0][1]) for i in range(12)]  # ties
    assert found(spark, rows) == brute(rows, 5, 3)


def test_repeated_ids_are_one_vector(spark):
    rows = vectors(random.Random(7), 40, 8)
    again = [rows[k] for k in (0, 0, 1, 1, 1, 3, 5)]  # queries and candidates, as they are
    other = [(k, [x + 1 for x in rows[k][1]]) for k in (0, 2, 3, 4)] + [(6, None), (6, rows[6][1][:4]), (9, rows[9][1] + [0.5])]
    for more in (again, again + other):
        answers = found(spark, rows + more)
        assert answers == brute(rows + more, 5, 3)
        assert len({(q, i) for q, _, i, _ in answers}) == len(answers)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (3, None), (6, [nan, 1.0]), (9, [None, 1.0]), (12, [inf, 0.0]), (1, [0.5]), (2, [-0.001, 3.0])]
    rows += [(15, []), (16, []), (None, [1.0, 1.0]), (18, [2.0**100, 1.0]), (4, [2.0**40, -(2.0**40)])]
    usable = [(i, v) for i, v in rows if i != 18]
    assert found(spark, usable) == brute(usable, 5, 3)
    assert found(spark, rows)  # beyond the range of a long it still answers


def test_few_candidates_and_empty_table(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert found(spark, []) == []
