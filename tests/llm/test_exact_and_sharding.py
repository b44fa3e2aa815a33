import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spendcadence.llm import exact_dedup, sharding


def test_groups_of_odd_rows(odd):
    rows = exact_dedup.annotate(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].keep_id == 3 and by_id[4].group_size == 3 and not by_id[4].kept
    assert by_id[3].kept and [r.kept for r in rows if r.doc_id == 3] == [True, True]
    assert by_id[7].keep_id == 6 and by_id[6].group_size == 3  # null, null id and empty
    assert by_id[5].group_size == 1  # one space is not empty


def test_filter_keeps_columns_of_any_name(odd):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [3, 3, 5, 6, 8, 9, 10]
    assert {r.keep_id for r in rows} == {1} and {r._id for r in rows} == {2.5}


def test_all_ids_null(frame):
    rows = exact_dedup.annotate(frame([(None, "a"), (None, "a")], extra=False)).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in rows] == [(None, 2, True)] * 2


def test_texts_of_one_hash_are_compared(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    rows = exact_dedup.annotate(frame([(1, "a"), (2, "b"), (3, "a")], extra=False)).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_empty_tables(empty):
    assert exact_dedup.annotate(empty).count() == 0
    assert sharding.shard(empty).count() == 0


def smallest_capacity(sizes, shards):
    """By dynamic programming over the ordered group sizes."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [
            min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)
        ]
    return best[-1]


@pytest.mark.parametrize("seed", range(3))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    # hashes that share long prefixes, so that several passes are needed
    groups = sorted(
        {rng.choice(["a" * 9, "a" * 12, "b" * 9]) + f"{rng.randrange(16**4):04x}" + "0" * 19: rng.choice([1, 2, 5, 90]) for _ in range(25)}.items()
    )
    rows = spark.createDataFrame(groups, "_hash string, size long")
    capacity, cuts = sharding.minimax_cuts(rows, 5)
    assert capacity == smallest_capacity([s for _, s in groups], 5)
    filled = Counter()
    for name, size in groups:
        filled[sum(name >= c for c in cuts)] += size
    assert max(filled.values()) <= capacity


def test_shards_hold_whole_groups_without_gaps(spark, frame):
    rng = random.Random(5)
    texts = [rng.choice(["hot", "", None]) if rng.random() < 0.4 else "t" * rng.randrange(60) for _ in range(500)]
    rows = sharding.shard(frame(list(enumerate(texts)))).collect()
    assert len(rows) == 500
    shard_of, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        shard_of[text].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(8))


def test_odd_rows_are_sharded(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (6, 7)} == {1}
