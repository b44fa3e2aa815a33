import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendcadence.llm import components, ngram_join, shingles, substring_dedup

WORDS = "alpha Beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups phi chi psi om".split()


def prose(rng, words):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows, percent=80):
    """id -> (set size, smallest id reachable), by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    leader = {i: i for i in sets}

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = top(i), top(j)
                leader[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed, count=160):
    """Chains of edits, copies, a common passage, short and odd texts."""
    rng = random.Random(seed)
    common = prose(rng, 60)
    rows = []
    while len(rows) < count:
        base = prose(rng, rng.choice([3, 5, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append(base)
            base = edited(rng, base, rng.choice([0, 1, 2]))
        if rng.random() < 0.4:
            rows[-1] = prose(rng, rng.choice([4, 30])) + " " + common + " " + prose(rng, 10)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingles_equal_python_sets():
    texts = ["", " ", "a", "A b\tC d", "a b c d e f", "É é À b  c\x0bd\x0ce f", "x " * 300, "w" * 3000, "\x1c a\x85b c d e f", *[t for _, t in corpus(3, 40)]]
    for block in (1 << 20, 64):
        shingles.BLOCK = block
        sets = list(shingles.shingle_sets(pa.array(texts).slice(2)))
        shingles.BLOCK = 1 << 20
        assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts[2:]]
    same = [np.array_equal(a, b) for a, b in [list(shingles.shingle_sets(pa.array(["A b C", "a  B\nc"])))]]
    assert same == [True]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(frame, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 8)
    rows = corpus(seed)
    found = ngram_join.components_of(frame(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_components_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = ngram_join.components_of(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_list_work_in_small_batches(monkeypatch):
    finder = ngram_join.pair_finder(80)
    monkeypatch.setattr(ngram_join, "ROWS_TOGETHER", 3)
    rng = random.Random(2)
    entries = []
    for token in range(12):
        for _ in range(rng.randrange(1, 7)):
            side = rng.choice([-1, 1]) if token % 2 else 0
            entries.append((token, 0, len(entries), rng.randrange(5, 9), rng.randrange(3), bytes(64), rng.randrange(3), side))
    entries.sort(key=lambda e: (e[0], e[1], e[3], e[4], e[2]))
    names = ["token", "part", "id", "n", "at", "sketch", "label", "side"]
    table = pa.table({n: [e[k] for e in entries] for k, n in enumerate(names)})
    assert table["id"].type == pa.int64()
    for size in (1, 2, 5, 100):
        out = pa.Table.from_batches(finder(iter(table.to_batches(max_chunksize=size))))
        rows = sorted(zip(out["a"].to_pylist(), out["b"].to_pylist()))
        expected = sorted(
            (x[2], y[2])
            for i, x in enumerate(entries)
            for y in entries[i + 1 :]
            if x[0] == y[0] and x[6] != y[6] and y[3] * 80 <= x[3] * 100
            and min(x[4], y[4]) + min(x[3] - x[4], y[3] - y[4]) >= -(-80 * (x[3] + y[3]) // 180)
            and (x[7] != y[7] or x[7] == 0)
        )
        assert rows == expected


def test_cells_of_many_entries_in_small_groups(monkeypatch):
    rng = random.Random(5)
    entries = sorted((rng.randrange(2), rng.choice([20, 22, 30]), rng.choice([0, 1, 5])) for _ in range(60))
    lists, sizes, at = np.array(entries).T
    labels, sides = np.arange(60), np.zeros(60, np.int64)
    sketches = np.zeros((60, 8), np.uint64)
    expected = sorted(
        (i, j)
        for i, (a, n, x) in enumerate(entries)
        for j, (b, m, y) in enumerate(entries)
        if i < j and a == b and 180 * (min(x, y) + min(n - x, m - y)) >= 80 * (n + m)
    )
    for together in (1, 7, 1000, 1 << 19):
        monkeypatch.setattr(ngram_join, "PAIRS_TOGETHER", together)
        i, j = ngram_join.near_pairs(lists, sizes, at, sketches, labels, sides, 80)
        assert sorted(zip(i.tolist(), j.tolist())) == expected


def test_long_lists_by_classes_of_size_and_position(spark, monkeypatch):
    """Every pair that size and position allow is looked at once, and no class meets one out of its reach."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
    rng = random.Random(7)
    entries = []
    for token in range(4):
        for _ in range(rng.choice([3, 40, 90])):
            n = rng.choice([10, 11, 14, 40, 44, 60, 200])
            entries.append((token, len(entries), n, rng.randrange(n // 5 + 1), len(entries)))
    table = spark.createDataFrame(entries, "token long, id long, n long, at int, label long")
    nodes = table.select("id").withColumn("sketch", F.lit(bytes(64)))
    dealt, lists = ngram_join.dealt_lists(table, nodes, 80)
    rows = dealt.orderBy("token", "part", "n", "at", "id").toArrow()
    out = pa.Table.from_batches(ngram_join.pair_finder(80)(iter(rows.to_batches())))
    found = Counter(tuple(sorted(p)) for p in zip(out["a"].to_pylist(), out["b"].to_pylist()))
    expected = Counter(
        (x[1], y[1])
        for i, x in enumerate(entries)
        for y in entries[i + 1 :]
        if x[0] == y[0] and 180 * (min(x[3], y[3]) + min(x[2] - x[3], y[2] - y[3])) >= 80 * (x[2] + y[2])
    )
    assert found == expected and len(expected) > 500
    parts = dealt.filter("part > 0 OR side <> 0").groupBy("token", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    assert all(p["low"] == 200 or p["high"] < 200 for p in parts.collect())
    ngram_join.removed(lists)


def test_odd_rows_have_components(odd, empty):
    found = {r.doc_id: r for r in ngram_join.components_of(odd).collect()}
    assert len(ngram_join.components_of(odd).collect()) == odd.count()
    assert found[6].component_id == 6 and found[6].n_shingles == 0 and found[7].component_id == 7
    assert found[4].component_id == 3 and found[None].component_id is None
    assert ngram_join.components_of(empty).count() == 0


def test_filter_keeps_one_of_each(odd):
    left = ngram_join.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [3, 3, 5, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("seed", range(3))
def test_stars_find_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    leader = {}
    for a, b in edges:
        group = {x for x, lead in leader.items() if lead in (leader.get(a, a), leader.get(b, b))} | {a, b}
        leader |= {x: min(min(group), *(leader.get(y, y) for y in group)) for x in group}
    found = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {a: b for a, b in leader.items() if a != b}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text, size=30):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_planted_passages_go(frame):
    rng = random.Random(8)
    passages = [prose(rng, 54) for _ in range(6)]
    rows, clean = [], []
    for i in range(120):
        text = prose(rng, 90).split()
        if i % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = passages[rng.randrange(6)].split()
        else:
            clean.append(i)
        rows.append((i, " ".join(text)))
    given = dict(rows)
    left = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert all(left[i].text == given[i] and left[i].n_removed == 0 for i in clean)
    held = Counter(g for r in left.values() for g in grams(r.text))
    assert max(held.values()) == 1
    first = {next(i for i in sorted(given) if p in given[i]) for p in passages if any(p in t for t in given.values())}
    assert all(left[i].text == given[i] for i in first)  # the first occurrence stays
    assert all(left[i].n_removed > 0 for i in given if i not in clean and i not in first)


def test_near_copies_of_lines_go(frame):
    rng = random.Random(9)
    line = prose(rng, 120)
    near, far = edited(rng, line, 2), edited(rng, line, 25)
    rows = [(1, prose(rng, 30) + "\n" + line), (2, near + "\n" + prose(rng, 30)), (3, prose(rng, 40)), (4, prose(rng, 25) + "\n" + far)]
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1]
    assert left[2] == rows[1][1].split("\n")[1]
    assert len(left[4].split()) > 40


def colliding_components(rows, percent=80):
    """id -> smallest id reachable over pairs of lines (a text each) that share a band and reach the threshold."""
    holders = defaultdict(list)
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        words, starts, _, row = shingles.word_hashes(data, np.array([0, len(data)]))
        for key in substring_dedup.line_bands(data, words, starts, row)[3]:
            holders[int(key[0])].append(i)
    sets, leader = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in sorted({(a, b) for held in holders.values() for a in held for b in held if a < b}):
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            low, high = sorted((leader[a], leader[b]))
            leader = {i: low if top == high else top for i, top in leader.items()}
    return leader


def test_variants_of_a_base_line_go(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
    rng = random.Random(12)
    texts = []
    for variants in (1, 3, 3, 5, 10, 10, 20):
        base = prose(rng, 100)
        texts += [base, *(edited(rng, base, 2) for _ in range(variants))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert {i for i, text in left.items() if text} == set(colliding_components(rows).values())


@pytest.mark.parametrize("low,high,least", [(80, 85, 0.96), (85, 100, 0.99)])
def test_recall_of_bands(low, high, least):
    """Of similar pairs of lines, those that share a band; 0.986 is expected at a similarity of 0.8, and more above."""
    rng = random.Random(low)
    met = []
    while len(met) < 600:
        line = prose(rng, 120)
        other = edited(rng, line, rng.randint(1, 4))
        a, b = shingle_set(line), shingle_set(other)
        if low * len(a | b) <= 100 * len(a & b) < high * len(a | b):
            keys = []
            for text in (line, other):
                data = np.frombuffer(text.encode(), np.uint8)
                words, starts, _, row = shingles.word_hashes(data, np.array([0, len(data)]))
                keys.append(substring_dedup.line_bands(data, words, starts, row)[3])
            met.append(bool((keys[0] == keys[1]).any()))
    assert np.mean(met) >= least


def without_repeats(rows, size=20):
    """Texts of one line without the words of passages that stand earlier already."""
    first, left = {}, {}
    for i, text in sorted(rows):
        words = text.split()
        gone = set()
        for at in range(len(words) - size + 1):
            place = first.setdefault(tuple(words[at : at + size]).__repr__().lower(), (i, at))
            if place[0] != i or at >= place[1] + size:
                gone.update(range(at, at + size))
        left[i] = [w for k, w in enumerate(words) if k not in gone]
    return left


def test_stock_phrases_of_different_documents_stay(frame):
    rng = random.Random(31)
    # A pair of words of very low hash before each phrase, so that any cutting by hashes of pairs cuts there.
    data = np.frombuffer(prose(rng, 4000).encode(), np.uint8)
    words, starts, stops, _ = shingles.word_hashes(data, np.array([0, len(data)]))
    rank = shingles.mixed(words * shingles.PLACE[0] + np.r_[words[1:], words[:1]] * shingles.PLACE[1])
    least = int(rank[:-1].argmin())
    pair = data[starts[least] : stops[least + 1]].tobytes().decode()
    phrases = [f"{pair} {prose(rng, 12)}" for _ in range(12)]
    rows = [(k, f"{prose(rng, 30)} {phrase} {pair} {prose(rng, 30)}") for k, phrase in enumerate(phrases)]
    rows += [(20 + k, " ".join(phrases[k::3]) + f" {pair} {prose(rng, 40)}") for k in range(3)]
    left = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert {i: r.text.split() for i, r in left.items()} == without_repeats(rows)
    assert all(left[i].text == text for i, text in rows)


def test_short_lines_go(frame):
    rng = random.Random(17)
    short = [prose(rng, words) for words in (4, 5, 8, 19)]
    rows = [(i, "\n".join([prose(rng, 30), *short, prose(rng, 30)])) for i in range(4)]
    left = {r.doc_id: r.text.split("\n") for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert left[0] == rows[0][1].split("\n")
    for i, text in rows[1:]:
        lines = text.split("\n")
        assert left[i] == [lines[0], short[0], lines[-1]]


@pytest.mark.parametrize("size", [20, 21, 25, 30, 51])
def test_passages_go_whole(frame, size):
    rng = random.Random(size)
    passages = [prose(rng, size) for _ in range(4)]
    # The words beside a passage differ in every document, so no repeat is longer than the passage.
    rows = [(i, " ".join([prose(rng, 34), f"l{i}", passages[i % 4], f"r{i}", prose(rng, 44)])) for i in range(16)]
    left = {r.doc_id: r.text.split() for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert left == without_repeats(rows)
    assert all(len(words) == 80 + size * (i < 4) for i, words in left.items())


def test_repeats_in_odd_rows(odd, empty):
    given = [(r.doc_id, r.text) for r in odd.collect()]
    left = substring_dedup.remove_repeats(odd)
    assert left.columns == [*odd.columns, "n_removed"]
    rows = left.collect()
    assert len(rows) == len(given)
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[7] is None and by_id[6] == "" and by_id[9] == "x" * 300_000
    assert by_id[8] == dict(given)[8]  # one word over and over is one piece
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_documents_share_no_long_passage_afterwards(documents):
    given = {r.doc_id: r.text for r in documents.collect()}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(documents).collect()}
    before = Counter(g for t in given.values() for g in grams(t, 50))
    after = Counter(g for t in left.values() for g in grams(t, 50))
    repeated = sum(n > 1 for n in before.values())
    assert repeated and sum(n > 1 for n in after.values()) <= 0.01 * repeated
    # Whole stay those that hold no repeated or similar line of five words, and no run of 20 words that stands elsewhere.
    lines = {}
    for i, text in given.items():
        for line in text.split("\n"):
            if len(line.split()) >= 5:
                lines.setdefault(shingle_set(line), []).append(i)
    repeated_line = {i for held in lines.values() if len(held) > 1 for i in held}
    holders = defaultdict(set)
    for shingles_of in lines:
        for g in shingles_of:
            holders[g].add(shingles_of)
    for shingles_of, held in lines.items():
        met = Counter(other for g in shingles_of for other in holders[g] if other != shingles_of)
        if any(100 * n >= 80 * (len(shingles_of) + len(other) - n) for other, n in met.items()):
            repeated_line.update(held)
    runs = Counter(g for t in given.values() for g in grams(t.lower(), 20))
    whole = [
        i
        for i, t in given.items()
        if i not in repeated_line and all(runs[g] == 1 for g in grams(t.lower(), 20)) and len(grams(t.lower(), 20)) == max(0, len(t.split()) - 19)
    ]
    assert len(whole) > 20
    for i in whole:
        assert left[i] == given[i]


def test_rounds_over_few_edges_write_few_files(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUND_ROWS", 50, raising=False)
    files = []
    real = components.written

    def counted(df):
        table = real(df)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "written", counted)
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["false", "32"]):
        spark.conf.set(n, v)
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(100) if k % 10 != 9], "a long, b long")
        found = {(r.a, r.b) for r in components.components(edges).collect()}
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    assert found == {(k, k // 10 * 10) for k in range(100) if k % 10}
    assert len(files) > 2 and max(files[1:]) <= 3
