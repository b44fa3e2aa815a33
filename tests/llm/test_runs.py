"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendcadence.llm import queries, runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected(doc_id, text):
    words = planted(WORD.findall((text or "").encode()), doc_id)
    found = brute_runs(words)
    dropped = {i for s, l, q in found for i in range(s + q, s + l)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{l},{q}\n" for s, l, q in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def sequences(count):
    rng = random.Random(5)
    for _ in range(count):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a + p, min(n, a + p * rng.randint(2, 7) + rng.randrange(p))):
                words[i] = words[i - p]
        yield words


def test_runs_of_sequences():
    several = 0
    for words in sequences(1500):
        found = runs.runs_of(words)
        assert found == brute_runs(words)
        several += len(found) > 1
    assert several > 50


def test_batches_lose_no_run():
    texts = [words for words in sequences(400)]
    found = runs.batch_runs(pa.array(["\n".join("w" * (x + 1) for x in words) for words in texts], pa.string()))
    assert found == [brute_runs(words) for words in texts]


def test_extensions_and_tree():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        order, turns = runs.SuffixTree(words).leaves()
        assert order == sorted(range(len(words) + 1), key=lambda i: [*words[i:], -1])
        forth = runs.Extensions(order, turns)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                k = 0
                while j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                assert forth(*(runs.np.array([x]) for x in (i, j)))[0] == k


ODD_RUNS = [
    (0, "a b a b a b a b c"),
    (1, "A a A a A a A a"),
    (2, "x\x0bx\x0cx x\tx\r\nx"),
    (3, "é é é é é é　é"),
    (4, "a a a a a"),
    (4, "a a a a a a a b b b b b b b b"),
    (None, "p q p q p q p q p"),
    (12, "one two three four five six seven eight nine ten"),
    (None, None),
]


def rows_of(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def found_in(df):
    return rows_of(runs.summary(runs.collapse_runs(runs.with_periods(df))))


def test_odd_rows(frame):
    rows = ODD_RUNS + [(k, f"w{k} " * 3 + " ".join(str(i % 7) for i in range(k))) for k in range(100, 140)]
    assert found_in(frame(rows)) == sorted((expected(*r) for r in rows), key=str)


def test_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    short = [r for r in rows if not r[1] or len(r[1]) < 200_000]
    found = found_in(odd)
    assert len(found) == len(rows)
    assert sorted((r for r in found if r[0] not in (8, 9)), key=str) == sorted((expected(*r) for r in short), key=str)
    assert next(r[:6] for r in found if r[0] == 8) == (8, 1, 0, 50_000, 1, 50_000_000)


def test_empty_table(empty):
    assert found_in(empty) == []


def test_collapsed_text_is_returned(frame):
    found = runs.collapse_runs(frame([(1, "go  go go go go go home")])).first()
    assert [tuple(r) for r in found.runs] == [(0, 6, 1)] and found.collapsed == "go home"


def test_query_on_documents(spark, sf_small, documents):
    found = {r[0]: r for r in rows_of(queries.op11_periodic_runs(spark, sf_small))}
    small = [(r.doc_id, r.text) for r in documents.filter(F.length("text") < 4000).collect()]
    assert len(found) == documents.count() and sum(r[1] > 0 for r in found.values()) >= 10
    for row in small:
        assert found[row[0]] == expected(*row)
