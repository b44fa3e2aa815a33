"""Fingerprints against spans compared one by one, and the edited texts against a plain loop."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendcadence.llm import fingerprints, queries
from spendcadence.llm.fingerprints import Prefix, code_points, likeness


def prose(rng, size, letters="abc 𝒳é"):
    return "".join(rng.choice(letters) for _ in range(size))


def mark(text):
    return Prefix(code_points(text)).fingerprint()


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def expected(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next, shared_start, shared_end) of rows with ids."""
    firsts = {}
    for i, text in rows:
        firsts[i] = min(firsts.get(i, text or ""), text or "", key=str.encode)
    order = sorted(firsts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]])) if order else {}
    out = []
    for i, text in rows:
        text, after = text or "", firsts[following[i]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append(
            (
                i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark(text), mark(edited), likeness(mark(text), mark(edited)),
                likeness(mark(text), mark(after)), common(text, edited), common(text[::-1], edited[::-1]),
            )
        )
    return sorted(out)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_start", "shared_end"]


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_spans_are_equal_where_hashes_are():
    rng = random.Random(2)
    text = prose(rng, 300, "ab")
    prefix = Prefix(code_points(text))
    for width in (1, 2, 5, 12):
        hashes = prefix.spans(0, len(text) - width + 1, width).tolist()
        spans = [text[k : k + width] for k in range(len(hashes))]
        assert len(set(hashes)) == len(set(spans)) == len(set(zip(hashes, spans)))


def test_extensions():
    rng = random.Random(4)
    for _ in range(200):
        a, b = prose(rng, rng.randint(1, 60), "ab"), prose(rng, rng.randint(1, 60), "ab")
        pa, pb = Prefix(code_points(a)), Prefix(code_points(b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert pa.extension(i, pb, j) == common(a[i:], b[j:])
        assert pa.extension_back(i, pb, j) == common(a[:i][::-1], b[:j][::-1])


def test_sums_go_on_from_a_shared_start():
    rng = random.Random(9)
    a, tail = code_points(prose(rng, 500)), code_points(prose(rng, 300))
    points = np.concatenate([a[:200], tail])
    for one, other in zip(Prefix(points, Prefix(a), 200).sums, Prefix(points).sums):
        assert (one == other).all()


@pytest.mark.parametrize("size", [fingerprints.LOW - 1, fingerprints.LOW + 5, fingerprints.CHUNK + 7])
def test_long_texts_have_the_hashes_of_short_ones(size):
    text = "x" * size + "the same words at the end"
    long, short = Prefix(code_points(text)), Prefix(code_points("the same words at the end"))
    assert long.span(size, size + 25) == short.span(0, 25)
    assert long.extension(size, short, 0) == 25 and long.extension_back(len(long), short, 25) == 25
    assert long.span(0, 9) == long.span(size - 9, size)


def span_sets(text):
    return {(w, text[k : k + w]) for w in fingerprints.WIDTHS for k in range(len(text) - w + 1)}


def test_likeness_estimates_jaccard():
    rng = random.Random(6)
    off = []
    for _ in range(60):
        size = rng.choice([3, 20, 400, 4000])
        a = prose(rng, size, "abcdefghij ")
        cut = rng.randint(0, size)
        b = a[:cut] + prose(rng, size - cut, "abcdefghij ")
        x, y = span_sets(a), span_sets(b)
        off.append(likeness(mark(a), mark(b)) - len(x & y) / len(x | y))
        if len(x | y) <= fingerprints.KEPT:
            assert off[-1] == 0
    assert max(map(abs, off)) < 0.25 and abs(np.mean(off)) < 0.04


def test_fingerprints_of_equal_texts():
    assert mark("same") == mark("same") != mark("emas")
    assert likeness(mark(""), mark("")) == 1 and likeness(mark(""), mark("a")) == 0 == likeness(mark("b"), mark("a"))


def test_rows(frame):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 200))) for i in rng.sample(range(-500, 500), 300)]
    rows += [(7000, "twice"), (7000, "twice"), (7000, "another"), (7001, None)]
    assert rows_of(fingerprints.compare_edited(frame(rows))) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("bytes_each", [50, 1000])
def test_hot_ids_and_many_intervals(frame, monkeypatch, bytes_each):
    monkeypatch.setattr(fingerprints, "INTERVAL_BYTES", bytes_each)
    rng = random.Random(8)
    rows = [(i, prose(rng, 30)) for i in range(60)] + [(25, prose(rng, 20)) for _ in range(40)]
    found = fingerprints.with_neighbours(frame(rows), "doc_id", "text", 4)
    hot = found.filter("_id = 25 AND _row").select("_slot").distinct().count()
    assert hot > 1
    assert rows_of(fingerprints.compare_edited(frame(rows))) == sorted(expected(rows), key=str)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = rows_of(fingerprints.compare_edited(odd))
    assert [r for r in found if r[0] is not None] == sorted(expected([r for r in rows if r[0] is not None]), key=str)
    assert sorted((r for r in found if r[0] is None), key=str) == sorted(
        ((None, len(t or ""), None, mark(t or ""), *[None] * 5) for i, t in rows if i is None), key=str
    )


def test_empty_and_single(frame, empty):
    assert rows_of(fingerprints.compare_edited(empty)) == []
    assert rows_of(fingerprints.compare_edited(frame([(5, "alone")]))) == expected([(5, "alone")])
    assert fingerprints.fingerprints(frame([(5, None)])).first().fingerprint == mark("")


def test_query_on_documents(spark, sf_small, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = rows_of(queries.op12_document_fingerprints(spark, sf_small))
    assert found == sorted(expected(rows), key=str)
    long = [r for r in found if r[1] >= 200]
    assert sum(r[5] > r[6] for r in long) >= 0.95 * len(long)
    same = documents.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).filter("size(ids) > 1").collect()
    by_id = {r[0]: r[3] for r in found}
    assert same and all(len({by_id[i] for i in r.ids}) == 1 for r in same)
