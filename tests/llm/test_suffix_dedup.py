import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spendcadence.llm import suffix_dedup


def brute(rows, length):
    """id -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        rest = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(gone) else b""
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def found(df, length=100):
    return {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(df, length).collect()}


def repetitive(seed, count):
    """Texts stitched from few parts, with edits, copies, runs of one letter and several scripts."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcde éß\n") for _ in range(rng.randrange(5, 260))) for _ in range(12)] + ["a" * 300, "ab" * 160]
    texts = []
    for _ in range(count):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("XYZ日\x00") + text[at + 1 :]
        texts.append(rng.choice(texts) if texts and rng.random() < 0.2 else text)
    return list(enumerate(texts))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_equals_brute_force(spark, frame, monkeypatch, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = repetitive(batch, 120)
        rng = random.Random(1)
        ids = rng.sample(range(-500, 500), len(rows))
        rows = [(ids[i], t) for i, t in rows]
        assert found(frame(rows)) == brute(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("length", [24, 100, 151, 152, 300])
def test_other_lengths(frame, length):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(721))
    rows = [(i, "".join(rng.choice("ijklm ") for _ in range(90 + i)) + passage + "z" * i) for i in range(4)]
    rows += [(10 + i, t) for i, t in repetitive(length, 40)]
    assert found(frame(rows), length) == brute(rows, length)


def test_lengths_out_of_range_are_refused(frame):
    for length in (23, suffix_dedup.LONGEST + 1):
        with pytest.raises(ValueError):
            suffix_dedup.dedup(frame([(1, "text")]), length)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents) == brute(rows, 100)


def test_long_texts_are_taken_in_parts(frame, monkeypatch):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(1000))
    rows = [(1, text + "q" * 50 + text), (2, text[300:])]
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    monkeypatch.setattr(suffix_dedup, "blocks", lambda offsets: [(k, k + 1) for k in range(len(offsets) - 1)])
    runs = []
    for part, firsts, pasts in suffix_dedup.segments(np.array([0, len(data)]), 100):
        row, at, start, run, _ = suffix_dedup.anchors(data[firsts[0] : pasts[0]], np.array([0, pasts[0] - firsts[0]]), 100)
        runs += [(s + firsts[0], n) for s, n in zip(start, run)]
    covered = [p for s, n in runs for p in range(s, s + n)]
    assert sorted(covered) == list(range(len(data) - 99))


def test_families_merge_and_agree_with_one_array():
    rng = random.Random(6)
    family, seen, repeats = suffix_dedup.Family(), {}, Counter()
    expected = Counter()
    for batch in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(rng.randrange(1, 12))]
        owners = [(rng.randrange(30), rng.randrange(10**6)) for _ in strings]
        array, ids, places = suffix_dedup.Windows.build(
            np.array(strings, "S5"), *(np.array(x) for x in zip(*owners)), np.zeros(len(strings), np.int64)
        )
        for a, b in [(ids, places), *family.add(array)]:
            repeats.update(zip(a.tolist(), b.tolist()))
        for s, o in zip(strings, owners):
            if s in seen:
                expected[max(o, seen[s])] += 1
                seen[s] = min(o, seen[s])
            else:
                seen[s] = o
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert repeats == expected


def test_odd_rows(odd, empty):
    got = suffix_dedup.dedup(odd).collect()
    assert len(got) == odd.count()
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == brute(rows, 100)
    assert suffix_dedup.dedup(empty).count() == 0


def test_null_ids_only_lose_whole_texts(frame):
    text = "".join(chr(97 + k % 26) + str(k) for k in range(60))
    rows = suffix_dedup.dedup(frame([(1, text), (None, text), (None, text + "!")], extra=False)).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows) == [
        (False, len(text), 0), (True, len(text), len(text)), (True, len(text) + 1, 0),
    ]
