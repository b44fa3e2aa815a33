import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spendcadence.llm import bpe, bpe_codec, packing, token_counts

MIXED = [
    *"aAbZ'sS  \n\t09.,!?-", "é", "é", "É", "ß", "ñ", "\x1c", "\x1d", "\x00", "\x07", "\x85", "\xa0", " ", " ",
    "İ", "ı", "Σ", "σ", "ς", "ŉ", "ſ", "ª", "中文", "日", "한", "가", "🙂", "👩‍👧", "﻿", "ﬁ", "²", "½", "Ⅷ",
    "٣", "<|endoftext|>", "<|startoftext|>", "<|", "'re", "'ve", "n't", "The", "tion",
]


@pytest.fixture(scope="module")
def library(words):
    return Tokenizer.from_file(words)


def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(MIXED) for _ in range(rng.randrange(40))) for _ in range(4000)]
    return [*made, "", "a" * 5000, "ab " * 3000, "é" * 1000, "<|endoftext|><|endoftext|>"]


def test_encoding_equals_the_library(words, library):
    codec, counter = bpe_codec.codec(words), token_counts.counter(words)
    for text in texts():
        expected = library.encode(text, add_special_tokens=False)
        parts = codec.encode_chunks(text)
        assert np.frombuffer(b"".join(parts), bpe_codec.ID).tolist() == expected.ids, repr(text)
        assert counter(text) == len(expected.ids)
        assert codec.decode_chunks(parts) == library.decode(expected.ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(words, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    counter = token_counts.Counter(bpe.vocabulary(words))
    for text in texts()[:300]:
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_rows(spark, odd, empty, words, library):
    rows = token_counts.token_counts(odd, words).collect()
    given = [r.text or "" for r in odd.collect()]
    assert Counter((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == Counter(
        (len(t.encode()), n, n > 2048) for t in given for n in [len(library.encode(t, add_special_tokens=False).ids)]
    )
    assert token_counts.token_counts(empty, words).count() == 0


def test_round_trip_of_documents(documents, words, library):
    found = {r.doc_id: r for r in bpe_codec.round_trip(documents, words).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_then_decode(odd, empty, words, library):
    encoded = bpe_codec.encode(odd.filter("doc_id is not null"), words)
    back = {r.doc_id: r.text for r in bpe_codec.decode(encoded, words).collect()}
    for row in odd.filter("doc_id is not null").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert back[row.doc_id] == library.decode(ids, skip_special_tokens=False)
    assert bpe_codec.round_trip(empty, words).count() == 0


def placed(counts, capacity):
    """Items of a plan by sequence: (place, length)."""
    by_sequence, ranks = defaultdict(list), defaultdict(list)
    for s in packing.best_fit(counts, capacity):
        for rank in range(s.first, s.first + s.taken):
            ranks[s.length].append(rank)
            at = rank - s.first
            by_sequence[s.sequence + at // s.each].append((s.place + at % s.each * s.length, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    return by_sequence


def one_by_one(counts, capacity):
    """Number of sequences of best fit over single items."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            room = min(fitting) if fitting else capacity
            if fitting:
                rooms.remove(room)
            rooms.append(room - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_over_counts_is_best_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 41): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}
    by_sequence = placed(counts, 40)
    for items in by_sequence.values():
        end = 0
        for place, length in sorted(items):
            assert place == end
            end += length
        assert end <= 40
    assert len(by_sequence) == one_by_one(counts, 40)


def check_packing(docs, words, library, capacity):
    rows = packing.pack(docs, words, capacity=capacity).collect()
    expected = Counter()
    for row in docs.collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[(row.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for items in by_sequence.values():
        end = 0
        for place, length in sorted(items):
            assert place == end
            end += length
        assert end <= capacity
    assert len(by_sequence) == one_by_one(Counter(k[3] for k in expected.elements()), capacity)


def test_documents_are_packed(documents, words, library):
    check_packing(documents, words, library, 4096)


def test_odd_rows_are_packed(odd, empty, words, library):
    check_packing(odd, words, library, 512)
    assert packing.pack(empty, words).count() == 0
