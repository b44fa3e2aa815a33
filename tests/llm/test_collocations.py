"""Phrase collocations against plain counting."""

import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest

from spendcadence.llm import collocations, queries

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, best=2000, covered=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {}
    longer = Counter()
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score)
        if len(p) == 3:
            for part in (p[:2], p[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = []
    for lang in total:
        kept = [(p, v) for (x, p), v in found.items() if x == lang and 100 * longer[x, p] < covered * v[0]]
        kept.sort(key=lambda e: (-e[1][4], -e[1][0], " ".join(e[0]).encode()))
        out += [(lang, rank, " ".join(p), *v) for rank, (p, v) in enumerate(kept[:best], 1)]
    return sorted(out)


def rows_of(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(
        [(None, t, g, "x", 1.5) for g, t in rows], "doc_id long, text string, lang string, w1 string, n double"
    )


def prose(rng, size, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(size))


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "öl", "a-b", "x's", "Ünï", "z", "　", "long" * 9]
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), prose(rng, rng.randint(0, 400), words)) for _ in range(40)]


@pytest.mark.parametrize("least,best", [(2, 2000), (10, 2000), (10, 7)])
def test_against_counting(spark, least, best):
    rows = corpus(least)
    found = rows_of(collocations.collocations(table(spark, rows), least=least, best=best))
    assert found == expected(rows, least, best) and len({r[0] for r in found}) == 3


def test_prefixes_divided_at_every_depth(spark, monkeypatch):
    rows = corpus(1) + [("en", "the of the of z " * 300)]
    want = expected(rows, 3)
    monkeypatch.setattr(collocations, "TOGETHER", 2000)
    for budget, heavy in ((1000, 100), (50, 1), (10_000, 700)):
        monkeypatch.setattr(collocations, "BUDGET", budget)
        monkeypatch.setattr(collocations, "HEAVY", heavy)
        assert rows_of(collocations.collocations(table(spark, rows), least=3)) == want


def test_covered_phrases_go(spark):
    rows = [("en", "red hot iron, " * 12 + "red hot, " * 12 + "cold old steel, " * 12 + "cold old, " * 13 + "hot iron, ")]
    found = rows_of(collocations.collocations(table(spark, rows)))
    assert found == expected(rows, 10)
    assert {r[2] for r in found} == {"red hot iron", "cold old steel", "cold old"}


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**13, 2 * 10**12), (3, 7, 3), (999_999_999_999_999,) * 3], "a long, l long, r long")
    found = [r.score for r in collocations.scored(rows, "l", "r", "score").collect()]
    assert found == [10**6 * r.a * r.a // (r.l * r.r) for r in rows.collect()]


def test_odd_texts(spark):
    rows = [(None, None), ("en", ""), ("en", " \t,\n"), ("en", "word " * 50_000), ("en", "x" * 300_000), ("de", "one word")]
    assert rows_of(collocations.collocations(table(spark, rows))) == expected(rows, 10)


def test_empty_table(spark):
    assert rows_of(collocations.collocations(table(spark, []))) == []


def test_query_on_documents(spark, sf_small, documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    assert rows_of(queries.op13_phrase_collocations(spark, sf_small)) == expected(rows, 10)


def test_shuffles_are_given_back_before_the_suffixes(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs = table(spark, [("en", " ".join(rng.choices(words, k=3000))) for _ in range(40)])
    folders = [d.getAbsolutePath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {p: p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data") if p.exists()}

    spark._jvm.java.lang.System.gc()
    before, left = set(shuffled()), []
    written = collocations.written

    def watched(df):
        past = time.time() + 10  # Spark's cleaner works beside us
        while len(left) == 2 and time.time() < past and sum(n for p, n in shuffled().items() if p not in before) > 500_000:
            time.sleep(0.2)
        left.append(sum(n for p, n in shuffled().items() if p not in before))
        return written(df)

    monkeypatch.setattr(collocations, "written", watched)
    collocations.counted(docs, 2, "text", "lang")
    assert len(left) == 3 and left[2] <= 500_000  # bitmaps only; the pairs have over a million bytes
