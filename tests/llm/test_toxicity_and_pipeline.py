import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from spendcadence.llm import gru, toxicity

NASTY = ["idiot", "moron", "clown", "scum"]


def prose(rng, words):
    return " ".join(rng.choice("the of and in to").strip() + rng.choice(["ra", "lo", "mi", "ne"]) * rng.randrange(1, 4) for _ in range(words))


def labelled(count, seed=1):
    """Rows (id, text, toxic); a toxic text holds two nasty words or words of a nasty stem somewhere."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = prose(rng, rng.choice([3, 20, 60, 400])).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice([*NASTY, "gruwel" + rng.choice(["en", "ig", "aard"])]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    network = gru.Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    inputs = rng.standard_normal((9, gru.INPUTS))
    words = rng.integers(0, 9, (6, 4))
    labels, weights = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        logit = network.logits(network.projected(inputs), words).astype(float)
        return (weights * (np.log1p(np.exp(logit)) - labels * logit)).mean()

    g, d_inputs = network.gradients(inputs, words, labels, weights)
    checked = {**{k: (network.p[k], g[k]) for k in g}, "inputs": (inputs, d_inputs)}
    for name, (values, gradient) in checked.items():
        at = tuple(rng.integers(0, n) for n in values.shape)
        before = values[at]
        values[at] = before + 1e-2
        up = loss()
        values[at] = before - 1e-2
        down = loss()
        values[at] = before
        assert abs((up - down) / 2e-2 - gradient[at]) < 2e-3, name


def test_windows_cover_every_word():
    for count in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        begins, owner = gru.windows(np.array([5, count, 40]))
        mine = begins[owner == 1] - gru.WINDOW
        size = max(count, gru.WINDOW)
        covered = {p for b in mine for p in range(b, b + gru.WINDOW)}
        assert covered == set(range(size))
        assert all(b - a <= gru.STRIDE for a, b in zip(mine, mine[1:]))


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(1500)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == len(rows)
    held = [(found[i], k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in found.values()) == len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert np.mean([r.predicted == k for r, k in held]) > 0.97


def test_held_out_labels_are_never_learnt_from(spark, tables):
    rows, docs, labels = tables
    turned = spark.createDataFrame(
        [(i, 1 - k if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, _, k in rows], "doc_id long, toxic int"
    )
    some = docs.limit(300)
    first = {r.doc_id: r.score for r in toxicity.toxicity(some, labels).collect()}
    second = {r.doc_id: r.score for r in toxicity.toxicity(some, turned).collect()}
    assert first == second


def test_forgetting_words_changes_no_score():
    rows = labelled(60, 4)
    network = gru.Network().train([t for _, t, _ in rows], [k for _, _, k in rows], epochs=1)
    texts = [t for _, t, _ in rows]
    whole = gru.Scorer(network)(texts)
    small = gru.Scorer(network, remembered=10)
    assert np.allclose(whole, [small([t])[0] for t in texts], atol=1e-5)


def sample(docs, labels, most, longest=30_000):
    rows = toxicity.training_rows(docs, labels, "toxic", most, longest, "doc_id", "text").collect()
    return {r["_id"]: (r["_text"], r["_label"]) for r in rows}, len(rows)


def test_sample_is_bounded_and_holds_rows_with_texts(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    # Most labelled ids have no document or no text; one id is repeated, with other texts too.
    rows = [(i, f"text {i}") for i in ids[::100]] + [(i, None) for i in ids[1::100]] + [(ids[0], "again")] * 500 + [(ids[2], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in ((2, 2), (1000, 1000)):
        found, count = sample(docs, labels, most)
        assert count == len(found) <= sum(most)
        assert all(t == ("again" if i == ids[0] else f"text {i}") for i, (t, _) in found.items())
    assert found.keys() == set(ids[::100])


def test_long_texts_are_learnt_from_in_stretches(spark):
    rng = random.Random(3)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:20]
    long = {i: " ".join(f"w{i}x{k}" for k in range(20_000)) for i in ids[:10]}
    docs = spark.createDataFrame([(i, long.get(i, prose(rng, 9))) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in long)) for i in ids], "doc_id long, toxic int")
    found, count = sample(docs, labels, (100, 100), 3000)
    assert count == len(ids)
    for i, text in long.items():
        kept = found[i][0]
        words = set(text.split())
        assert 2000 < len(kept.encode()) <= 3000 and len(set(kept.split()) - words) <= 1  # one stretch is cut
        places = [int(w.split("x")[1]) for w in kept.split() if w in words]
        assert max(places) - min(places) > 3000  # from all over the text
    assert toxicity.stretches("x" * 10_000, 3000) == "x" * 3000


def test_odd_rows_are_scored(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.toxicity(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[6] == by_id[7]
    assert toxicity.toxicity(empty, some).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """The rows of documents, and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_small).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5


def test_toxicity_stage_drops_what_it_scores_high(spark, sf_small, stages):
    scores = toxicity.toxicity(stages[0], spark.read.parquet(f"{sf_small}/labels.parquet")).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores if not r.predicted}


def test_copies_stage_equals_brute_force(stages):
    import re

    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in stages[2].collect()} == set(first.values())


def test_near_copies_stage_equals_brute_force(stages):
    from test_near_copies import brute_components

    found = brute_components([(r.doc_id, r.text) for r in stages[2].collect()])
    assert {r.doc_id for r in stages[3].collect()} == {least for _, least in found.values()}


def test_repeats_stage_changes_only_texts(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert (row.lang, row.source) == (before[i].lang, before[i].source)
        assert row.n_chars == len(row.text) and set(row.text.split()) <= set(before[i].text.split())


def test_repeats_stage_equals_brute_force(spark, frame, sf_small):
    from test_near_copies import prose as varied
    from test_near_copies import without_repeats

    rng = random.Random(41)
    passages = [varied(rng, 25) for _ in range(5)]
    rows = [(i, " ".join([varied(rng, 40), f"l{i}", rng.choice(passages), f"r{i}", varied(rng, 40)])) for i in range(60)]
    left = corpus_pipeline.cut_repeats(spark, frame(rows), sf_small).collect()
    assert {r.doc_id: r.text.split() for r in left} == without_repeats(rows)


def test_packing_stage_holds_every_document(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows if r.piece == 0} == {r.doc_id for r in stages[4].collect()}
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096


def test_run_gives_the_last_stage(spark, sf_small, stages):
    rows = entry_points.queries()["pipeline"](spark, sf_small)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows.collect()) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect()
    )


def test_odd_rows_pass_through_every_stage(spark, sf_small, tmp_path):
    """Nulls in any column, odd texts, repeated rows and clashing column names."""
    from conftest import CLASHING, ODD

    text = prose(random.Random(2), 90)
    rows = [(i, t, "en", "web", 4) for i, t in ODD] + [(20, text, None, None, None), (21, text + " end", "de", "x", 1)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{n} {k}" for n, k, _ in CLASHING)])
    docs = spark.createDataFrame([(*r, *(v for _, _, v in CLASHING)) for r in rows], schema)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            given = [tuple(r)[2:4] + tuple(r)[5:] for r in before.collect()]
            assert all(tuple(r)[2:4] + tuple(r)[5:] in given for r in docs.collect()), name
        if name == "exact_dedup":
            # rows that repeat an id and text carry one decision, so both rows of 3 stay
            assert {r.doc_id for r in docs.filter("text LIKE 'same%'").collect()} <= {3}
        if name == "ngram_jaccard_join":
            assert docs.filter("doc_id = 21").count() == 0


def test_an_empty_corpus_passes_through(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
