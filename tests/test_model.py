import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendcadence.operators import term_weights as TW
from spendcadence.operators import travel_model as TM
from spendcadence.plans import journeys


@pytest.fixture(scope="module")
def rows(spark, sf_small):
    return journeys.training(spark, sf_small).cache()


def test_split_takes_the_exact_share_of_every_label(rows):
    split = TM.stratified_split(rows)
    sizes = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    for label in (0, 1):
        total = sizes[(label, True)] + sizes[(label, False)]
        assert sizes[(label, True)] == math.ceil(0.2 * total)
    assert split.count() == rows.count()


def test_tfidf_rows_have_unit_length(rows):
    vectors = TM.fit_tfidf(rows).transform(rows).select(TM.vector_to_array("tfidf").alias("v"))
    lengths = vectors.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).distinct().collect()
    assert all(math.isclose(r["n"], 1.0) for r in lengths)


def test_model_predicts_saves_and_reloads(spark, rows, sf_small, tmp_path):
    parts = TM.stratified_split(rows)
    model = TM.fit(parts.filter("not is_test"), trees=10, trigger_trees=5)
    scored = model.predict(parts.filter("is_test"))
    metrics = {r["scope"]: r for r in TM.evaluate_model(scored).collect()}
    assert metrics["accuracy"]["precision"] > 0.95 and metrics["weighted_avg"]["support"] == scored.count()
    model.save(str(tmp_path / "m"))
    events = journeys.texts(spark, sf_small)
    again = TM.TravelModel.load(str(tmp_path / "m"))
    key = ["event_id", "prediction", "predicted_trigger"]
    assert sorted(map(tuple, model.predict(events).select(*key).collect())) == sorted(map(tuple, again.predict(events).select(*key).collect()))
    top = TM.feature_importance(model, spark).collect()
    assert len(top) == 15 and top[0]["importance"] >= top[-1]["importance"]


TEXTS = ["Flight to Boston tonight", "flight to boston", "Gym class, gym class and the gym class", "", None, "gym"]


def by_hand(texts, size, min_docs):
    """Weights of each text: words of two letters and more without stop words, their pairs, sklearn-like weights."""
    stops = {"to", "and", "the"}
    docs = []
    for text in texts:
        words = [w for w in (text or "").lower().replace(",", " ").split() if len(w) > 1 and w not in stops]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df = Counter(t for d in docs for t in d)
    total = Counter()
    for d in docs:
        total.update(d)
    terms = sorted((t for t in df if df[t] >= min_docs), key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((len(docs) + 1) / (df[t] + 1)) + 1 for t in terms}
    raw = [{t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf} for d in docs]
    return terms, [{t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()} for d in raw]


@pytest.mark.parametrize("size, min_docs", [(500, 1), (500, 2), (3, 1), (4, 3)])
def test_term_weights_by_hand(spark, size, min_docs):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "event_id long, text string")
    terms = TW.vocabulary(df, size=size, min_docs=min_docs)
    expected, weights = by_hand(TEXTS, size, min_docs)
    assert [r["term"] for r in terms.orderBy("index").collect()] == expected
    found = [{} for _ in TEXTS]
    for r in TW.tfidf_rows(df, terms, "event_id").collect():
        found[r["event_id"]][r["term"]] = r["weight"]
    assert [sorted(d) for d in found] == [sorted(d) for d in weights]
    assert all(math.isclose(found[i][t], w) for i, d in enumerate(weights) for t, w in d.items())


def test_vectors_hold_the_same_weights(rows):
    terms = TW.vocabulary(rows)
    names = [r["term"] for r in terms.orderBy("index").collect()]
    wide = TM.fit_tfidf(rows).transform(rows).select("event_id", TM.vector_to_array("tfidf").alias("v"))
    vectors = {r["event_id"]: {names[i]: v for i, v in enumerate(r["v"]) if v} for r in wide.collect()}
    sparse = {i: {} for i in vectors}
    for r in TW.tfidf_rows(rows, terms, "event_id").collect():
        sparse[r["event_id"]][r["term"]] = r["weight"]
    assert {i: sorted(d) for i, d in vectors.items()} == {i: sorted(d) for i, d in sparse.items()}
    assert all(math.isclose(sparse[i][t], w) for i, d in vectors.items() for t, w in d.items())


def test_no_rows_and_no_terms(spark):
    empty = spark.createDataFrame([], "event_id long, text string")
    assert TW.vocabulary(empty).collect() == [] and TW.tfidf_rows(empty, TW.vocabulary(empty), "event_id").collect() == []
    lone = spark.createDataFrame([(1, "only here"), (2, None)], "event_id long, text string")
    assert TW.vocabulary(lone).collect() == []
    assert [list(r["v"]) for r in TM.fit_tfidf(lone).transform(lone.filter("text is not null")).select(
        TM.vector_to_array("tfidf").alias("v")).collect()] == [[0.0]]


def test_a_folds_vocabulary_is_that_of_the_other_rows(rows):
    dealt = TM.stratified_folds(rows, 3).cache()
    left = {(r["fold"], r["index"]): (r["term"], r["docs"], r["idf"]) for r in TW.fold_vocabularies(dealt, "fold", 3).collect()}
    for fold in range(3):
        alone = TW.vocabulary(dealt.filter(F.col("fold") != fold)).collect()
        assert {(fold, r["index"]): (r["term"], r["docs"], r["idf"]) for r in alone} == {k: v for k, v in left.items() if k[0] == fold}


def test_folds_are_stratified(rows):
    sizes = {(r["label"], r["fold"]): r["count"] for r in TM.stratified_folds(rows).groupBy("label", "fold").count().collect()}
    assert {f for _, f in sizes} == set(range(5))
    for label in (0, 1):
        of_label = [n for (at, _), n in sizes.items() if at == label]
        assert max(of_label) - min(of_label) <= 1
    assert sum(sizes.values()) == rows.count()


def test_cross_validation(rows):
    mean, deviation = TM.cross_validate(rows, folds=2, trees=5)
    assert mean > 0.95 and deviation >= 0.0


def test_metrics_by_hand(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    scored = spark.createDataFrame(pairs, "label int, prediction int")
    found = {r["scope"]: r for r in TM.evaluate_model(scored).collect()}
    assert (found["class_1"]["precision"], found["class_1"]["recall"], found["class_1"]["support"]) == (0.6, 0.75, 4)
    assert math.isclose(found["accuracy"]["precision"], 0.7)
    matrix = {r["label"]: (r["predicted_0"], r["predicted_1"]) for r in TM.confusion_matrix(scored).collect()}
    assert matrix == {0: (4, 2), 1: (1, 3)}


def test_equal_rows_train_as_weighted_rows(spark):
    copies = [("flight to miami", 1, 3000), ("gym class", 0, 7), ("gym class", 1, 1), (None, 0, 1500)]
    rows = spark.createDataFrame([(t, y) for t, y, n in copies for _ in range(n)], "text string, label int")
    distinct = TM.distinct_rows(rows, ["label"])
    assert {(r["text"], r["label"]): r["copies"] for r in distinct.collect()} == {(t or "", y): n for t, y, n in copies}
    plain = TM.with_class_weight(rows).groupBy("text", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    dealt = TM.with_class_weight(distinct).groupBy("text", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    expected = {(r["text"] or "", r["label"]): (r["w"], min(r["n"], TM.SLOTS)) for r in plain.collect()}
    found = {(r["text"], r["label"]): (r["w"], r["n"]) for r in dealt.collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k][0], w) and found[k][1] == n for k, (w, n) in expected.items())


def test_vocabulary_of_distinct_rows_is_that_of_all_rows(rows):
    twice = rows.unionByName(rows.filter("event_id % 3 = 0"))
    by_copies = TW.vocabulary(TM.distinct_rows(twice), copies=TM.COPIES)
    assert sorted(by_copies.collect()) == sorted(TW.vocabulary(twice).collect())


def test_every_event_is_scored_by_its_text(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (4, None)], "event_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def score(texts):
        seen.add(texts.count())
        return texts.select("text", F.length("text").alias("n"))

    found = sorted(tuple(r) for r in TM.by_text(events, score).select("event_id", "text", "n").na.fill("-").collect())
    assert found == [(1, "a", 1), (2, "b", 1), (3, "a", 1), (4, "-", 0), (4, "-", 0)] and seen.value == 3


@pytest.mark.parametrize("size, min_docs", [(20, 2), (7, 1)])
def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch, size, min_docs):
    rng = random.Random(size)
    often = [f"often{k}" for k in range(12)]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.6 else f"rare{rng.randrange(400)}" for _ in range(30)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string")
    counted = []
    left_over = TW.left_over
    monkeypatch.setattr(TW, "left_over", lambda rows, *a: counted.append(rows.count()) or left_over(rows, *a))
    found = [r["term"] for r in TW.vocabulary(df, size=size, min_docs=min_docs).orderBy("index").collect()]
    assert found == by_hand(texts, size, min_docs)[0]
    pruned = counted[-1]
    monkeypatch.setattr(TW, "FREQUENT", 0)  # counts all pairs
    assert [r["term"] for r in TW.vocabulary(df, size=size, min_docs=min_docs).orderBy("index").collect()] == found
    assert pruned < 0.4 * counted[-1]
