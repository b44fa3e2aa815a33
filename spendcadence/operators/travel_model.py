"""Travel-event model: text and keyword features into random forests (Spark ML)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from spendcadence.operators import term_weights as TW
from spendcadence.operators import travel_features as TF
from spendcadence.session import released, stored

SEED = 42
TRAVEL_TREES, TRAVEL_DEPTH, TRAVEL_MIN_LEAF = 200, 15, 2
TRIGGER_TREES, TRIGGER_DEPTH = 100, 10
COPIES = "copies"
SLOTS = 1024


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) for every counted term."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        counts = vector_to_array(self.getInputCol())
        damped = F.transform(counts, lambda n: F.when(n > 0, F.ln(n) + 1).otherwise(F.lit(0.0)))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(damped))


def text_model(terms: list[Row]) -> PipelineModel:
    """TF-IDF vectors over a vocabulary (rows with index, term and idf): damped counts times idf, of unit length."""
    terms = sorted(terms, key=lambda r: r["index"])
    # A forest needs at least one column, also where no term is frequent enough.
    words = [r["term"] for r in terms] or [""]
    weights = [r["idf"] for r in terms] or [0.0]
    return PipelineModel(
        stages=[
            *TW.term_stages(),
            CountVectorizerModel.from_vocabulary(words, inputCol="_terms", outputCol="_counts"),
            SublinearTf(inputCol="_counts", outputCol="_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol="tfidf", p=2.0),
        ]
    )


def fit_tfidf(train: DataFrame, vocabulary: int = TW.VOCABULARY, min_docs: int = TW.MIN_DOCS) -> PipelineModel:
    """TF-IDF with inverse document frequency ln((n+1)/(df+1)) + 1 and unit length; collects the vocabulary only."""
    rows = train if COPIES in train.columns else distinct_rows(train)
    return text_model(TW.vocabulary(rows, size=vocabulary, min_docs=min_docs, copies=COPIES).collect())


def distinct_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (``keep``..., text, copies): equal rows once, with their number.

    Calendars repeat their texts, so this is what makes counting and training cheap; texts that are all different cost
    one shuffle.  A null text counts as empty.
    """
    copies = F.sum(COPIES) if COPIES in df.columns else F.count(F.lit(1))
    return df.groupBy(*keep, F.coalesce("text", F.lit("")).alias("text")).agg(copies.alias(COPIES))


def by_text(events: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events with the columns that ``score`` gives to (text) rows; each different text is scored once."""
    named = events.withColumn("_key", F.coalesce("text", F.lit("")))
    answers = score(named.select(F.col("_key").alias("text")).distinct())
    return named.join(answers.withColumnRenamed("text", "_key"), "_key").drop("_key")


def assemble(df: DataFrame, text_model: PipelineModel) -> DataFrame:
    """``features`` = TF-IDF followed by the eleven keyword features."""
    wide = TF.event_features(text_model.transform(df))
    assembler = VectorAssembler(inputCols=["tfidf", *TF.FEATURES], outputCol="features")
    helpers = [c for c in wide.columns if c.startswith("_")]
    return assembler.transform(wide).drop(*helpers)


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "event_id", test_share: float = 0.2,
                     seed: int = SEED) -> DataFrame:
    """Add ``is_test``: the ceil(share * n) rows of each label with the smallest salted hash.

    Exact without sorting a whole label in one task: hash-prefix counts locate
    the bucket in which the quota ends, only that bucket (1/65536 of the label)
    is ranked.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    sizes = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_bucket")
    quota = F.ceil(F.sum("_n").over(Window.partitionBy(label)) * test_share)
    marks = sizes.withColumns({"_quota": quota, "_before": F.sum("_n").over(upto) - F.col("_n")}).select(
        label, "_bucket", "_n", (F.col("_quota") - F.col("_before")).alias("_room")
    )
    # At most 65536 rows per label: small enough to send everywhere.
    placed = hashed.join(F.broadcast(marks), [label, "_bucket"])
    edge = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    whole = placed.filter(~edge).withColumn("is_test", F.col("_room") > 0)
    nth = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_digest"))
    cut = placed.filter(edge).withColumn("_nth", nth).withColumn("is_test", F.col("_nth") <= F.col("_room"))
    return whole.unionByName(cut.drop("_nth")).drop("_digest", "_bucket", "_n", "_room")


def in_slots(features: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows that stand for ``copies`` events, dealt evenly over min(copies, ``slots``) rows; without ``copies``, as they are.

    A forest draws its rows for every tree anew.  Up to ``slots`` equal events stay rows of their own, and are drawn as
    before; more of them share rows: no event is left out, and the weight drawn of such equal events has a relative standard
    deviation of 1 / sqrt(slots) instead of 1 / sqrt(copies).
    """
    if COPIES not in features.columns:
        return features.withColumn(COPIES, F.lit(1).cast("bigint"))
    rows = F.least(COPIES, F.lit(slots).cast("bigint"))
    dealt = features.withColumns({"_rows": rows, "_slot": F.explode(F.sequence(F.lit(1).cast("bigint"), rows))})
    more = (F.col("_slot") <= F.col(COPIES) % F.col("_rows")).cast("bigint")
    return dealt.withColumn(COPIES, F.expr(f"{COPIES} div _rows") + more).drop("_rows", "_slot")


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) of an event, times the events that a row stands for."""
    df = in_slots(df)
    counts = df.groupBy(label).agg(F.sum(COPIES).alias("_n"))
    everything = Window.partitionBy(F.lit(1))
    # One row per class: a window over all of it is tiny.
    weights = counts.withColumn(
        "weight", F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))
    ).drop("_n")
    return df.join(F.broadcast(weights), label).withColumn("weight", F.col("weight") * F.col(COPIES))


def train_travel_model(features: DataFrame, trees: int = TRAVEL_TREES, depth: int = TRAVEL_DEPTH):
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=TRAVEL_MIN_LEAF, seed=SEED,
    )
    return forest.fit(with_class_weight(features))


def train_trigger_model(features: DataFrame, trees: int = TRIGGER_TREES, depth: int = TRIGGER_DEPTH) -> PipelineModel:
    """Trigger of travel events; rows with a blank trigger are left out together with their text."""
    rows = features.filter((F.col("label") == 1) & (F.col("trigger_type") != ""))
    sizes = rows.groupBy("trigger_type").agg((F.sum(COPIES) if COPIES in rows.columns else F.count(F.lit(1))).alias("_n"))
    labels = [r["trigger_type"] for r in sizes.orderBy(F.desc("_n"), "trigger_type").collect()]
    indexer = StringIndexerModel.from_labels(
        labels, inputCol="trigger_type", outputCol="_trigger", handleInvalid="keep"
    )
    indexed = with_class_weight(indexer.transform(rows), "_trigger")
    forest = RandomForestClassifier(
        labelCol="_trigger", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED,
        predictionCol="_trigger_prediction", probabilityCol="_trigger_probability", rawPredictionCol="_trigger_raw",
    ).fit(indexed)
    back = IndexToString(
        inputCol="_trigger_prediction", outputCol="predicted_trigger", labels=[*indexer.labels, "other"]
    )
    return PipelineModel(stages=[forest, back])


@dataclass
class TravelModel:
    """A fitted text pipeline with its two forests."""

    text: PipelineModel
    travel: RandomForestClassificationModel
    trigger: PipelineModel

    def save(self, path: str) -> None:
        self.text.write().overwrite().save(f"{path}/text")
        self.travel.write().overwrite().save(f"{path}/travel")
        self.trigger.write().overwrite().save(f"{path}/trigger")

    @classmethod
    def load(cls, path: str) -> TravelModel:
        return cls(
            PipelineModel.load(f"{path}/text"),
            RandomForestClassificationModel.load(f"{path}/travel"),
            PipelineModel.load(f"{path}/trigger"),
        )

    def predict(self, events: DataFrame) -> DataFrame:
        """Events with ``prediction, probability, predicted_trigger``."""

        def score(texts: DataFrame) -> DataFrame:
            named = self.trigger.transform(self.travel.transform(assemble(texts, self.text)))
            return named.select(
                "text", "prediction", vector_to_array("probability")[1].alias("probability"), "predicted_trigger"
            )

        return by_text(events, score)

    def predict_travel(self, events: DataFrame) -> DataFrame:
        """Positive events with a confidence label."""
        return self.predict(events).filter(F.col("prediction") == 1).withColumn(
            "confidence", TF.confidence_label(F.col("probability"))
        )


def fit(labeled: DataFrame, trees: int = TRAVEL_TREES, trigger_trees: int = TRIGGER_TREES) -> TravelModel:
    """Train both models on (text, label, trigger_type) rows; their features are written once and read by both."""
    rows = stored(distinct_rows(labeled, ["label", "trigger_type"]))
    text = fit_tfidf(rows)
    features = stored(assemble(rows, text).select("label", "trigger_type", COPIES, "features"))
    model = TravelModel(text, train_travel_model(features, trees), train_trigger_model(features, trigger_trees))
    released(features)
    released(rows)
    return model


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per actual (rows) and predicted class."""
    return (
        scored.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("predicted"))
        .groupBy("label")
        .pivot("predicted", [0, 1])
        .count()
        .select("label", F.coalesce("0", F.lit(0)).alias("predicted_0"), F.coalesce("1", F.lit(0)).alias("predicted_1"))
    )


def evaluate_model(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, their weighted average, and accuracy."""
    cells = scored.groupBy(
        F.col(label).cast("int").alias("a"), F.col(prediction).cast("int").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(
        F.struct(F.col("a").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    sums = cells.select(F.inline(parts)).groupBy("cls").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )

    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    scores = sums.withColumns(
        {"precision": share(F.col("hits"), F.col("predicted")), "recall": share(F.col("hits"), F.col("support"))}
    ).withColumn(
        "f1",
        share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    per_class = scores.select(
        F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("scope"), "precision", "recall", "f1", "support"
    )
    total = F.sum("support")
    weighted = scores.agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")],
        total.alias("support"),
    ).select(F.lit("weighted_avg").alias("scope"), "precision", "recall", "f1", "support")
    accuracy = scores.agg((F.sum("hits") / total).alias("accuracy"), total.alias("support")).select(
        F.lit("accuracy").alias("scope"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
        F.col("accuracy").alias("f1"), "support",
    )
    return per_class.unionByName(weighted).unionByName(accuracy)


def stratified_folds(df: DataFrame, folds: int = 5, label: str = "label", id_col: str = "event_id",
                     seed: int = SEED) -> DataFrame:
    """Add ``fold``: the rows of each label dealt in turn, in the order of a salted hash of their id.

    Fold sizes within a label differ by one at most.  A row's position is its rank in its hash bucket (1/65536 of the
    label) plus the rows of the buckets before it, so no task sorts a whole label.  Rows that repeat an id may swap folds.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:fold:"), F.col(id_col).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    sizes = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_bucket")) - F.col("_n")
    # At most 65536 rows per label: small enough to send everywhere.
    offsets = sizes.select(label, "_bucket", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_digest"))
    placed = hashed.withColumn("_nth", nth).join(F.broadcast(offsets), [label, "_bucket"])
    return placed.withColumn("fold", ((F.col("_before") + F.col("_nth") - 1) % folds).cast("int")).drop(
        "_digest", "_bucket", "_nth", "_before"
    )


def cross_validate(labeled: DataFrame, folds: int = 5, trees: int = TRAVEL_TREES) -> tuple[float, float]:
    """Mean and deviation of the accuracy over stratified folds, each judged by a model that hasn't seen it.

    The folds' different texts are written once and counted in one pass; every fold's vocabulary comes from those counts
    without its own.  A fold without rows is left out.
    """
    dealt = stored(distinct_rows(stratified_folds(labeled, folds), ["fold", "label"]))
    terms = TW.fold_vocabularies(dealt, "fold", folds, copies=COPIES).collect()
    accuracies = []
    for fold in range(folds):
        text = text_model([r for r in terms if r["fold"] == fold])
        others = distinct_rows(dealt.filter(F.col("fold") != fold), ["label"])
        features = stored(assemble(others, text).select("label", COPIES, "features"))
        forest = train_travel_model(features, trees)
        hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col(COPIES)).otherwise(0))
        judged = forest.transform(assemble(dealt.filter(F.col("fold") == fold), text)).agg(hits, F.sum(COPIES)).first()
        accuracies += [judged[0] / judged[1]] if judged[1] else []
        released(features)
    released(dealt)
    return float(np.mean(accuracies)), float(np.std(accuracies))


def feature_importance(model: TravelModel, spark: SparkSession, n: int = 15) -> DataFrame:
    """The n most important features; the list is as long as the vocabulary, at most a few hundred."""
    vocabulary = next(stage.vocabulary for stage in model.text.stages if hasattr(stage, "vocabulary"))
    names = [*vocabulary, *TF.FEATURES]
    values = [float(v) for v in model.travel.featureImportances.toArray()]
    ranked = sorted(zip(names, values), key=lambda pair: (-pair[1], pair[0]))[:n]
    rows = [(i + 1, name, value) for i, (name, value) in enumerate(ranked)]
    return spark.createDataFrame(rows, "position int, feature string, importance double")

