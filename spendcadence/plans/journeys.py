"""Queries over calendar events: features, away periods, savings and the travel model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.functions import rules as R
from spendcadence.functions import text as T
from spendcadence.operators import travel as TV
from spendcadence.operators import travel_features as TF
from spendcadence.operators import term_weights as TW
from spendcadence.operators import travel_model as TM
from spendcadence.plans import adapters as A
from spendcadence.plans import oracle_base as S
from spendcadence.plans.registry import query
from spendcadence.session import ensure_checkpoint_dir, stored
from spendcadence.sinks import reports as RP
from spendcadence.sources import events as E

# --- savings --------------------------------------------------------------------


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return TF.merge_away_periods(A.away_events(spark, sf))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return TV.travel_savings(A.local_subscriptions(spark, sf), merged(spark, sf), A.TODAY_TRAVEL)


_MERGED_KEY = f"user_id, {S.iso('departure_date')} AS departure_date, {S.iso('return_date')} AS return_date"


@query(
    "trv_01_away_days",
    S.build(
        f"""SELECT {_MERGED_KEY}, greatest(0, date_diff('day', greatest(departure_date, DATE '1998-01-01'), return_date))::INT
              AS days_away FROM merged""",
        ["merged"],
    ),
)
def away_days(spark: SparkSession, sf: str) -> DataFrame:
    days = TV.away_days(F.col("departure_date"), F.col("return_date"), A.TODAY_TRAVEL)
    return merged(spark, sf).select("user_id", "departure_date", "return_date", days.alias("days_away"))


@query(
    "trv_02_local_split",
    S.build(
        """SELECT user_id, count(*) FILTER (WHERE is_local) AS local_count, count(*) FILTER (WHERE NOT is_local) AS portable_count
           FROM locals GROUP BY user_id""",
        ["locals"],
    ),
)
def local_split(spark: SparkSession, sf: str) -> DataFrame:
    return TV.local_split(A.local_subscriptions(spark, sf))


_REC_KEY = f"user_id, subscription, {S.iso('departure_date')} AS departure_date"


@query(
    "trv_03_travel_savings",
    S.build(
        f"""SELECT {_REC_KEY}, {S.iso('return_date')} AS return_date, away_reason, destination, days_away, months_away, monthly_cost,
                   potential_savings, penalty, net_savings, location_type, confidence FROM recommendations""",
        ["recommendations"],
    ),
)
def travel_savings(spark: SparkSession, sf: str) -> DataFrame:
    return recommendations(spark, sf).drop("action", "action_detail").withColumn(
        "days_away", F.col("days_away").cast("bigint")
    )


@query("trv_04_savings_action", S.build(f"SELECT {_REC_KEY}, action, action_detail FROM recommendations", ["recommendations"]))
def savings_action(spark: SparkSession, sf: str) -> DataFrame:
    return recommendations(spark, sf).select("user_id", "subscription", "departure_date", "action", "action_detail")


@query(
    "trv_05_total_savings",
    S.build(
        """SELECT user_id, sum(CAST(round_even(net_savings, 2) AS DECIMAL(18, 2)))::DOUBLE AS total_savings,
                  count(*) AS recommendations FROM recommendations GROUP BY user_id""",
        ["recommendations"],
    ),
)
def total_savings(spark: SparkSession, sf: str) -> DataFrame:
    return TV.total_savings(recommendations(spark, sf))


def _terms(kind: str) -> str:
    return S.first_rule("lower(name)", R.ALTERNATIVE_SEARCH_TERMS[kind])


@query(
    "trv_06_alternative_search_term",
    S.build(
        f"""SELECT user_id, name, CASE location_type WHEN 'physical' THEN coalesce({_terms('physical')}, 'alternatives to ' || name)
                WHEN 'regional_service' THEN coalesce({_terms('regional_service')}, 'visitor ' || name || ' options') END AS term
            FROM locals""",
        ["locals"],
    ),
)
def alternative_search_term(spark: SparkSession, sf: str) -> DataFrame:
    return TV.with_search_term(A.local_subscriptions(spark, sf)).select("user_id", "name", "term")


def attached(spark: SparkSession, sf: str) -> DataFrame:
    return TV.attach_alternatives(recommendations(spark, sf), A.alternatives(spark, sf))


@query(
    "trv_07_attach_alternatives",
    S.build(
        f"""SELECT {_REC_KEY}, coalesce(alternatives_found::VARCHAR, 'not searched') AS alternatives_found,
                   coalesce(option_count, -1)::INT AS option_count FROM attached""",
        ["attached"],
    ),
)
def attach_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    found = F.col("alternatives.alternatives_found").cast("string")
    options = F.col("alternatives.options")
    return attached(spark, sf).select(
        "user_id", "subscription", "departure_date", F.coalesce(found, F.lit("not searched")).alias("alternatives_found"),
        F.when(F.col("alternatives").isNull(), -1).otherwise(F.coalesce(F.size(options), F.lit(0))).alias("option_count"),
    )


@query(
    "trv_08_alternative_cost",
    S.build(
        f"""SELECT {_REC_KEY}, cheapest_monthly, cheapest_monthly * months_away AS alternative_total,
                   potential_savings - cheapest_monthly * months_away AS net_after_alternative
            FROM attached WHERE cheapest_monthly IS NOT NULL""",
        ["attached"],
    ),
)
def alternative_cost(spark: SparkSession, sf: str) -> DataFrame:
    priced = TV.alternative_cost(attached(spark, sf)).filter(F.col("cheapest_monthly").isNotNull())
    return priced.select(
        "user_id", "subscription", "departure_date", "cheapest_monthly", "alternative_total", "net_after_alternative"
    )


@query(
    "trv_09_trip_duration",
    S.build(f"SELECT {_MERGED_KEY}, date_diff('day', departure_date, return_date)::INT AS days FROM merged", ["merged"]),
)
def trip_duration(spark: SparkSession, sf: str) -> DataFrame:
    days = TV.trip_duration(F.col("departure_date"), F.col("return_date"))
    return merged(spark, sf).select("user_id", "departure_date", "return_date", days.alias("days"))


@query(
    "trv_10_top_n_per_user",
    S.build(
        f"""SELECT user_id, event_id, {S.iso('start_date')} AS start_date, position::INT AS position, greatest(n - 10, 0)::BIGINT AS more
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date, event_id) AS position,
                         count(*) OVER (PARTITION BY user_id) AS n FROM calendar) WHERE position <= 10""",
        ["calendar"],
    ),
)
def top_n_per_user(spark: SparkSession, sf: str) -> DataFrame:
    events = A.calendar_events(spark, sf).select("user_id", "event_id", "start_date")
    return TV.top_n(events, ["user_id"], ["start_date", "event_id"], 10)


# --- event texts ----------------------------------------------------------------


def texts(spark: SparkSession, sf: str) -> DataFrame:
    text = TF.combine_text(F.col("summary"), F.col("location"), F.col("description"))
    return A.calendar_events(spark, sf).withColumn("text", text)


@query("mlt_01_combine_text", S.build("SELECT event_id, text FROM texts", ["texts"]))
def combine_text(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("event_id", "text")


def _features_sql(source: str, key: str) -> str:
    airports = "|".join(code.lower() for code in R.AIRPORT_CODES)
    edge = r"[^\p{L}\p{N}_]"
    return f"""
      SELECT {key}, t AS travel_keyword_count, (t > 0)::INT AS has_travel_keyword, l AS local_keyword_count,
             (l > 0)::INT AS has_local_keyword, regexp_matches(low, '(^|\\s)({airports})($|\\s)')::INT AS has_airport_code,
             {S.any_of('low', R.FLIGHT_WORDS)}::INT AS has_flight,
             regexp_matches(low, '(^|{edge})({'|'.join(R.FOREIGN_COUNTRIES)})($|{edge})')::INT AS has_foreign_country,
             {S.any_of('low', R.ACCOMMODATION_WORDS)}::INT AS has_accommodation,
             {S.any_of('low', R.TRAVEL_DOCUMENT_WORDS)}::INT AS has_travel_docs, length(text)::INT AS text_length,
             t::DOUBLE / greatest(t + l, 1) AS travel_ratio
      FROM (SELECT *, {S.count_of('low', R.TRAVEL_KEYWORDS)} AS t, {S.count_of('low', R.LOCAL_KEYWORDS)} AS l
            FROM (SELECT *, lower(text) AS low FROM {source}))"""


@query("mlt_02_event_features", S.build(_features_sql("texts", "event_id"), ["texts"]))
def event_features(spark: SparkSession, sf: str) -> DataFrame:
    return TF.event_features(texts(spark, sf)).select("event_id", *TF.FEATURES)


@query("mlt_02_document_features", _features_sql("documents", "doc_id"))
def document_features(spark: SparkSession, sf: str) -> DataFrame:
    return TF.event_features(A.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", *TF.FEATURES)


@query("mlt_12_trigger_type", S.build(f"SELECT event_id, {S.TRIGGER} AS trigger_type FROM texts", ["texts"]))
def trigger_type(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("event_id", TF.trigger_type("text").alias("trigger_type"))


@query(
    "mlt_13_extract_destination",
    S.build(f"SELECT event_id, {S.destination('summary', 'location', 'description')} AS destination FROM texts", ["texts"]),
)
def extract_destination(spark: SparkSession, sf: str) -> DataFrame:
    return TF.with_destination(A.calendar_events(spark, sf)).select("event_id", "destination")


EVENT_DATE_TEXTS = ["yyyy-MM-dd", "yyyy-MM-dd'T09:00:00Z'", "dd/MM/yyyy", "d MMM yyyy", "MMMM d, yyyy"]


@query(
    "mlt_14_parse_event_date",
    S.build(
        """SELECT event_id, CASE event_id % 7 WHEN 5 THEN '1998-01-01' WHEN 6 THEN 'week ' || week(start_date)
                  ELSE strftime(start_date, '%Y-%m-%d') END AS date FROM calendar""",
        ["calendar"],
    ),
)
def parse_event_date(spark: SparkSession, sf: str) -> DataFrame:
    choice = F.col("event_id") % 7
    chain = F.when(choice == 5, F.lit(""))
    for i, pattern in enumerate(EVENT_DATE_TEXTS):
        chain = chain.when(choice == i, F.date_format("start_date", pattern))
    text = chain.otherwise(F.concat(F.lit("week "), F.weekofyear("start_date").cast("string")))
    rows = A.calendar_events(spark, sf).select("event_id", text.alias("text"))
    return T.with_event_date(rows, "text", "date", A.TODAY_TRAVEL).select("event_id", "date")


@query(
    "mlt_15_merge_away_periods",
    S.build(f"SELECT {_MERGED_KEY}, reason, trigger_type, confidence, destination, events FROM merged", ["merged"]),
)
def merge_away_periods(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


# --- model ----------------------------------------------------------------------


def training(spark: SparkSession, sf: str) -> DataFrame:
    return E.labeled_events(A.labeled_rows(spark, sf))


def fitted(spark: SparkSession, sf: str) -> TM.TravelModel:
    return TM.fit(training(spark, sf))


@query("mlt_03_tfidf", S.build(S.tfidf("texts", "event_id"), ["texts"]))
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = training(spark, sf)
    weights = TW.tfidf_rows(rows, TW.vocabulary(rows), "event_id")
    return weights.select("event_id", "term", F.round("weight", 8).alias("weight"))


@query("mlt_03_tfidf_documents", S.tfidf("documents", "doc_id"))
def tfidf_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same weights over free text."""
    rows = A.table(spark, sf, "documents")
    weights = TW.tfidf_rows(rows, TW.vocabulary(rows), "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 8).alias("weight"))


@query(
    "mlt_04_feature_matrix",
    S.build(
        f"SELECT event_id, ((SELECT count(*) FROM vocabulary) + {len(TF.FEATURES)})::INT AS dimensions, is_travel AS label FROM texts",
        ["vocabulary", "texts"],
    ),
)
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = training(spark, sf)
    wide = TM.assemble(rows, TM.fit_tfidf(rows))
    return wide.select("event_id", F.size(TM.vector_to_array("features")).alias("dimensions"), "label")


_SPLIT_SQL = """
  SELECT event_id, is_travel AS label, trigger_type,
         row_number() OVER (PARTITION BY is_travel ORDER BY md5('42:' || event_id))
           <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY is_travel)) AS is_test FROM calendar"""


@query("mlt_05_stratified_split", S.build(f"SELECT event_id, label, is_test FROM ({_SPLIT_SQL})", ["calendar"]))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return TM.stratified_split(training(spark, sf)).select("event_id", "label", "is_test")


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = stored(TM.stratified_split(training(spark, sf)))
    return parts.filter("not is_test"), parts.filter("is_test")


# Labels of these events follow from their texts, so a model that has learnt them predicts them on the test part.
@query(
    "mlt_06_train_travel_model",
    S.build(f"SELECT event_id, label, label AS prediction FROM ({_SPLIT_SQL}) WHERE is_test", ["calendar"]),
)
def train_travel_model(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    rows = stored(TM.distinct_rows(train, ["label"]))
    text = TM.fit_tfidf(rows)
    forest = TM.train_travel_model(stored(TM.assemble(rows, text).select("label", TM.COPIES, "features")))
    scored = TM.by_text(test, lambda texts: forest.transform(TM.assemble(texts, text)).select("text", "prediction"))
    return scored.select("event_id", "label", F.col("prediction").cast("int"))


@query(
    "mlt_07_train_trigger_model",
    S.build(
        f"""SELECT event_id, trigger_type, trigger_type AS predicted_trigger FROM ({_SPLIT_SQL})
            WHERE is_test AND label = 1 AND trigger_type <> ''""",
        ["calendar"],
    ),
)
def train_trigger_model(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    rows = stored(TM.distinct_rows(train, ["label", "trigger_type"]))
    text = TM.fit_tfidf(rows)
    model = TM.train_trigger_model(stored(TM.assemble(rows, text).select("label", "trigger_type", TM.COPIES, "features")))
    travel = test.filter((F.col("label") == 1) & (F.col("trigger_type") != ""))
    scored = TM.by_text(travel, lambda texts: model.transform(TM.assemble(texts, text)).select("text", "predicted_trigger"))
    return scored.select("event_id", "trigger_type", "predicted_trigger")


_EVALUATION_SQL = """
  WITH cells AS (SELECT quality AS a, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
  scores AS (SELECT c, coalesce((SELECT sum(n) FROM cells WHERE a = c), 0)::BIGINT AS support,
                    coalesce((SELECT sum(n) FROM cells WHERE p = c), 0)::BIGINT AS predicted,
                    coalesce((SELECT sum(n) FROM cells WHERE a = c AND p = c), 0)::BIGINT AS hits
             FROM (SELECT a AS c FROM cells UNION SELECT p FROM cells)),
  rates AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision,
                   CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM scores),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)
  SELECT 'class_' || c AS scope, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f
  UNION ALL
  SELECT 'weighted_avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
         round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM f
  UNION ALL
  SELECT 'accuracy', round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9),
         sum(support)::BIGINT FROM f"""


@query("mlt_08_evaluate_model", _EVALUATION_SQL)
def evaluate_model(spark: SparkSession, sf: str) -> DataFrame:
    metrics = TM.evaluate_model(A.table(spark, sf, "labels"), "quality", "toxic")
    return metrics.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "mlt_08_confusion_matrix",
    """SELECT quality AS label, count(*) FILTER (WHERE toxic = 0) AS predicted_0, count(*) FILTER (WHERE toxic = 1) AS predicted_1
       FROM labels GROUP BY quality""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return TM.confusion_matrix(A.table(spark, sf, "labels"), "quality", "toxic")


@query("mlt_09_stratified_folds", S.build("SELECT event_id, is_travel AS label, fold FROM folds", ["folds"]))
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return TM.stratified_folds(training(spark, sf)).select("event_id", "label", "fold")


@query(
    "mlt_09_fold_vocabulary",
    S.build(
        " UNION ALL ".join(
            f"SELECT {fold} AS fold, term, docs, round(idf, 9) AS idf FROM ({S.vocabulary('foldcounts', 'folds', f'fold <> {fold}')})"
            for fold in range(5)
        ),
        ["foldcounts", "folds"],
    ),
)
def fold_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    terms = TW.fold_vocabularies(TM.stratified_folds(training(spark, sf)), "fold", 5)
    return terms.select("fold", "term", "docs", F.round("idf", 9).alias("idf"))


# Labels of these events follow from their texts: a row is right if the other folds hold its text under its label.
@query(
    "mlt_09_cross_validate",
    S.build(
        """SELECT avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std
           FROM (SELECT fold, avg((everywhere > here)::INT) AS accuracy
                 FROM (SELECT fold, count(*) OVER (PARTITION BY text, is_travel) AS everywhere,
                              count(*) OVER (PARTITION BY text, is_travel, fold) AS here FROM folds) GROUP BY fold)""",
        ["folds"],
    ),
)
def cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    mean, deviation = TM.cross_validate(training(spark, sf))
    return spark.createDataFrame([(mean, deviation)], "accuracy_mean double, accuracy_std double")


@query("mlt_10_feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return TM.feature_importance(fitted(spark, sf), spark)


# What the model has learnt from the other events is judged on the test part: its periods are those of the labels.
_TEST_AWAY = f"SELECT * REPLACE ('high' AS confidence) FROM ({S.AWAY}) WHERE seq IN (SELECT event_id FROM ({_SPLIT_SQL}) WHERE is_test)"


@query(
    "mlt_11_predict_travel",
    S.build(
        f"SELECT {_MERGED_KEY}, reason, trigger_type, confidence, destination, events FROM merged",
        ["merged"],
        replace={"away": _TEST_AWAY},
    ),
)
def predict_travel(spark: SparkSession, sf: str) -> DataFrame:
    """Away periods predicted for events that training hasn't seen."""
    train, test = _split(spark, sf)
    unseen = texts(spark, sf).join(test.select("event_id"), "event_id", "left_semi")
    return TF.merge_away_periods(TF.travel_to_away(TM.fit(train).predict_travel(unseen), A.TODAY_TRAVEL))


@query(
    "snk_03_model_save_load",
    S.build(f"SELECT TRUE AS same, count(*) AS events FROM ({_SPLIT_SQL}) WHERE is_test", ["calendar"]),
)
def model_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Test events on which the saved and reloaded model answers as before; every run saves to a folder of its own."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/travel_model-{uuid.uuid4().hex}"
    train, test = _split(spark, sf)
    model = TM.fit(train)
    model.save(path)
    before = model.predict(test).select("event_id", F.col("prediction").alias("before"), "predicted_trigger")
    after = TM.TravelModel.load(path).predict(test).select(
        "event_id", F.col("prediction").alias("after"), F.col("predicted_trigger").alias("trigger_after")
    )
    same = (F.col("before") == F.col("after")) & (F.col("predicted_trigger") == F.col("trigger_after"))
    return before.join(after, "event_id").groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "snk_04_evaluation_report",
    S.build(
        f"""SELECT scope, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, support,
                  ((SELECT count(*) FROM ({S.vocabulary("traincounts", "trainrows")})) + {len(TF.FEATURES)})::INT AS total_features,
                  1.0::DOUBLE AS cv_accuracy_mean, 0.0::DOUBLE AS cv_accuracy_std
           FROM (SELECT scope, count(*) AS support FROM (
                   SELECT unnest(['class_' || label, 'weighted_avg', 'accuracy']) AS scope FROM ({_SPLIT_SQL}) WHERE is_test)
                 GROUP BY scope)""",
        ["traincounts"],
    ),
)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    model = TM.fit(train)
    return RP.evaluation_report(model.predict(test), model, cv=TM.cross_validate(train))


def travel_documents(spark: SparkSession, sf: str) -> DataFrame:
    events = E.events_in_horizon(A.calendar_events(spark, sf), A.TODAY_TRAVEL, 6)
    subscriptions = A.local_subscriptions(spark, sf)
    recs = recommendations(spark, sf)
    return RP.travel_report(
        events, E.events_preview(events), merged(spark, sf), subscriptions, recs, TV.total_savings(recs),
        TV.local_split(subscriptions),
    )


@query(
    "snk_06_travel_report",
    S.build(
        """SELECT user_id, '' AS month, coalesce(e.n, 0)::BIGINT AS events_scanned, least(coalesce(e.n, 0), 15)::BIGINT AS events_preview,
                  coalesce(m.n, 0)::BIGINT AS away_periods, coalesce(s.n, 0)::BIGINT AS processed_subscriptions,
                  s.names AS subscription_names, 0::BIGINT AS recommendations, NULL AS recommended, coalesce(r.saved, 0)::DOUBLE AS total_savings,
                  coalesce(s.local, 0)::BIGINT AS local_count, coalesce(s.n - s.local, 0)::BIGINT AS portable_count
           FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE is_local) AS local, string_agg(name, ',' ORDER BY name) AS names
                 FROM locals GROUP BY user_id) s
           FULL JOIN (SELECT user_id, count(*) AS n FROM merged GROUP BY user_id) m USING (user_id)
           FULL JOIN (SELECT user_id, count(*) AS n FROM calendar WHERE start_date < DATE '1998-01-01' + 182
                        AND (end_date > DATE '1998-01-01' OR start_date >= DATE '1998-01-01') GROUP BY user_id) e USING (user_id)
           LEFT JOIN (SELECT user_id, sum(CAST(round_even(net_savings, 2) AS DECIMAL(18, 2))) AS saved
                      FROM recommendations GROUP BY user_id) r USING (user_id)
           UNION ALL
           SELECT user_id, strftime(CAST(departure_date AS DATE), '%Y-%m'), 0, 0, 0, 0, NULL, count(*),
                  string_agg(subscription, ',' ORDER BY subscription, departure_date), 0, 0, 0
           FROM recommendations GROUP BY ALL""",
        ["locals", "merged", "calendar", "recommendations"],
    ),
)
def travel_report(spark: SparkSession, sf: str) -> DataFrame:
    lists = ["events_preview", "away_periods", "processed_subscriptions", "recommendations"]
    numbers = ["events_scanned", "total_savings", "local_count", "portable_count"]
    return travel_documents(spark, sf).select(
        "user_id",
        "month",
        *[F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c) for c in lists],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.array_join("processed_subscriptions.name", ",").alias("subscription_names"),
        F.array_join("recommendations.subscription", ",").alias("recommended"),
    )
