"""Queries over labelled texts: distributions, metrics and the trained classifier."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as ev, ranking, scoring, training
from ..schemas import SENTIMENT
from ..session import fresh_path
from . import derived as d
from .derived import sql_hash
from .registry import query

def _labelled(spark: SparkSession, sf: str, part: str) -> DataFrame:
    split = training.train_test_split(d.labelled_texts(spark, sf).drop("split"), "doc_id")
    return split.filter(F.col("split") == part).select("doc_id", "text", "y")


def _model(spark: SparkSession, sf: str) -> PipelineModel:
    """A model trained on the training rows of a data folder."""
    return training.train_model(_labelled(spark, sf, "train"))


@query(
    "label_distribution",
    """SELECT split, label, count(*) AS count,
              round_even(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 1) AS percentage
       FROM gold GROUP BY split, label""",
    ("gold",),
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ev.label_distribution(d.gold(spark, sf).withColumn("label", d.code_label(F.col("y"))))


@query("split_sizes", "SELECT split, count(*) AS rows FROM gold GROUP BY split", ("gold",))
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return ev.split_sizes(d.gold(spark, sf))


@query(
    "train_test_split",
    f"SELECT doc_id, CASE WHEN {sql_hash('doc_id')} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents",
)
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return training.train_test_split(d.table(spark, sf, "documents").select("doc_id"), "doc_id")


_PER_CLASS = """SELECT c, hit, actual, predicted, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS p,
        CASE WHEN actual > 0 THEN hit / actual ELSE 0.0 END AS r FROM (
            SELECT c, count(*) FILTER (y = c AND yhat = c) AS hit, count(*) FILTER (y = c) AS actual,
                   count(*) FILTER (yhat = c) AS predicted
            FROM gold, (VALUES (0), (1), (2)) AS k(c) GROUP BY c)"""
_SCORED = f"SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM ({_PER_CLASS})"


@query(
    "classification_metrics",
    f"""SELECT round_even(sum(hit) / sum(actual), 6) AS accuracy, round_even(sum(p * actual) / sum(actual), 6) AS precision,
               round_even(sum(r * actual) / sum(actual), 6) AS recall, round_even(sum(f * actual) / sum(actual), 6) AS f1,
               CAST(sum(actual) AS BIGINT) AS n FROM ({_SCORED})""",
    ("gold",),
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.classification_metrics(d.gold(spark, sf))


@query(
    "classification_report",
    f"""SELECT CAST(c AS VARCHAR) AS label, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(f, 6) AS f1,
               actual AS support FROM ({_SCORED})
        UNION ALL SELECT 'macro avg', round_even(avg(p), 6), round_even(avg(r), 6), round_even(avg(f), 6),
               CAST(sum(actual) AS BIGINT) FROM ({_SCORED})
        UNION ALL SELECT 'weighted avg', round_even(sum(p * actual) / sum(actual), 6), round_even(sum(r * actual) / sum(actual), 6),
               round_even(sum(f * actual) / sum(actual), 6), CAST(sum(actual) AS BIGINT) FROM ({_SCORED})""",
    ("gold",),
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.classification_report(d.gold(spark, sf))


@query(
    "confusion_matrix",
    """SELECT a AS actual, p AS predicted, count(*) FILTER (y = a AND yhat = p) AS count,
              round_even(count(*) FILTER (y = a AND yhat = p) / count(*) * 100, 2) AS percentage
       FROM gold, (VALUES (0), (1), (2)) AS k(a), (VALUES (0), (1), (2)) AS m(p) GROUP BY a, p""",
    ("gold",),
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(d.gold(spark, sf))


@query("per_class_accuracy", f"SELECT c AS label, round_even(r, 6) AS accuracy FROM ({_SCORED})", ("gold",))
def per_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.per_class_accuracy(d.gold(spark, sf))


def _two_labellers(spark: SparkSession, sf: str) -> DataFrame:
    gold = d.gold(spark, sf)
    model = gold.select("doc_id", F.upper(d.code_label(F.col("yhat"))).alias("label_a"))
    baseline = d.labelled_texts(spark, sf).select("doc_id", F.col("label").alias("label_b"))
    return ev.compare_labels(model, baseline, "doc_id")


@query(
    "model_agreement",
    """SELECT doc_id, upper(CASE yhat WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END) AS label_a,
              label AS label_b, y = yhat AS agree FROM labelled_texts""",
    ("gold", "labelled_texts"),
)
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _two_labellers(spark, sf)


@query(
    "agreement_samples",
    """SELECT doc_id, label AS label_b, y = yhat AS agree FROM labelled_texts ORDER BY doc_id LIMIT 6""",
    ("gold", "labelled_texts"),
)
def agreement_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_rows(_two_labellers(spark, sf), "doc_id").select("doc_id", "label_b", "agree")


@query(
    "agreement_rate",
    """SELECT count(*) AS n, count(*) FILTER (y = yhat) AS agreed, round_even(count(*) FILTER (y = yhat) / count(*), 6) AS rate
       FROM labelled_texts""",
    ("gold", "labelled_texts"),
)
def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    return ev.agreement_rate(_two_labellers(spark, sf))


@query(
    "retrain_flags",
    """SELECT strftime(predicted_at, '%Y-%m-%d') AS day, count(*) AS n,
              round_even(count(*) FILTER (y = yhat) / count(*), 6) AS accuracy,
              count(*) FILTER (y = yhat) / count(*) < 0.8 AS retrain
       FROM gold GROUP BY 1""",
    ("gold",),
)
def retrain_flags(spark: SparkSession, sf: str) -> DataFrame:
    return ev.retrain_flags(d.gold(spark, sf), "predicted_at")


@query(
    "accuracy_drift",
    """SELECT day, n, accuracy, (s - least(min(s) OVER w, 0)) / 1000000 AS shortfall, s - least(min(s) OVER w, 0) >= 250000 AS drift
       FROM (SELECT *, CAST(sum(780000 - CAST(round(accuracy * 1000000) AS BIGINT)) OVER (ORDER BY day) AS BIGINT) AS s FROM (
                SELECT strftime(predicted_at, '%Y-%m-%d') AS day, count(*) AS n,
                       round_even(count(*) FILTER (y = yhat) / count(*), 6) AS accuracy
                FROM gold GROUP BY 1))
       WINDOW w AS (ORDER BY day)""",
    ("gold",),
)
def accuracy_drift(spark: SparkSession, sf: str) -> DataFrame:
    return ev.accuracy_drift(d.gold(spark, sf), "predicted_at")


@query(
    "train_history",
    """SELECT count(loss) AS train_rows, count(eval_loss) AS eval_rows, min(loss) AS lowest_loss,
              (SELECT step FROM training_log WHERE eval_loss IS NOT NULL ORDER BY eval_accuracy DESC, step LIMIT 1) AS best_step,
              max(eval_accuracy) AS best_accuracy FROM training_log""",
    ("training_log",),
)
def train_history(spark: SparkSession, sf: str) -> DataFrame:
    return ev.train_history(d.training_log(spark, sf))


@query(
    "train_lr_vocabulary",
    f"""SELECT term FROM terms WHERE doc_id IN (SELECT doc_id FROM labelled_texts WHERE {sql_hash('doc_id')} % 100 >= 20)
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000""",
    ("gold", "labelled_texts", "terms"),
)
def train_lr_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that the trained model weighs."""
    return spark.createDataFrame([(term,) for term in _model(spark, sf).stages[0].vocabulary], "term string")


def _known_first(spark: SparkSession, sf: str):
    """A scorer that knows the label of the texts a model has been run on, and of no other."""
    known = d.gold(spark, sf).select(F.col("doc_id").cast("string").alias("_id"), "yhat")
    nothing = F.lit(None).cast("double")

    def scorer(posts: DataFrame) -> DataFrame:
        found = posts.join(known, F.col("id") == F.col("_id"), "left")
        label, sure = d.code_label(F.col("yhat")), F.when(F.col("yhat").isNotNull(), 1.0)
        fields = {"label": label, "polarity": nothing, "subjectivity": nothing, "confidence": sure}
        parts = [value.alias(name) for name, value in fields.items()]
        none = F.lit(None).cast(SENTIMENT["probabilities"].dataType).alias("probabilities")
        return found.withColumn("sentiment", F.struct(*parts, none)).select(*posts.columns, "sentiment")

    return scorer


@query(
    "score_with_fallback",
    """SELECT id AS post_id, platform, coalesce(g.label, CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END) AS label,
              g.label IS NULL AS by_lexicon
       FROM posts LEFT JOIN (SELECT doc_id, CASE yhat WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label FROM gold) g USING (doc_id)
       LEFT JOIN (SELECT doc_id, sum(polarity_points) / count(*) / 100 AS p FROM said JOIN lexicon USING (token) GROUP BY doc_id) USING (doc_id)""",
    ("posts", "gold", "said", "lexicon"),
)
def score_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The model's label where there is one, else the lexicon's."""
    posts = d.long_posts(spark, sf).select("id", "platform", "text", "created_at")
    scorer = scoring.with_fallback(_known_first(spark, sf), scoring.lexicon_scorer(d.corpus_lexicon(spark, sf)))
    return scoring.score_posts(posts, scorer, d.AS_OF).select(
        "post_id", "platform", "sentiment.label", F.col("sentiment.polarity").isNotNull().alias("by_lexicon")
    )


@query("train_lr")
def train_lr(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vocabulary term with its weight for every class."""
    model = _model(spark, sf)
    weights = model.stages[-1].coefficientMatrix.toArray().T.tolist()
    rows = [(term, *line) for term, line in zip(model.stages[0].vocabulary, weights)]
    return spark.createDataFrame(rows, "term string, negative double, neutral double, positive double")


_TEST_ROWS = f"FROM labelled_texts WHERE {sql_hash('doc_id')} % 100 < 20"


@query(
    "predict_lr",
    f"SELECT doc_id, TRUE AS sums_to_one, TRUE AS confident_in_label, TRUE AS known_label {_TEST_ROWS}",
    ("gold", "labelled_texts"),
)
def predict_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Properties every prediction must have, for each held-out text."""
    scored = training.predict(_model(spark, sf), _labelled(spark, sf, "test"))
    p = "sentiment.probabilities"
    total = F.col(f"{p}.negative") + F.col(f"{p}.neutral") + F.col(f"{p}.positive")
    own = F.create_map(*[x for n in ("negative", "neutral", "positive") for x in (F.lit(n), F.col(f"{p}.{n}"))])
    return scored.select(
        "doc_id",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (own[F.col("sentiment.label")] == F.col("sentiment.confidence")).alias("confident_in_label"),
        F.col("sentiment.label").isin("negative", "neutral", "positive").alias("known_label"),
    )


@query("holdout_metrics")
def holdout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return training.holdout_metrics(_model(spark, sf), _labelled(spark, sf, "test"))


@query("model_roundtrip", f"SELECT count(*) AS rows, 0 AS differing {_TEST_ROWS}", ("gold", "labelled_texts"))
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    model, path = _model(spark, sf), fresh_path(spark, "model")
    training.save_model(model, path)
    return training.changed_predictions(model, training.load_model(path), _labelled(spark, sf, "test"))


@query("model_card")
def model_card(spark: SparkSession, sf: str) -> DataFrame:
    model, path = _model(spark, sf), fresh_path(spark, "model")
    training.save_model(model, path)
    metrics = training.holdout_metrics(model, _labelled(spark, sf, "test"))
    return training.model_card(spark, "tfidf-logistic", d.AS_OF, metrics, training.stored_bytes(spark, path))
