"""The TF-IDF and logistic-regression classifier as a Spark ML pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import in_test_split
from ..functions.labels import code_label, probability_struct
from ..schemas import SENTIMENT
from ..session import kept_table
from ..settings import LABEL_CODES, VOCABULARY_SIZE
from .evaluation import classification_metrics
from .features import frequent_terms_of, model_words, terms
from .scoring import Scorer


def train_test_split(df: DataFrame, key: str, percent: int = 20) -> DataFrame:
    """A ``split`` column that depends on the key alone, whatever the partitioning."""
    return df.withColumn("split", F.when(in_test_split(F.col(key), percent), "test").otherwise("train"))


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """The terms of each text beside it.

    Words are a column of their own: ``terms`` names them five times, mostly inside a lambda, where they would be cut
    again each time.
    """
    cut = df.withColumn("_said", model_words(F.col(text)))
    return cut.withColumn("terms", terms(F.col("_said"))).drop("_said")


def train_model(labelled: DataFrame, size: int = VOCABULARY_SIZE, strength: float = 1.0,
                max_iterations: int = 100, features_from: DataFrame | None = None) -> PipelineModel:
    """A model fitted on rows with ``text`` and class code ``y``.

    The vocabulary and weights come from the training rows, or from ``features_from`` where
    the caller wants them from all rows; of terms said equally often the first by code points are taken. ``strength`` is the inverse of the L2 penalty. The
    driver holds the vocabulary and one coefficient per class and term, never rows. Texts are cut to words once, into a
    written table; only their term vectors are kept while the model is fitted.
    """
    rows = kept_table(labelled.select(model_words(F.col("text")).alias("said"), "y"), "tokens")
    corpus = rows if features_from is None else kept_table(features_from.select(model_words(F.col("text")).alias("said")), "tokens")
    said = frequent_terms_of(corpus, size).collect()  # at most ``size`` terms
    counter = CountVectorizerModel.from_vocabulary([row.term for row in said] or [""], inputCol="terms", outputCol="tf")
    counted = counter.transform(rows.select(terms(F.col("said")).alias("terms"), "y")).select("tf", "y").persist()
    try:
        whole = counted if features_from is None else counter.transform(corpus.select(terms(F.col("said")).alias("terms")))
        weight = IDF(inputCol="tf", outputCol="_idf").fit(whole)
        scaling = Vectors.dense(weight.idf.toArray() + 1.0)
        stages = [
            ElementwiseProduct(scalingVec=scaling, inputCol="tf", outputCol="weighted"),
            Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
        ]
        prepared = PipelineModel(stages=stages).transform(counted)
        classifier = LogisticRegression(
            featuresCol="features",
            labelCol="y",
            family="multinomial",
            regParam=1.0 / (strength * counted.count()),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iterations,
        ).fit(prepared)
        return PipelineModel(stages=[counter, *stages, classifier])
    finally:
        counted.unpersist()


def classified(model: PipelineModel, cut: DataFrame) -> DataFrame:
    """The sentiment struct with class probabilities beside rows with their terms."""
    scored = model.transform(cut).withColumn("_p", vector_to_array("probability"))
    sentiment = F.struct(
        code_label(F.col("prediction").cast("int")).alias("label"),
        F.lit(None).cast("double").alias("polarity"),
        F.lit(None).cast("double").alias("subjectivity"),
        F.array_max("_p").alias("confidence"),
        probability_struct(F.col("_p")).cast(SENTIMENT["probabilities"].dataType).alias("probabilities"),
    )
    return scored.withColumn("sentiment", sentiment).select(*cut.columns, "sentiment")


def predict(model: PipelineModel, posts: DataFrame) -> DataFrame:
    """The sentiment struct with class probabilities beside every post."""
    return classified(model, with_terms(posts)).select(*posts.columns, "sentiment")


def changed_predictions(first: PipelineModel, second: PipelineModel, posts: DataFrame) -> DataFrame:
    """How many posts there are, and how many the two models say anything different of.

    Both classify the terms of the same row, so texts are cut once and nothing is joined.
    """
    before = classified(first, with_terms(posts)).withColumnRenamed("sentiment", "_before")
    both = classified(second, before)
    differ = ~F.col("_before").eqNullSafe(F.col("sentiment"))
    return both.agg(F.count("*").alias("rows"), F.count_if(differ).cast("int").alias("differing"))


def model_scorer(model: PipelineModel) -> Scorer:
    return lambda posts: predict(model, posts)


def predicted_classes(model: PipelineModel, labelled: DataFrame) -> DataFrame:
    """Actual and predicted class codes beside the labelled rows."""
    codes = F.create_map(*[F.lit(part) for pair in LABEL_CODES.items() for part in pair])
    return predict(model, labelled).withColumn("yhat", codes[F.col("sentiment.label")])


def holdout_metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    return classification_metrics(predicted_classes(model, test))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_card(spark: SparkSession, name: str, created: str, metrics: DataFrame, size_bytes: int) -> DataFrame:
    """One row that describes a model: name, label map, date, test metrics and stored size."""
    label_map = F.to_json(F.create_map(*[F.lit(part) for pair in LABEL_CODES.items() for part in pair]))
    return metrics.select(
        F.lit(name).alias("model"),
        label_map.alias("label_map"),
        F.lit(created).alias("created"),
        "accuracy",
        "f1",
        F.lit(size_bytes).cast("bigint").alias("size_bytes"),
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files under a path, summed from the file listing."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()["size"]
