"""Label distributions and classifier metrics, all folded from one small count table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timing
from ..functions.labels import percentage
from ..settings import RETRAIN_ACCURACY

CLASSES = (0, 1, 2)


def label_distribution(labelled: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows of each label in each split and their share of the split, one decimal."""
    counts = labelled.groupBy(split, label).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(split))
    return counts.withColumn("percentage", percentage(F.col("count"), total, 1))


def split_sizes(labelled: DataFrame, split: str = "split") -> DataFrame:
    return labelled.groupBy(split).agg(F.count("*").alias("rows"))


def _confusion_row(predicted: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat",
                   classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row per group with a struct of counts for every pair of actual and predicted class."""
    cells = [
        F.count_if((F.col(y) == a) & (F.col(yhat) == p)).alias(_cell(a, p)) for a in classes for p in classes
    ]
    return predicted.groupBy(*by).agg(*cells, F.count("*").alias("n"))


def _cell(actual: int, predicted: int) -> str:
    return f"c{actual}_{predicted}"


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _class_scores(c: int, classes: Sequence[int]) -> dict[str, Column]:
    hit = F.col(_cell(c, c))
    actual = _sum([F.col(_cell(c, p)) for p in classes])
    predicted = _sum([F.col(_cell(a, c)) for a in classes])
    precision, recall = _ratio(hit, predicted), _ratio(hit, actual)
    return {
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * precision * recall, precision + recall),
        "support": actual,
    }


def _averaged(name: str, classes: Sequence[int], weighted: bool) -> Column:
    scores = [_class_scores(c, classes) for c in classes]
    if weighted:
        total = _sum([s["support"] for s in scores])
        return _ratio(_sum([s[name] * s["support"] for s in scores]), total)
    return _sum([s[name] for s in scores]) / len(classes)


def classification_metrics(predicted: DataFrame, classes: Sequence[int] = CLASSES, digits: int = 6) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    hits = _sum([F.col(_cell(c, c)) for c in classes])
    return _confusion_row(predicted, classes=classes).select(
        F.bround(_ratio(hits, F.col("n")), digits).alias("accuracy"),
        *[F.bround(_averaged(m, classes, True), digits).alias(m) for m in ("precision", "recall", "f1")],
        "n",
    )


def classification_report(predicted: DataFrame, classes: Sequence[int] = CLASSES, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, then their plain and weighted means."""
    total = _sum([_class_scores(c, classes)["support"] for c in classes])

    def line(name: str, scores: dict[str, Column]) -> Column:
        measures = [F.bround(scores[m], digits).alias(m) for m in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("label"), *measures, scores["support"].cast("bigint").alias("support"))

    lines = [line(str(c), _class_scores(c, classes)) for c in classes]
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        means = {m: _averaged(m, classes, weighted) for m in ("precision", "recall", "f1")}
        lines.append(line(name, {**means, "support": total}))
    return _confusion_row(predicted, classes=classes).select(F.inline(F.array(*lines)))


def confusion_matrix(predicted: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Count and share of all rows for every pair of classes, empty pairs included."""
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            F.col(_cell(a, p)).alias("count"),
            percentage(F.col(_cell(a, p)), F.col("n")).alias("percentage"),
        )
        for a in classes
        for p in classes
    ]
    return _confusion_row(predicted, classes=classes).select(F.inline(F.array(*cells)))


def per_class_accuracy(predicted: DataFrame, classes: Sequence[int] = CLASSES, digits: int = 6) -> DataFrame:
    """Share of each actual class that was predicted as itself."""
    lines = [
        F.struct(F.lit(c).alias("label"), F.bround(_class_scores(c, classes)["recall"], digits).alias("accuracy"))
        for c in classes
    ]
    return _confusion_row(predicted, classes=classes).select(F.inline(F.array(*lines)))


def compare_labels(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two labellers side by side with a mark of agreement; both have one row per key."""
    return left.join(right, key).withColumn("agree", F.lower("label_a") == F.lower("label_b"))


def agreement_rate(compared: DataFrame, digits: int = 6) -> DataFrame:
    return compared.agg(
        F.count("*").alias("n"),
        F.count_if("agree").alias("agreed"),
        F.bround(F.avg(F.col("agree").cast("double")), digits).alias("rate"),
    )


def retrain_flags(predicted: DataFrame, time: str, min_accuracy: float = RETRAIN_ACCURACY,
                  digits: int = 6) -> DataFrame:
    """Accuracy per day and whether it has fallen below what calls for retraining."""
    daily = predicted.groupBy(F.to_date(time).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == F.col("yhat")).alias("hits")
    )
    accuracy = F.col("hits") / F.col("n")
    return daily.select(
        timing.day_text(F.col("day")).alias("day"), "n", F.bround(accuracy, digits).alias("accuracy"), (accuracy < min_accuracy).alias("retrain")
    )


def accuracy_drift(predicted: DataFrame, time: str, target: float = RETRAIN_ACCURACY, slack: float = 0.02,
                   limit: float = 0.25, digits: int = 6) -> DataFrame:
    """Daily accuracy with the cumulative sum that detects a lasting fall, and whether it calls for retraining.

    The sum of a day is that of all shortfalls below ``target`` less ``slack`` so far, above the lowest it has been: a
    running sum less its running minimum (zero at the start). It rises while accuracy stays short, returns to zero
    when accuracy is back, and flags a drift at ``limit``. Days are few, so one task sums them.
    """
    daily = predicted.groupBy(F.to_date(time).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == F.col("yhat")).alias("hits")
    )
    accuracy = F.bround(F.col("hits") / F.col("n"), digits)
    scale = 10**digits
    short = F.lit(round((target - slack) * scale)) - F.round(F.col("accuracy") * scale).cast("long")
    in_order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    summed = daily.filter(F.col("day").isNotNull()).withColumn("accuracy", accuracy).withColumn("_sum", F.sum(short).over(in_order))
    lowest = F.least(F.min("_sum").over(in_order), F.lit(0))
    risen = summed.withColumn("_risen", F.col("_sum") - lowest)
    return risen.select(
        timing.day_text(F.col("day")).alias("day"),
        "n",
        "accuracy",
        (F.col("_risen") / scale).alias("shortfall"),
        (F.col("_risen") >= round(limit * scale)).alias("drift"),
    )


def train_history(log: DataFrame) -> DataFrame:
    """Training and evaluation records told apart, counted, and the best evaluated step.

    The step with the highest accuracy wins, the earliest one among equals.
    """
    best = F.max(F.when(F.col("eval_loss").isNotNull(), F.struct("eval_accuracy", (-F.col("step")).alias("back"))))
    folded = log.agg(
        F.count("loss").alias("train_rows"),
        F.count("eval_loss").alias("eval_rows"),
        F.min(F.when(F.col("loss").isNotNull(), F.col("loss"))).alias("lowest_loss"),
        best.alias("best"),
    )
    return folded.select(
        "train_rows",
        "eval_rows",
        "lowest_loss",
        (-F.col("best.back")).alias("best_step"),
        F.col("best.eval_accuracy").alias("best_accuracy"),
    )
