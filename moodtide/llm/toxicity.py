"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.sizing import small_table
from .common import id_remainder, plain_text, written
from .pieces import exact_ids

GRAMS = (3, 4, 5)
BUCKETS = 1 << 20
#: Most labelled rows used per class (those with the smallest hash of their id), and most features kept.
PER_CLASS = 5_000
FEATURES = 5_000
#: Characters turned into n-grams at once.
SLICE = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """The hash buckets of a text's lower-case character n-grams, spaces around it included, in parts of bounded size."""
    whole = " " + " ".join(text.lower().split()) + " "
    for at in range(0, max(len(whole) - 1, 1), SLICE):
        codes = np.frombuffer(whole[at:at + SLICE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolled, found = mixed[:0], []
        for n in range(1, max(GRAMS) + 1):
            size = codes.size - n + 1
            if size <= 0:
                break
            rolled = mixed[:size] if n == 1 else (rolled[:size] * np.uint64(0xD6E8FEB86659FD93)) ^ mixed[n - 1:]
            if n in GRAMS:
                h = rolled * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)
                found.append((h >> np.uint64(64 - 20)).astype(np.int32))
        yield np.concatenate(found) if found else np.zeros(0, np.int32)


def distinct_buckets(text: str, of_bucket: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, or the distinct features they stand for."""
    out = np.zeros(0, np.int32)
    for part in gram_buckets(text):
        if of_bucket is not None:
            part = of_bucket[part]
            part = part[part >= 0]
        out = np.union1d(out, part)
    return out


@dataclass
class Classifier:
    """Selected buckets with their ratio and weight, and the intercept."""

    buckets: np.ndarray
    scaled: np.ndarray
    intercept: float

    def score(self, text: str, of_bucket: np.ndarray) -> float:
        total = self.intercept + float(self.scaled[distinct_buckets(text, of_bucket)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def lookup(buckets: np.ndarray) -> np.ndarray:
    table = np.full(BUCKETS, -1, np.int32)
    table[buckets] = np.arange(buckets.size)
    return table


def labelled_sample(labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5) -> tuple[DataFrame, float]:
    """Training ids with their label, at most ``per_class`` of each, and the share of label 1 among all training labels.

    Held out are ids with crc32(id as text) mod ``modulus`` 0. An id with several labels counts once, with the
    highest; null ids and labels other than 0 and 1 are left out.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_remainder(modulus) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    total = sum(counts.values())
    return taken[0].unionByName(taken[1]), (counts.get(1, 0) / total if total else 0.0)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, smoothing: float = 1.0) -> Classifier:
    """Log-count ratios of n-gram presence and a logistic regression on the scaled presence.

    The sample is bounded by ``2 * per_class`` rows, so it is small enough to be sent to the scan of the documents
    and to be fitted in one place; scoring reads everything. Of rows that repeat an id the least text is taken.
    What counts is the labelled texts that are there: if all are of one class, that is always the answer; if there are
    none, no text is toxic.
    """
    sample, share = labelled_sample(labels, per_class)
    spark = docs.sparkSession
    picked = sample.toPandas()
    y_all = picked["y"].to_numpy(np.float64)
    if not y_all.size:
        return _constant(0.0)
    chosen = small_table(spark, [(int(i), int(y)) for i, y in zip(picked["doc_id"], picked["y"])], ["_id", "y"])
    own = docs.select("doc_id", plain_text().alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = written(own.groupBy("doc_id", "y").agg(F.min("_text").alias("_text")), "toxicity-sample")
    found = {row["y"]: row["count"] for row in texts.groupBy("y").count().collect()}
    if len(found) < 2:
        return _constant(1.0 if 1 in found else 0.0)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for text, y in zip(batch["_text"], batch["y"]):
                seen[y, distinct_buckets(text)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        if at.size:
            yield pd.DataFrame({"bucket": at, "n0": seen[0, at], "n1": seen[1, at]})

    counted = texts.mapInPandas(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n1, n0 = float(found[1]), float(found[0])
    p1, p0 = (F.col("n1") + smoothing) / (n1 + 2 * smoothing), (F.col("n0") + smoothing) / (n0 + 2 * smoothing)
    ratio = F.log(p1 / p0)
    best = (
        counted.filter(F.col("n0") + F.col("n1") >= 3)
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(F.col("n0") / n0 + F.col("n1") / n1)).alias("signal"))
        .orderBy(F.desc("signal"), "bucket")
        .limit(features)
        .toPandas()
    )
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_bucket = lookup(buckets)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "f": [distinct_buckets(t, of_bucket).astype(np.uint16).tobytes() for t in batch["_text"]]})

    rows = texts.mapInPandas(presence, "doc_id long, y int, f binary").toPandas().sort_values("doc_id")  # at most the sample
    y = rows["y"].to_numpy(np.float64)
    weights, intercept = _regression([np.frombuffer(f, np.uint16).astype(np.int64) for f in rows["f"]], y, ratios)
    if 0 < share < 1:
        intercept += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Classifier(buckets, weights * ratios, float(intercept))


def _constant(share: float) -> Classifier:
    """A classifier that gives every text the same answer."""
    return Classifier(np.zeros(0, np.int64), np.zeros(0), 30.0 if share else -30.0)


def _regression(found: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, steps: int = 100, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence, by full gradient steps with momentum and per-weight rates (Adam)."""
    at = np.concatenate([*found, np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(found)), [f.size for f in found])
    value = ratios[at]
    w = np.zeros(ratios.size + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(row, value * w[at], len(found)) + w[-1]
        wrong = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) / len(found)
        slope = np.append(np.bincount(at, value * wrong[row], ratios.size), wrong.sum())
        slope[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, model: Classifier, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from the text alone (null: empty).

    Repeated rows give repeated rows. A null id is not held out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_bucket = lookup(model.buckets)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(t, of_bucket) for t in batch["_text"]]})

    texts = docs.select("doc_id", plain_text().alias("_text"))
    return exact_ids(texts, run, "score double").select(
        "doc_id", (id_remainder(modulus) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def kept_clean(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under the threshold, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_bucket = lookup(model.buckets)
        for batch in texts:
            yield pd.Series([model.score(t, of_bucket) for t in batch], dtype="float64")

    return docs.filter(score(plain_text()) < threshold)
