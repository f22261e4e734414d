import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moodtide.functions.labels import percentage, polarity_label
from moodtide.operators import ranking, summary, trends

AS_OF = "2024-01-31 00:00:00"
SCHEMA = "post_id string, platform string, sentiment struct<label: string, confidence: double>, processed_at timestamp_ntz"


def results(spark, rows):
    """Rows of (id, platform, label or None or 'missing', confidence, time)."""
    plain = spark.createDataFrame(rows, "post_id string, platform string, label string, confidence double, at string")
    sentiment = F.when(F.col("label").isNull() | (F.col("label") != "missing"), F.struct("label", "confidence"))
    return plain.select("post_id", "platform", sentiment.alias("sentiment"), F.col("at").cast("timestamp_ntz").alias("processed_at"))


def shares(df):
    return {row.label: (row["count"], row.percentage, row.total) for row in df.collect()}


NOON = "2024-01-30 12:00:00"


def test_empty_input_gives_zeros(spark):
    empty = results(spark, []).limit(0)
    assert shares(summary.sentiment_summary(empty, AS_OF)) == {n: (0, 0.0, 0) for n in ("positive", "neutral", "negative")}
    assert summary.batch_stats(empty).first().asDict() == {"positive": 0.0, "neutral": 0.0, "negative": 0.0, "total": 0}
    assert summary.analyzer_summary(empty).first().total == 0
    assert {row.total for row in summary.overview_stats(empty, AS_OF).collect()} == {0}
    assert summary.platform_breakdown(empty, AS_OF).count() == 0


def test_the_three_summaries_differ_on_odd_labels(spark):
    odd = results(spark, [("1", "twitter", "positive", 0.5, NOON), ("2", "twitter", None, 0.5, NOON), ("3", "twitter", "mixed", 0.5, NOON)])
    stored = shares(summary.sentiment_summary(odd, AS_OF))
    assert stored["positive"] == (1, 33.33, 3) and stored["mixed"] == (1, 33.33, 3) and stored[None] == (1, 33.33, 3)
    assert summary.batch_stats(odd).first().asDict() == {"positive": 50.0, "neutral": 50.0, "negative": 0.0, "total": 2}
    with pytest.raises(PySparkException, match="unknown label"):
        summary.analyzer_summary(odd).collect()


def test_halves_round_to_even(spark):
    got = spark.range(1).select(percentage(F.lit(1), F.lit(32)).alias("a"), percentage(F.lit(3), F.lit(0)).alias("b")).first()
    assert (got.a, got.b) == (3.12, 0.0)


def test_threshold_is_strict(spark):
    values = spark.createDataFrame([(-0.1,), (0.1,), (0.1000001,), (-0.2,)], "p double")
    assert [r[0] for r in values.select(polarity_label(F.col("p"))).collect()] == ["neutral", "neutral", "positive", "negative"]


def test_window_edge_is_inside_and_null_time_outside(spark):
    rows = [("1", "x", "positive", 0.5, "2024-01-30 00:00:00"), ("2", "x", "positive", 0.5, "2024-01-29 23:59:59"), ("3", "x", "positive", 0.5, None)]
    assert shares(summary.sentiment_summary(results(spark, rows), AS_OF))["positive"] == (1, 100.0, 1)


def test_overview_counts_other_platforms_only_overall(spark):
    rows = [("1", "twitter", "positive", 0.5, NOON), ("2", "forum", "negative", 0.5, NOON), ("3", None, "neutral", 0.5, NOON)]
    got = {(r.scope, r.label): r["count"] for r in summary.overview_stats(results(spark, rows), AS_OF).collect()}
    assert got[("overall", "negative")] == 1 and got[("overall", "neutral")] == 1
    assert len(got) == 12 and sum(n for (scope, _), n in got.items() if scope != "overall") == 1


def test_ties_are_broken_by_id(spark):
    rows = [(str(i), "x", "positive", 0.5, NOON) for i in (3, 1, 2)]
    assert [r.post_id for r in ranking.top_posts(results(spark, rows), "positive", limit=2).collect()] == ["1", "2"]


@pytest.mark.parametrize("k", [3, 40])
def test_top_k_beyond_the_threshold_is_the_same(spark, k):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        rows = spark.range(500).select((F.col("id") % 3 % 2).alias("g"), F.hash("id").alias("v"), "id")
        got = ranking.top_k_per_group(rows, ["g"], [F.col("v").desc(), F.col("id").asc()], k).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    everything = rows.collect()
    want = set()
    for g in (0, 1):
        own = sorted((r for r in everything if r.g == g), key=lambda r: (-r.v, r.id))
        want |= {r.id for r in own[:k]}
    assert {r.id for r in got} == want and len(got) == 2 * k


def test_pivot_keeps_hours_and_fills_zeros(spark):
    rows = [("1", "x", "positive", 0.5, "2024-01-30 10:10:00"), ("2", "x", "mixed", 0.5, "2024-01-30 11:10:00")]
    pivot = trends.trend_pivot(trends.trends(results(spark, rows), AS_OF)).collect()
    assert [(r.positive, r.neutral, r.negative) for r in pivot] == [(1, 0, 0), (0, 0, 0)]


def test_shares_add_up(spark):
    rows = [(str(i), "x", ("positive", "neutral", "negative")[i * i % 3], 0.5, NOON) for i in range(70)]
    got = shares(summary.sentiment_summary(results(spark, rows), AS_OF))
    assert abs(sum(p for _, p, _ in got.values()) - 100) <= 0.02
    assert sum(c for c, _, _ in got.values()) == 70
