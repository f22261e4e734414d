"""Prefix scans over range parts: hot keys and moments, null keys and times, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from moodtide.operators import oplog, scan

ROWS = "k string, at long, n long"


def plain_as_of(rows, versions):
    out = []
    for k, at, n in rows:
        valid = [(v_at, value) for v_k, v_at, value in versions if v_k == k and v_at is not None and at is not None and v_at <= at]
        out.append((k, at, n, max(valid)[1] if valid else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_index_over_parts_equals_the_plain_one(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 5, 5, 5, rng.randint(0, 50)]), n) for n in range(800)]
    got = scan.running_index(spark.createDataFrame(rows, ROWS), ["k"], ["at", "n"], "i", parts).collect()
    seen, want = {}, {}
    for k, at, n in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        seen[k] = want[n] = seen.get(k, 0) + 1
        want[n] = seen[k]
    assert {r.n: r.i for r in got} == want


def test_a_hot_moment_is_spread_over_parts(spark):
    """Nine rows in ten are of one key and one minute; no part has more than its share of them."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"), F.lit(7).cast("long").alias("at"), F.col("id").alias("n")
    )
    placed = scan.ranged(rows, ["k"], ["at", "n"], 16)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * 20_000 / 16
    indexed = scan.running_index(rows, ["k"], ["at", "n"], "i", 16)
    assert indexed.filter(F.col("k") == "hot").agg(F.countDistinct("i"), F.max("i")).first()[:] == (18_000, 18_000)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_as_of_carries_the_last_version_over_parts(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None, "none"]), rng.choice([None, rng.randint(0, 100)]), n) for n in range(400)]
    versions = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 100)]), f"v{i:02d}") for i in range(25)]
    versions += [("a", 50, "x"), ("a", 50, "y"), ("a", 60, None)]
    listed = spark.createDataFrame(versions, "k string, since long, v string")
    got = scan.as_of(spark.createDataFrame(rows, ROWS), listed, ["k"], "at", "since", "v", ["n"], parts)
    with_null = [v if v[2] is not None else (v[0], v[1], "") for v in versions]
    want = sorted(((k, at, n, v or None) for k, at, n, v in plain_as_of(rows, with_null)), key=str)
    assert got.columns == ["k", "at", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_as_of_without_versions_or_rows(spark):
    rows, listed = spark.createDataFrame([("a", 1, 1)], ROWS), spark.createDataFrame([], "k string, since long, v string")
    assert [r.v for r in scan.as_of(rows, listed, ["k"], "at", "since", "v").collect()] == [None]
    assert scan.as_of(rows.limit(0), listed, ["k"], "at", "since", "v").count() == 0


def test_decisions_of_one_hot_minute(spark):
    rows = [(i, "k", "weird", "2024-01-01 10:00:30") for i in range(200)]
    errors = spark.createDataFrame(rows, "event_id long, error_key string, message string, timestamp string")
    decided = oplog.retry_decision(errors.withColumn("timestamp", F.col("timestamp").cast("timestamp")), ["event_id"])
    assert {r.event_id: (r.error_count, r.should_retry) for r in decided.collect()} == {i: (i + 1, i < 3) for i in range(200)}
