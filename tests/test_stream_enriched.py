"""The stream-stream join: matches, rows without a partner, late posts and bounded state."""

from pyspark.sql import functions as F

from moodtide.streaming import enriched, flows

POSTS = "platform string, id string, collected_at timestamp, text string, lang string, author_id string, likes long, created_at timestamp"
RESULTS = "platform string, post_id string, label string, processed_at timestamp"


def at(hour, minute=0):
    return f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:{minute:02d}:00"


def frame(spark, rows, schema):
    times = [c.split()[0] for c in schema.split(", ") if c.endswith("timestamp")]
    made = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
    return made.withColumns({c: F.col(c).cast("timestamp") for c in times})


def post(i, hour, likes=1, platform="x"):
    return (platform, str(i) if i is not None else None, at(hour), "t", "en", "u", likes, at(hour))


def result(i, hour, label="positive", platform="x"):
    return (platform, str(i) if i is not None else None, label, at(hour))


def run(spark, tmp_path, stages):
    out, state = str(tmp_path / "out"), []
    for n, (posts, results) in enumerate(stages):
        frame(spark, posts, POSTS).coalesce(1).write.parquet(str(tmp_path / f"posts/{n}"))
        frame(spark, results, RESULTS).coalesce(1).write.parquet(str(tmp_path / f"results/{n}"))
        streams = [
            flows.parquet_stream(spark, str(tmp_path / f"{name}/*"), frame(spark, [], schema).schema)
            for name, schema in (("results", RESULTS), ("posts", POSTS))
        ]
        started = flows.start(enriched.enriched_stream(*streams), flows.append_batches(out), str(tmp_path / "cp"), once=True)
        started.awaitTermination()
        state.append(sum(op["numRowsTotal"] for op in started.lastProgress["stateOperators"]))
    return spark.read.parquet(out), state


def test_matches_over_restarts_and_gives_out_what_finds_no_partner(spark, tmp_path):
    stages = [
        ([post(1, 0), post(2, 0), post(2, 0, likes=9), post(None, 0)], [result(1, 1), result(9, 1), result(None, 1)]),
        ([post(3, 10)], [result(2, 2), result(3, 11)]),
        ([post(99, 200)], [result(98, 200)]),
    ]
    joined, state = run(spark, tmp_path, stages)
    got = sorted((r.post_id or "", r.matched, r.likes) for r in joined.collect())
    assert got == [("", False, None), ("1", True, 1), ("2", True, 1), ("3", True, 1), ("9", False, None)]
    assert state[-1] == 4  # only the newest post, in both steps of the dedup and in the join, and the newest result


def test_a_result_outside_the_span_is_completed_from_the_tables(spark, tmp_path):
    posts = [post(1, 0), post(2, 30), post(5, 0)]
    results = [result(1, 1), result(2, 1), result(5, 20), result(7, 1), result(1, 1)]
    joined, _ = run(spark, tmp_path, [(posts, results), ([post(99, 300)], [result(98, 300)])])
    whole = enriched.completed(joined.filter("post_id <> '98'"), frame(spark, results, RESULTS), frame(spark, posts, POSTS))
    assert sorted((r.post_id, r.outcome, r.likes) for r in whole.collect()) == [
        ("1", "joined", 1), ("1", "joined", 1), ("2", "late", 1), ("5", "late", 1), ("7", "missing", None),
    ]
