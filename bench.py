"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from moodtide.plans import registry
from moodtide.session import build_session

HEADLINE = (
    "sentiment_summary", "overview_stats", "trends", "trend_pivot", "top_posts_per_label", "recent_posts",
    "topic_platform_daily", "trending_hashtags_all", "dedup_posts", "spam_flags", "keyword_match",
    "keyword_table_match", "clean_text", "preprocess", "lexicon_sentiment", "score_posts", "tfidf", "vocabulary",
    "rolling_avg_duration", "retry_decision", "classification_report", "enriched_results", "stream_hourly_trend",
    "stream_cycle",
)


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    known = registry.all_queries()
    known["split_sizes"](spark, sf).write.format("noop").mode("overwrite").save()  # JVM warm-up, not timed
    seconds = {}
    for name in names or HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    posts = spark.read.parquet(f"{sf}/documents.parquet").count()
    scored = seconds.get("score_posts")
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "scored_posts_per_second": round(posts / scored) if scored else None,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main(sys.argv[1:])
