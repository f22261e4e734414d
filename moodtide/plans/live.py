"""Queries that keep state over restarts: running error counts, joined streams, polled sources."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timing
from ..schemas import TWEET_JSON
from ..session import fresh_path
from ..settings import PLATFORMS
from ..sinks import upkeep
from ..sinks.tables import Store, insert_results
from ..sources import landed, polling
from ..streaming import enriched, errors as er, flows, observed
from . import derived as d
from .derived import sql_iso, sql_phrase
from .registry import query

MIDDLE = "2024-01-15 12:00:00"
#: A row of this time follows all others, as the heartbeat of a source does; with it the watermark passes them.
AFTERWARDS = "2024-03-01 00:00:00"


def _two_runs(spark: SparkSession, stages: list[dict[str, DataFrame]], make, out: str, keyed_state: bool = False) -> DataFrame:
    """Land each stage's frames, run the stream until all is read, stop it, and start it again for the next stage."""
    landing, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "checkpoint")
    for number, frames in enumerate(stages):
        streams = {}
        for name, frame in frames.items():
            frame.write.parquet(f"{landing}/{name}/{number}")
            streams[name] = flows.parquet_stream(spark, f"{landing}/{name}/*", frame.schema)
        flows.run_once(make(**streams), flows.append_batches(out), checkpoint, keyed_state=keyed_state)
    return spark.read.parquet(out)


def _errors(spark: SparkSession, sf: str) -> list[dict[str, DataFrame]]:
    """Errors in two stages, split in the middle of the time; a heartbeat ends the second."""
    rows = d.errors(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    beat = [F.lit(-1).cast("long"), F.lit(None).cast("string"), F.lit("heartbeat"), F.lit(AFTERWARDS).cast("timestamp")]
    heartbeat = spark.range(1).select(*[c.alias(n) for c, n in zip(beat, rows.columns, strict=True)])
    early = F.col("timestamp") < F.lit(MIDDLE).cast("timestamp")
    return [{"errors": rows.filter(early)}, {"errors": rows.filter(~early).unionByName(heartbeat)}]


@query(
    "stream_retry_decision",
    """SELECT event_id, error_key, error_count,
              CASE WHEN error_count > 5 THEN FALSE
                   WHEN regexp_matches(lower(message), 'timeout|connection|network') THEN TRUE
                   WHEN regexp_matches(lower(message), 'rate limit|too many requests') THEN TRUE
                   WHEN regexp_matches(lower(message), 'unauthorized|forbidden|invalid credentials') THEN FALSE
                   ELSE error_count <= 3 END AS should_retry
       FROM (SELECT *, row_number() OVER (PARTITION BY error_key ORDER BY timestamp, event_id) AS error_count FROM errors)""",
    ("errors",),
)
def stream_retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_path(spark, "decisions")
    decided = _two_runs(spark, _errors(spark, sf), lambda errors: er.retry_stream(errors), out, keyed_state=True)
    return decided.filter("event_id >= 0").select("event_id", "error_key", "error_count", "should_retry")


_QUIET = timedelta(minutes=90)


@query(
    "stream_error_summary",
    f"""SELECT * FROM (WITH gaps AS (SELECT *, timestamp - lag(timestamp) OVER w > INTERVAL 90 MINUTE AS reset FROM errors
                      WINDOW w AS (PARTITION BY error_key ORDER BY timestamp, event_id)),
             runs AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY error_key ORDER BY timestamp, event_id) AS run FROM gaps)
        SELECT error_key, count(*) AS count, {sql_iso('max(timestamp)')} AS last_occurrence, arg_max(message, (timestamp, event_id)) AS error_message
        FROM runs GROUP BY error_key, run QUALIFY row_number() OVER (PARTITION BY error_key ORDER BY run DESC) = 1)""",
    ("errors",),
)
def stream_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The last error of each key and its count since the key was last quiet for an hour and a half."""
    out = fresh_path(spark, "counted")
    counted = _two_runs(spark, _errors(spark, sf), lambda errors: er.running_errors(errors, expiry=_QUIET), out, keyed_state=True)
    recent = er.last_errors(counted.filter("event_id >= 0"))
    return recent.withColumn("last_occurrence", timing.to_iso(F.col("last_occurrence")))


def _arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results and raw posts; of some posts nothing is ever collected, others are collected long after their result."""
    results = d.scored_posts(spark, sf).select(
        "platform", "post_id", F.col("sentiment.label").alias("label"), F.col("processed_at").cast("timestamp").alias("processed_at")
    )
    posts = d.posts(spark, sf).filter(F.col("doc_id") % 11 != 0)
    late = F.make_dt_interval(hours=F.when(F.col("doc_id") % 7 == 0, 30).otherwise(0))
    arrived = (F.col("collected_at") + late).cast("timestamp").alias("collected_at")
    return results, posts.select("platform", "id", arrived, "text", "lang", "author_id", "likes", "created_at")


@query(
    "stream_enriched",
    """SELECT r.platform, r.post_id, r.label, p.lang, p.author_id, p.likes,
              CASE WHEN p.id IS NULL THEN 'missing' WHEN p.doc_id % 7 = 0 THEN 'late' ELSE 'joined' END AS outcome
       FROM scored_posts r LEFT JOIN (SELECT * FROM posts WHERE doc_id % 11 <> 0) p ON r.post_id = p.id AND r.platform = p.platform""",
    ("posts", "scored_posts"),
)
def stream_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined to raw posts as both arrive, restarted in the middle, then completed from the tables."""
    results, posts = _arrivals(spark, sf)
    middle = F.lit(MIDDLE).cast("timestamp")

    def beat(frame: DataFrame, time: str) -> DataFrame:
        values = [F.lit(AFTERWARDS if f.name == time else None).cast(f.dataType).alias(f.name) for f in frame.schema]
        return spark.range(1).select(*values)

    stages = [
        {"results": results.filter(F.col("processed_at") < middle), "posts": posts.filter(F.col("collected_at") < middle)},
        {
            "results": results.filter(F.col("processed_at") >= middle).unionByName(beat(results, "processed_at")),
            "posts": posts.filter(F.col("collected_at") >= middle).unionByName(beat(posts, "collected_at")),
        },
    ]
    joined = _two_runs(spark, stages, enriched.enriched_stream, fresh_path(spark, "joined"))
    return enriched.completed(joined.filter("post_id IS NOT NULL"), results, posts).drop("processed_at")


@query(
    "stream_cycle_counts",
    """SELECT platform, count(*) AS collected, count(*) FILTER (length(text) > 40) AS kept,
              count(*) FILTER (length(text) > 40 AND lang = 'en') AS scored FROM posts GROUP BY 1""",
    ("posts",),
)
def stream_cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream saw pass in all its batches, by platform, told by its listener."""
    posts = d.posts(spark, sf).select("id", "platform", "lang", "text", "collected_at")
    half = F.col("collected_at") < F.lit(MIDDLE).cast("timestamp_ntz")
    kept = F.length("text") > 40
    listener = observed.CycleListener()
    spark.streams.addListener(listener)
    try:
        stages = [{"posts": posts.filter(half)}, {"posts": posts.filter(~half)}]
        see = lambda posts: observed.observed(posts, kept, kept & (F.col("lang") == "en"), PLATFORMS)
        _two_runs(spark, stages, see, fresh_path(spark, "observed"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return listener.drain(spark).groupBy("platform").agg(*[F.sum(c).alias(c) for c in observed.COUNTS])


@query(
    "compacted_day",
    """SELECT post_id, platform, label FROM scored_posts
       WHERE label = 'negative' AND hour(created_at) * 60 + minute(created_at) BETWEEN 540 AND 719""",
    ("posts", "scored_posts"),
)
def compacted_day(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of a day's results, folded, and read for one label and a span of the day."""
    store = Store(fresh_path(spark, "store"), "batches")
    results = d.scored_posts(spark, sf)
    for batch in range(3):
        insert_results(results.filter(F.pmod(F.crc32("post_id"), F.lit(3)) == batch), store, batch, d.AS_OF)
    day = d.AS_OF[:10]
    upkeep.fold_day(spark, store, "sentiment_results", day, rows_per_file=50_000)
    found = upkeep.read_folded(spark, store, "sentiment_results", day, minutes=(540, 719), label="negative")
    return found.select("post_id", "platform", "sentiment.label")


@query(
    "stream_landed_tweets",
    f"""SELECT id, text, CAST(doc_id % 97 AS VARCHAR) AS author_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE likes END AS likes, retweets
        FROM posts WHERE lang = 'en' AND ({' OR '.join(f"contains({sql_phrase('text')}, ' {word} ')" for word in d.KEYWORDS)})""",
    ("posts",),
)
def stream_landed_tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Tweets landed as JSON lines, read and normalised as a stream."""
    landing, out = fresh_path(spark, "landed"), fresh_path(spark, "tweets")
    rows = d.long_posts(spark, sf).select(
        F.col("doc_id").alias("id"),
        "text",
        F.concat(timing.to_iso(F.col("created_at")), F.lit("Z")).alias("created_at"),
        (F.col("doc_id") % 97).alias("author_id"),
        "lang",
        F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("likes")).alias("like_count"), F.col("retweets").alias("retweet_count")).alias("public_metrics"),
    )
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(landing)
    tweets = landed.normalize_tweets(landed.stream_landed(spark, landing, TWEET_JSON), F.lit(d.AS_OF), d.KEYWORDS)
    flows.run_once(tweets, flows.append_batches(out), fresh_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("id", "text", "author_id", "likes", "retweets")


@query("stream_stopped", "SELECT id, platform FROM posts", ("posts",))
def stream_stopped(spark: SparkSession, sf: str) -> DataFrame:
    """A stream on its interval that is stopped once it has read what is there, and started again when more has come."""
    landing, out, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "stopped"), fresh_path(spark, "checkpoint")
    posts = d.posts(spark, sf).select("id", "platform", "collected_at")
    half = F.col("collected_at") < F.lit(MIDDLE).cast("timestamp_ntz")
    for number, rows in enumerate((posts.filter(half), posts.filter(~half))):
        rows.write.parquet(f"{landing}/{number}")
        stream = flows.parquet_stream(spark, f"{landing}/*", posts.schema)
        running = flows.start(stream, flows.append_batches(out), checkpoint, interval_seconds=1)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return spark.read.parquet(out).select("id", "platform")


_CAPS = {"twitter": 2, "reddit": 1, "youtube": 3}
_FILES = 6


@query(
    "polled_sources",
    """SELECT platform AS source, id, likes, NULL AS problem FROM posts
       UNION ALL SELECT 'forum', NULL, NULL, 'FileNotFoundError'""",
    ("posts",),
)
def polled_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Three landed sources and a broken one, polled with a cap each; the stream is stopped after every poll."""
    landing, out = fresh_path(spark, "landed"), fresh_path(spark, "polled")
    progress, checkpoint = fresh_path(spark, "progress"), fresh_path(spark, "checkpoint")
    for name in _CAPS:
        rows = d.posts(spark, sf).filter(F.col("platform") == name).select("id", "likes")
        rows.repartition(_FILES, "id").select(F.to_json(F.struct("id", "likes")).alias("value")).write.text(f"{landing}/{name}")
    folders = {name: f"{landing}/{name}" for name in (*_CAPS, "forum")}
    for _ in range(_FILES // min(_CAPS.values())):
        flows.run_once(polling.polled_stream(spark, folders, _CAPS, f"{progress}/at.json"), flows.append_batches(out), checkpoint)
    record = F.from_json("record", "id string, likes long")
    return spark.read.parquet(out).select("source", record["id"].alias("id"), record["likes"].alias("likes"), "problem")
