"""Queries that run as Structured Streaming over the given tables and read their final state back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timing
from ..operators import scoring
from ..session import fresh_path
from ..sinks.tables import Store
from ..sources import keywords as kw
from ..streaming import cycle, flows
from . import derived as d
from .derived import sql_iso
from .ingest import _MATCH_SQL
from .registry import query


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream; the bracket makes the path a pattern, as a single file needs."""
    schema = d.table(spark, sf, name).schema
    return flows.parquet_stream(spark, f"{sf}/{name}.parque[t]", schema)


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return d.posts_from(table_stream(spark, sf, "documents"))


def _written(spark: SparkSession, stream: DataFrame, write, mode: str = "append") -> None:
    flows.run_once(stream, write, fresh_path(spark, "checkpoint"), mode)


@query(
    "stream_union",
    "SELECT id, platform, text FROM posts UNION ALL SELECT CAST(page_id AS VARCHAR), 'pages', html FROM pages",
    ("posts",),
)
def stream_union(spark: SparkSession, sf: str) -> DataFrame:
    pages = table_stream(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("platform"), F.col("html").alias("text")
    )
    out = fresh_path(spark, "union")
    _written(spark, flows.union_stream(_posts(spark, sf), pages), flows.append_batches(out))
    return spark.read.parquet(out).select("id", "platform", "text")


@query(
    "stream_dedup",
    "SELECT id, platform, 1 AS copies FROM posts",
    ("posts",),
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    again = F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("again")
    found = _posts(spark, sf).select("id", "platform", "collected_at", again)
    arrived = (F.col("collected_at") + F.make_dt_interval(mins=F.col("again") * 10)).cast("timestamp")
    out = fresh_path(spark, "dedup")
    _written(spark, flows.dedup_stream(found.withColumn("collected_at", arrived)), flows.append_batches(out))
    return spark.read.parquet(out).groupBy("id", "platform").agg(F.count("*").cast("int").alias("copies"))


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    results = d.results_from(table_stream(spark, sf, "events"))
    out = fresh_path(spark, "hourly")
    counts = flows.hourly_counts(results, F.col("sentiment.label"))
    _written(spark, counts, flows.append_batches(out), "update")
    return flows.latest_changes(spark, out, ["hour", "label"], ["count"])


_HOURLY_SQL = "SELECT date_trunc('hour', processed_at) AS hour, label, count(*) AS count FROM results GROUP BY 1, 2"


@query(
    "stream_hourly_trend",
    f"SELECT {sql_iso('hour')} AS hour, label, count FROM ({_HOURLY_SQL})",
    ("results",),
)
def stream_hourly_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly(spark, sf).withColumn("hour", timing.to_iso(F.col("hour")))


@query(
    "stream_sliding_summary",
    f"""SELECT {sql_iso('hour - to_hours(CAST(back AS INTEGER))')} AS window_start, label, CAST(sum(count) AS BIGINT) AS count
        FROM ({_HOURLY_SQL}), range(24) AS b(back) GROUP BY 1, 2""",
    ("results",),
)
def stream_sliding_summary(spark: SparkSession, sf: str) -> DataFrame:
    sliding = flows.sliding_summary(_hourly(spark, sf))
    return sliding.withColumn("window_start", timing.to_iso(F.col("window_start")))


@query("stream_keywords", _MATCH_SQL, ("posts",))
def stream_keywords(spark: SparkSession, sf: str) -> DataFrame:
    tracked, out = fresh_path(spark, "keywords"), fresh_path(spark, "matches")
    kw.keyword_table(spark, d.KEYWORDS).write.parquet(tracked)
    _written(spark, _posts(spark, sf).select("id", "text"), cycle.keyword_writer(tracked, out))
    return spark.read.parquet(out).select("id", "keyword")


def _cycle(spark: SparkSession, sf: str, stream: DataFrame) -> Store:
    store = Store(fresh_path(spark, "store"))
    scorer = scoring.lexicon_scorer(d.corpus_lexicon(spark, sf), unique=True)
    _written(spark, stream, cycle.Cycle(store, scorer, d.AS_OF))
    return store


@query(
    "stream_cycle",
    """SELECT id AS post_id, platform, coalesce(p, 0) AS polarity_points, likes FROM posts
       LEFT JOIN (SELECT doc_id, sum(polarity_points) / count(*) / 100 AS p FROM said JOIN lexicon USING (token) GROUP BY doc_id)
       USING (doc_id) WHERE length(text) > 10""",
    ("said", "lexicon", "posts"),
)
def stream_cycle(spark: SparkSession, sf: str) -> DataFrame:
    store = _cycle(spark, sf, _posts(spark, sf))
    return store.read(spark, "sentiment_results").select(
        "post_id", "platform", F.col("sentiment.polarity").alias("polarity_points"), "metadata.likes"
    )


@query(
    "stream_quarantine",
    """SELECT 'raw' AS part, count(*) AS rows FROM posts WHERE doc_id % 9 <> 0
       UNION ALL SELECT 'quarantine', count(*) FROM posts WHERE doc_id % 9 = 0""",
    ("posts",),
)
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    likes = F.when(F.col("doc_id") % 9 == 0, "many").otherwise(F.col("likes").cast("string"))
    store = _cycle(spark, sf, _posts(spark, sf).withColumn("likes", likes))
    parts = [
        store.read(spark, "raw_posts").agg(F.count("*").alias("rows")).select(F.lit("raw").alias("part"), "rows"),
        spark.read.parquet(store.path("quarantine"))
        .agg(F.count("*").alias("rows"))
        .select(F.lit("quarantine").alias("part"), "rows"),
    ]
    return parts[0].unionByName(parts[1])


@query(
    "sink_cycle",
    """SELECT platform, count(*) AS raw_rows, count(*) AS result_rows FROM posts GROUP BY platform""",
    ("posts",),
)
def sink_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables of a cycle counted side by side."""
    store = _cycle(spark, sf, _posts(spark, sf))
    raw = store.read(spark, "raw_posts").groupBy("platform").agg(F.count("*").alias("raw_rows"))
    results = store.read(spark, "sentiment_results").groupBy("platform").agg(F.count("*").alias("result_rows"))
    return raw.join(results, "platform")
