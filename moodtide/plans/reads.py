"""Queries over scored results: summaries, trends, rankings, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timing
from ..operators import cleaning, ranking, summary, topics, trends as tr
from ..sinks.tables import envelope
from . import derived as d
from .derived import sql_iso
from .registry import query

_DAY = f"processed_at >= TIMESTAMP '{d.AS_OF}' - INTERVAL 24 HOUR"
_WEEK = f"processed_at >= TIMESTAMP '{d.AS_OF}' - INTERVAL 7 DAY"
_LABELS = "(VALUES ('positive'), ('neutral'), ('negative')) AS l(label)"
_PCT = "CASE WHEN total > 0 THEN round_even(count / total * 100, 2) ELSE 0.0 END"


def _summary_sql(source: str, where: str) -> str:
    return f"""SELECT label, count, total, {_PCT} AS percentage FROM (
            SELECT label, count, CAST(sum(count) OVER () AS BIGINT) AS total FROM (
                SELECT label, CAST(sum(c) AS BIGINT) AS count FROM (
                    SELECT label, count(*) AS c FROM {source} WHERE {where} GROUP BY label
                    UNION ALL SELECT label, 0 FROM {_LABELS}) GROUP BY label))"""


@query("sentiment_summary", _summary_sql("messy_results", _DAY), ("results", "messy_results"))
def sentiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.sentiment_summary(d.messy_results(spark, sf), d.AS_OF)


@query(
    "sentiment_summary_platform",
    _summary_sql("results", f"{_DAY} AND platform = 'reddit'"),
    ("results",),
)
def sentiment_summary_platform(spark: SparkSession, sf: str) -> DataFrame:
    return summary.sentiment_summary(d.results(spark, sf), d.AS_OF, platform="reddit")


@query(
    "batch_stats",
    """SELECT round_even(p / t * 100, 2) AS positive, round_even(u / t * 100, 2) AS neutral,
              round_even(n / t * 100, 2) AS negative, t AS total
       FROM (SELECT p, u, n, p + u + n AS t FROM (
           SELECT count(*) FILTER (coalesce(label, 'neutral') = 'positive') AS p,
                  count(*) FILTER (coalesce(label, 'neutral') = 'neutral') AS u,
                  count(*) FILTER (coalesce(label, 'neutral') = 'negative') AS n
           FROM messy_results WHERE has_sentiment))""",
    ("results", "messy_results"),
)
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return summary.batch_stats(d.messy_results(spark, sf))


@query(
    "analyzer_summary",
    """SELECT count(*) FILTER (label = 'positive') / count(*) * 100 AS positive,
              count(*) FILTER (label = 'neutral') / count(*) * 100 AS neutral,
              count(*) FILTER (label = 'negative') / count(*) * 100 AS negative, count(*) AS total FROM results""",
    ("results",),
)
def analyzer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.analyzer_summary(d.results(spark, sf))


_OVERVIEW_SQL = f"""SELECT scope, label, count, total, {_PCT} AS percentage FROM (
        SELECT scope, label, count, CAST(sum(count) OVER (PARTITION BY scope) AS BIGINT) AS total FROM (
            SELECT scope, label, CAST(sum(c) AS BIGINT) AS count FROM (
                SELECT 'overall' AS scope, label, count(*) AS c FROM results WHERE {_DAY} GROUP BY label
                UNION ALL SELECT platform, label, count(*) FROM results WHERE {_DAY} GROUP BY platform, label
                UNION ALL SELECT scope, label, 0 FROM {_LABELS},
                    (VALUES ('overall'), ('twitter'), ('reddit'), ('youtube')) AS s(scope))
            GROUP BY scope, label))"""


@query("overview_stats", _OVERVIEW_SQL, ("results",))
def overview_stats(spark: SparkSession, sf: str) -> DataFrame:
    return summary.overview_stats(d.results(spark, sf), d.AS_OF)


@query(
    "platform_breakdown",
    f"""SELECT scope AS platform, max(round_even(percentage, 1)) FILTER (label = 'positive') AS positive,
               max(round_even(percentage, 1)) FILTER (label = 'neutral') AS neutral,
               max(round_even(percentage, 1)) FILTER (label = 'negative') AS negative, max(total) AS total
        FROM ({_OVERVIEW_SQL}) WHERE scope <> 'overall' AND total > 0 GROUP BY scope""",
    ("results",),
)
def platform_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return summary.platform_breakdown(d.results(spark, sf), d.AS_OF)


@query(
    "summary_counts",
    f"""SELECT label, CAST(floor(total * percentage / 100 + 0.5) AS BIGINT) AS approx_count
        FROM ({_summary_sql('results', _DAY)})""",
    ("results",),
)
def summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.summary_counts(summary.sentiment_summary(d.results(spark, sf), d.AS_OF))


@query(
    "distribution_labels",
    f"""SELECT label, CASE WHEN percentage > 5 THEN format('{{:.1f}}%', percentage) ELSE '' END AS caption
        FROM ({_summary_sql('results', _DAY)})""",
    ("results",),
)
def distribution_labels(spark: SparkSession, sf: str) -> DataFrame:
    return summary.distribution_labels(summary.sentiment_summary(d.results(spark, sf), d.AS_OF))


_TREND_SQL = f"""SELECT strftime(processed_at, '%Y-%m-%d') AS date, CAST(hour(processed_at) AS INTEGER) AS hour, label,
        count(*) AS count FROM results WHERE {_WEEK} GROUP BY 1, 2, 3"""


@query("trends", _TREND_SQL, ("results",))
def trends(spark: SparkSession, sf: str) -> DataFrame:
    return tr.trends(d.results(spark, sf), d.AS_OF)


_PIVOT_SQL = f"""SELECT date_trunc('hour', processed_at) AS hour, count(*) FILTER (label = 'positive') AS positive,
        count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'negative') AS negative
        FROM results WHERE {_WEEK} GROUP BY 1"""


@query(
    "trend_pivot",
    f"SELECT {sql_iso('hour')} AS hour, positive, neutral, negative FROM ({_PIVOT_SQL})",
    ("results",),
)
def trend_pivot(spark: SparkSession, sf: str) -> DataFrame:
    pivot = tr.trend_pivot(tr.trends(d.results(spark, sf), d.AS_OF))
    return pivot.withColumn("hour", timing.to_iso(F.col("hour")))


@query(
    "trend_extent",
    f"""SELECT {sql_iso('min(hour)')} AS first_hour, {sql_iso('max(hour)')} AS last_hour,
               max(greatest(positive, neutral, negative)) AS highest FROM ({_PIVOT_SQL})""",
    ("results",),
)
def trend_extent(spark: SparkSession, sf: str) -> DataFrame:
    extent = tr.trend_extent(tr.trend_pivot(tr.trends(d.results(spark, sf), d.AS_OF)))
    return extent.withColumns({c: timing.to_iso(F.col(c)) for c in ("first_hour", "last_hour")})


_HOURLY_SHARE = """SELECT platform, date_trunc('hour', processed_at) AS hour, count(*) AS rows,
                   round_even(count(*) FILTER (label = 'negative') / count(*) * 100, 2) AS share
            FROM results GROUP BY 1, 2"""


@query(
    "sentiment_alerts",
    f"""SELECT platform, {sql_iso('hour')} AS hour, rows, share, change FROM (
            SELECT a.*, round_even(a.share - b.share, 2) AS change
            FROM ({_HOURLY_SHARE}) a JOIN ({_HOURLY_SHARE}) b ON a.platform = b.platform AND a.hour = b.hour + INTERVAL 1 HOUR
            WHERE a.rows >= 3 AND b.rows >= 3)
        WHERE abs(change) >= 20""",
    ("results",),
)
def sentiment_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = tr.sentiment_alerts(d.results(spark, sf))
    return alerts.withColumn("hour", timing.to_iso(F.col("hour")))


@query(
    "sentiment_zscore_alerts",
    f"""SELECT platform, {sql_iso('hour')} AS hour, rows, share, hours, zscore FROM (
            SELECT *, round_even((points - mean) / deviation, 6) AS zscore FROM (
                SELECT *, count(*) OVER w AS hours, avg(points) OVER w AS mean, stddev_samp(points) OVER w AS deviation
                FROM (SELECT *, CAST(round(share * 100) AS BIGINT) AS points FROM ({_HOURLY_SHARE}))
                WINDOW w AS (PARTITION BY platform ORDER BY hour RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING))
            WHERE hours >= 6 AND deviation > 0)
        WHERE abs(zscore) >= 2""",
    ("results",),
)
def sentiment_zscore_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = tr.sentiment_zscore_alerts(d.results(spark, sf))
    return alerts.withColumn("hour", timing.to_iso(F.col("hour")))


@query(
    "daily_volume",
    """SELECT strftime(processed_at, '%Y-%m-%d') AS day, count(*) AS posts, count(*) >= 1000 AS target_met
       FROM results GROUP BY 1""",
    ("results",),
)
def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return summary.daily_volume(d.results(spark, sf), time="processed_at")


@query(
    "topic_platform_daily",
    """SELECT keyword, platform, strftime(processed_at, '%Y-%m-%d') AS day, label, count(*) AS count FROM (
           SELECT platform, processed_at, label, unnest([event_type, keyword]) AS keyword FROM results)
       GROUP BY 1, 2, 3, 4""",
    ("results",),
)
def topic_platform_daily(spark: SparkSession, sf: str) -> DataFrame:
    return summary.topic_platform_daily(d.results(spark, sf))


@query(
    "filtered_summary",
    f"""SELECT label, count, total, {_PCT} AS percentage FROM (
            SELECT label, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM results
            WHERE platform = 'twitter' AND keyword = 'k3' AND processed_at >= TIMESTAMP '2024-01-10'
              AND processed_at < TIMESTAMP '2024-01-20' GROUP BY label)""",
    ("results",),
)
def filtered_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.filtered_summary(
        d.results(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "twitter", "k3"
    )


@query("high_confidence", "SELECT post_id, label, confidence FROM results WHERE confidence >= 0.7", ("results",))
def high_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return summary.high_confidence(d.results(spark, sf)).select("post_id", "sentiment.label", "sentiment.confidence")


@query(
    "cycle_counts",
    """SELECT strftime(collected_at, '%Y-%m-%d') AS cycle, platform, count(*) AS collected,
              count(*) FILTER (length(text) > 40) AS kept, count(*) FILTER (length(text) > 40 AND lang = 'en') AS scored
       FROM posts GROUP BY 1, 2""",
    ("posts",),
)
def cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.length("text") > 40
    return summary.cycle_counts(
        d.posts(spark, sf), kept, kept & (F.col("lang") == "en"), timing.day_text(F.col("collected_at"))
    )


_RECENT_SQL = f"""SELECT * FROM mixed_posts
        WHERE created_at >= TIMESTAMP '{d.DAY_ONE}' + INTERVAL 4 HOUR ORDER BY created_at DESC, id LIMIT 50"""


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.recent_posts(d.mixed_posts(spark, sf), "2024-01-02 04:00:00", hours=24, limit=50)


@query(
    "recent_posts",
    f"SELECT id, platform, {sql_iso('created_at')} AS created_at, text, title FROM ({_RECENT_SQL})",
    ("posts", "mixed_posts"),
)
def recent_posts(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf).select(
        "id", "platform", timing.to_iso(F.col("created_at")).alias("created_at"), "text", "title"
    )


@query(
    "recent_posts_view",
    f"""SELECT id, coalesce(nullif(text, ''), nullif(title, '')) AS text, platform, {sql_iso('created_at')} AS created_at,
               coalesce(nullif(author_id, ''), nullif(author, '')) AS author, coalesce(likes, 0) AS likes,
               coalesce(retweets, 0) AS retweets, coalesce(score, 0) AS score FROM ({_RECENT_SQL})""",
    ("posts", "mixed_posts"),
)
def recent_posts_view(spark: SparkSession, sf: str) -> DataFrame:
    view = ranking.recent_posts_view(_recent(spark, sf))
    return view.select("id", "text", "platform", "created_at", "author", "metrics.*")


_BY_CONFIDENCE = "confidence DESC, processed_at DESC, post_id"


@query(
    "top_posts",
    f"""SELECT post_id, platform, confidence, {sql_iso('processed_at')} AS processed_at FROM scored_posts
        WHERE label = 'positive' ORDER BY {_BY_CONFIDENCE} LIMIT 10""",
    ("posts", "scored_posts"),
)
def top_posts(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_posts(d.scored_posts(spark, sf), "positive").select(
        "post_id", "platform", "sentiment.confidence", timing.to_iso(F.col("processed_at")).alias("processed_at")
    )


@query(
    "top_posts_view",
    f"""SELECT post_id AS id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
               platform, label, {sql_iso('created_at')} AS created_at, format('{{:.1f}}%', confidence * 100) AS confidence_text,
               author_id, likes
        FROM scored_posts WHERE label = 'negative' AND platform = 'twitter' ORDER BY {_BY_CONFIDENCE} LIMIT 20""",
    ("posts", "scored_posts"),
)
def top_posts_view(spark: SparkSession, sf: str) -> DataFrame:
    view = ranking.top_posts_view(ranking.top_posts(d.scored_posts(spark, sf), "negative", "twitter", 20))
    return view.select(
        "id", "text", "platform", "sentiment.label", "created_at", "confidence_text", "metadata.author_id",
        "metadata.likes",
    )


@query(
    "top_posts_per_label",
    f"""SELECT label, post_id, confidence, rank FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY {_BY_CONFIDENCE}) AS INTEGER) AS rank FROM results)
        WHERE rank <= 5""",
    ("results",),
)
def top_posts_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_posts_per_label(d.results(spark, sf)).select(
        "label", "post_id", "sentiment.confidence", "rank"
    )


@query(
    "samples_per_label",
    """SELECT label, doc_id, CAST(n AS INTEGER) AS sample FROM (
           SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n FROM gold) WHERE n <= 3""",
    ("gold",),
)
def samples_per_label(spark: SparkSession, sf: str) -> DataFrame:
    labelled = d.gold(spark, sf).withColumn("label", d.code_label(F.col("y")))
    return ranking.samples_per_label(labelled, row="doc_id").select("label", "doc_id", "sample")


@query(
    "trending_hashtags",
    r"""SELECT hashtag, count(*) AS count FROM (SELECT regexp_extract(text, '#(\w+)', 1) AS hashtag FROM posts)
        WHERE hashtag <> '' GROUP BY 1 HAVING count(*) >= 5""",
    ("posts",),
)
def trending_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return topics.trending_hashtags(d.posts(spark, sf))


@query(
    "trending_hashtags_all",
    r"""SELECT hashtag, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '#(\w+)', 1)) AS hashtag FROM posts)
        GROUP BY 1 HAVING count(*) >= 5""",
    ("posts",),
)
def trending_hashtags_all(spark: SparkSession, sf: str) -> DataFrame:
    return topics.trending_hashtags_all(d.posts(spark, sf))


@query(
    "trending_mentions",
    r"""SELECT mention, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '@(\w+)', 1)) AS mention FROM posts)
        GROUP BY 1 HAVING count(*) >= 5""",
    ("posts",),
)
def trending_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return topics.trending_mentions(d.posts(spark, sf))


@query(
    "summary_json",
    f"""SELECT '{{"success":true,"data":[' || string_agg('{{"label":"' || label || '","count":' || count || '}}', ',' ORDER BY label)
               || '],"timestamp":"{d.AS_OF}","count":' || count(*) || '}}' AS json FROM ({_summary_sql('results', _DAY)})""",
    ("results",),
)
def summary_json(spark: SparkSession, sf: str) -> DataFrame:
    counted = summary.sentiment_summary(d.results(spark, sf), d.AS_OF).select("label", "count")
    return envelope(counted, d.AS_OF, with_count=True)


@query(
    "english_summary",
    """SELECT label, count(*) AS count FROM scored_posts s JOIN posts p ON s.post_id = p.id
       WHERE p.lang = 'en' GROUP BY label""",
    ("posts", "scored_posts"),
)
def english_summary(spark: SparkSession, sf: str) -> DataFrame:
    english = cleaning.english_only(d.posts(spark, sf)).select(F.col("id").alias("post_id"))
    joined = d.scored_posts(spark, sf).join(english, "post_id")
    return joined.groupBy("sentiment.label").agg(F.count("*").alias("count"))
