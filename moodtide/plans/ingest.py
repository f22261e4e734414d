"""Queries over sources, cleaning, joins and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, timing
from ..operators import cleaning, enrich, scoring
from ..operators.sizing import each
from ..schemas import (
    SUBMISSION_COMMENT_JSON, SUBMISSION_JSON, TWEET_JSON, VIDEO_COMMENTS_JSON, VIDEO_SEARCH_JSON, VIDEO_STATS_JSON,
)
from ..session import fresh_path
from ..sinks import tables as sinks
from ..sources import conform as cf, keywords as kw, landed, labelled as lb
from . import derived as d
from .derived import sql_iso, sql_phrase
from .registry import query

_FOUND = " OR ".join(f"contains({{0}}, ' {word} ')" for word in d.KEYWORDS)


def _stamp():
    return F.lit(d.AS_OF)


def _landed(rows: DataFrame, schema) -> DataFrame:
    """Rows as the JSON text an API would land, parsed again with the source's layout."""
    return rows.select(F.from_json(F.to_json(F.struct("*")), schema).alias("r")).select("r.*")


def _iso_z(stamp):
    return F.concat(timing.to_iso(stamp), F.lit("Z"))


def _iso_utc(stamp):
    """A parsed moment as UTC text, whatever the session's time zone."""
    return timing.to_iso(F.convert_timezone(None, F.lit("UTC"), stamp.cast("timestamp_ntz")))


@query(
    "normalize_tweets",
    f"""SELECT id, text, {sql_iso('created_at')} AS created_at, CAST(doc_id % 97 AS VARCHAR) AS author_id,
               CASE WHEN doc_id % 4 = 0 THEN 0 ELSE likes END AS likes, retweets
        FROM posts WHERE lang = 'en' AND ({_FOUND.format(sql_phrase('text'))})""",
    ("posts",),
)
def normalize_tweets(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.long_posts(spark, sf).select(
        F.col("doc_id").alias("id"),
        "text",
        _iso_z(F.col("created_at")).alias("created_at"),
        (F.col("doc_id") % 97).alias("author_id"),
        "lang",
        F.struct(
            F.when(F.col("doc_id") % 4 != 0, F.col("likes")).alias("like_count"),
            F.col("retweets").alias("retweet_count"),
        ).alias("public_metrics"),
    )
    out = landed.normalize_tweets(_landed(rows, TWEET_JSON), _stamp(), d.KEYWORDS)
    return out.select(
        "id", "text", _iso_utc(F.col("created_at")).alias("created_at"), "author_id", "likes", "retweets"
    )


@query(
    "normalize_reddit_posts",
    f"""SELECT id, title, text, created_at, author, subreddit, upvotes, downvotes, score, num_comments, matched_keyword
        FROM (SELECT id, 'about ' || source AS title, text, {sql_iso('created_at')} AS created_at,
                     coalesce(author_id, '[deleted]') AS author, source AS subreddit, likes AS upvotes, retweets AS downvotes,
                     score, likes + retweets AS num_comments, word AS matched_keyword,
                     row_number() OVER (PARTITION BY source, word ORDER BY created_at DESC, id) AS n
              FROM posts, (SELECT unnest(['{"','".join(d.KEYWORDS)}']) AS word)
              WHERE source IN ('{"','".join(d.SUBREDDITS)}')
                AND contains({sql_phrase("'about ' || source || ' ' || text")}, ' ' || word || ' '))
        WHERE n <= 10""",
    ("posts",),
)
def normalize_reddit_posts(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.posts(spark, sf).select(
        "id",
        F.concat(F.lit("about "), "source").alias("title"),
        F.col("text").alias("selftext"),
        F.unix_timestamp(F.col("created_at").cast("timestamp")).cast("double").alias("created_utc"),
        F.col("author_id").alias("author"),
        F.col("source").alias("subreddit"),
        F.col("likes").alias("ups"),
        F.col("retweets").alias("downs"),
        "score",
        (F.col("likes") + F.col("retweets")).alias("num_comments"),
    )
    out = landed.normalize_reddit_posts(_landed(rows, SUBMISSION_JSON), _stamp(), d.SUBREDDITS, d.KEYWORDS, limit=30)
    return out.select(
        "id", "title", "text", timing.to_iso(F.col("created_at")).alias("created_at"), "author", "subreddit",
        "upvotes", "downvotes", "score", "num_comments", "matched_keyword",
    )


@query(
    "comments_per_parent",
    f"""SELECT id, parent_id, text, author, created_at, score FROM (
            SELECT id, parent_id, text, CASE WHEN role = 'user' THEN '[deleted]' ELSE role END AS author,
                   {sql_iso(f"TIMESTAMP '{d.DAY_ONE}' + to_minutes(CAST(position AS INTEGER))")} AS created_at,
                   CAST(length(text) AS BIGINT) AS score,
                   row_number() OVER (PARTITION BY parent_id ORDER BY position, id) AS n FROM comments)
        WHERE n <= 3""",
    ("comments",),
)
def comments_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_timestamp(F.lit(d.DAY_ONE).cast("timestamp"))
    rows = d.comments(spark, sf).select(
        "id",
        F.col("text").alias("body"),
        (start + F.col("position") * 60).cast("double").alias("created_utc"),
        F.when(F.col("role") != "user", F.col("role")).alias("author"),
        F.length("text").cast("bigint").alias("score"),
        "parent_id",
        "position",
    )
    out = landed.normalize_reddit_comments(_landed(rows, SUBMISSION_COMMENT_JSON), _stamp(), limit=3)
    return out.select(
        "id", "parent_id", "text", "author", timing.to_iso(F.col("created_at")).alias("created_at"), "score"
    )


@query(
    "normalize_videos",
    f"""SELECT id, title, description, {sql_iso('created_at')} AS created_at, source AS channel
        FROM (SELECT *, 'video ' || source AS title, text AS description FROM posts)
        WHERE {_FOUND.format(sql_phrase("title || ' ' || description"))}""",
    ("posts",),
)
def normalize_videos(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        F.struct(F.col("id").alias("videoId")).alias("id"),
        F.struct(
            F.concat(F.lit("video "), "source").alias("title"),
            F.col("text").alias("description"),
            F.col("source").alias("channelTitle"),
            _iso_z(F.col("created_at")).alias("publishedAt"),
        ).alias("snippet"),
    )
    rows = d.long_posts(spark, sf).select(F.array(item).alias("items"))
    out = landed.normalize_videos(_landed(rows, VIDEO_SEARCH_JSON), _stamp(), d.KEYWORDS)
    return out.select("id", "title", "description", _iso_utc(F.col("created_at")).alias("created_at"), "channel")


@query(
    "normalize_video_comments",
    f"""SELECT parent_id AS video_id, id, text, role AS author, position AS likes,
               {sql_iso(f"TIMESTAMP '{d.DAY_ONE}' + to_minutes(CAST(position AS INTEGER))")} AS created_at
        FROM comments""",
    ("comments",),
)
def normalize_video_comments(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.lit(d.DAY_ONE).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("position").cast("int"))
    thread = F.struct(
        F.struct(
            F.struct(
                "id",
                F.struct(
                    F.col("text").alias("textDisplay"),
                    F.col("role").alias("authorDisplayName"),
                    _iso_z(stamp).alias("publishedAt"),
                    F.col("position").alias("likeCount"),
                ).alias("snippet"),
            ).alias("topLevelComment")
        ).alias("snippet")
    )
    rows = d.comments(spark, sf).select(F.col("parent_id").alias("video_id"), F.array(thread).alias("items"))
    out = landed.normalize_video_comments(_landed(rows, VIDEO_COMMENTS_JSON), _stamp())
    return out.select(
        "video_id", "id", "text", "author", "likes", _iso_utc(F.col("created_at")).alias("created_at")
    )


@query("video_stats", "SELECT video_id, views, likes, comments FROM video_counters", ("video_counters",))
def video_stats(spark: SparkSession, sf: str) -> DataFrame:
    return landed.video_stats(_landed(d.video_counters(spark, sf), VIDEO_STATS_JSON))


@query(
    "conform_posts",
    f"""SELECT id, platform, text, {sql_iso('created_at')} AS created_at, author_id,
               CAST(likes AS INTEGER) AS likes, CAST(retweets AS INTEGER) AS retweets,
               {sql_iso('collected_at')} AS collected_at, CAST(NULL AS VARCHAR) AS keywords
        FROM posts""",
    ("posts",),
)
def conform_posts(spark: SparkSession, sf: str) -> DataFrame:
    out = cf.conform_batch(d.posts(spark, sf))
    return out.select(
        "id", "platform", "text", timing.to_iso(F.col("created_at")).alias("created_at"), "author_id", "likes",
        "retweets", timing.to_iso(F.col("collected_at")).alias("collected_at"),
        F.array_join("keywords", ",").alias("keywords"),
    )


def _three_sources(spark: SparkSession, sf: str) -> list[DataFrame]:
    mixed = d.mixed_posts(spark, sf)
    own = {
        "twitter": ["id", "platform", "text", "created_at", "author_id", "likes", "retweets"],
        "reddit": ["id", "platform", "title", "text", "created_at", "author", "score"],
        "youtube": ["id", "platform", "title", "description", "created_at"],
    }
    return [mixed.filter(F.col("platform") == name).select(*columns) for name, columns in own.items()]


@query(
    "union_sources",
    f"""SELECT id, platform, text, title, description, {sql_iso('created_at')} AS created_at,
               CASE WHEN platform = 'twitter' THEN author_id END AS author_id, author,
               CASE WHEN platform = 'twitter' THEN likes END AS likes, score
        FROM mixed_posts""",
    ("posts", "mixed_posts"),
)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    return cf.union_sources(*_three_sources(spark, sf)).select(
        "id", "platform", "text", "title", "description", timing.to_iso(F.col("created_at")).alias("created_at"),
        "author_id", "author", "likes", "score",
    )


@query(
    "custom_source",
    """SELECT platform, count(*) AS posts FROM (
           SELECT platform FROM posts UNION ALL SELECT 'pages' FROM pages) GROUP BY platform""",
    ("posts",),
)
def custom_source(spark: SparkSession, sf: str) -> DataFrame:
    sources = cf.SourceRegistry()
    sources.add("posts", lambda df: df)
    sources.add(
        "pages",
        lambda df: df.select(
            F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("platform"), F.col("html").alias("text")
        ),
    )
    merged = sources.collect_all({"posts": d.posts(spark, sf), "pages": d.table(spark, sf, "pages")})
    return merged.groupBy("platform").agg(F.count("*").alias("posts"))


@query(
    "load_labelled",
    "SELECT text, label, split FROM labelled_texts WHERE split = 'validation'",
    ("gold", "labelled_texts"),
)
def load_labelled(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "labelled")
    d.labelled_texts(spark, sf).select("text", "label", "split").write.partitionBy("split").parquet(path)
    return lb.load_labelled(spark, path, "validation")


@query("rename_labels", "SELECT label AS labels, split FROM gold", ("gold",))
def rename_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lb.rename_labels(d.labelled_texts(spark, sf).select("text", "label", "split"))


_MATCH_SQL = f"""SELECT id, keyword FROM posts, (SELECT unnest(['{"','".join(d.KEYWORDS)}']) AS keyword)
        WHERE contains({sql_phrase('text')}, ' ' || keyword || ' ')"""


@query("keyword_match", _MATCH_SQL, ("posts",))
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    return each(d.long_posts(spark, sf), kw.matched_keywords(F.col("text"), d.KEYWORDS), "id", name="keyword")


@query("keyword_table_match", _MATCH_SQL, ("posts",))
def keyword_table_match(spark: SparkSession, sf: str) -> DataFrame:
    return kw.match_keyword_table(d.long_posts(spark, sf), kw.keyword_table(spark, d.KEYWORDS))


_VERSIONS_SQL = f"""SELECT platform, date_trunc('day', created_at) AS valid_from,
                           [min(source), '{d.KEYWORDS[0]}', '{d.KEYWORDS[1]}'] AS keywords
                    FROM posts WHERE dayofmonth(created_at) % 3 = 2 GROUP BY 1, 2"""


@query(
    "keyword_asof",
    f"""SELECT p.id, p.platform, array_to_string(v.keywords, ',') AS keywords,
               array_to_string(list_filter(coalesce(v.keywords, []), lambda w: contains({sql_phrase('p.text')}, {sql_phrase('w')})), ',') AS matched
        FROM posts p ASOF LEFT JOIN ({_VERSIONS_SQL}) v ON p.platform = v.platform AND p.created_at >= v.valid_from""",
    ("posts",),
)
def keyword_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Posts against the keyword list of their platform that was valid when they were made."""
    posts = d.long_posts(spark, sf)
    listed = F.array(F.min("source"), F.lit(d.KEYWORDS[0]), F.lit(d.KEYWORDS[1])).alias("keywords")
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("valid_from")
    versions = posts.filter(F.dayofmonth("created_at") % 3 == 2).groupBy("platform", day).agg(listed)
    found = kw.keywords_as_of(posts.select("id", "platform", "text", "created_at"), versions)
    return found.select("id", "platform", F.array_join("keywords", ",").alias("keywords"), F.array_join("matched", ",").alias("matched"))


_LONG_SQL = """SELECT DISTINCT array_to_string(w[1:200], ' ') AS keyword
               FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
                     FROM documents WHERE doc_id % 40 = 0) WHERE len(w) > 0"""


@query(
    "keyword_phrases",
    f"SELECT id, md5(keyword) AS phrase FROM posts, ({_LONG_SQL}) WHERE contains({sql_phrase('text')}, ' ' || keyword || ' ')",
    ("posts",),
)
def keyword_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of up to 200 words, the beginnings of some texts, in all posts."""
    posts = d.long_posts(spark, sf)
    said = F.split(F.trim(tx.phrase_text(F.col("text"))), " ")
    made = d.texts(spark, sf).filter(F.col("doc_id") % 40 == 0).select(F.array_join(F.slice(said, 1, 200), " ").alias("keyword"))
    found = kw.match_keyword_table(posts, made.filter("keyword <> ''").distinct())
    return found.select("id", F.md5("keyword").alias("phrase"))


@query("clean_posts", "SELECT doc_id, text FROM documents WHERE length(text) > 10")
def clean_posts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_posts(d.table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "post_metadata",
    f"""SELECT doc_id, '{d.AS_OF.replace(' ', 'T')}' AS processing_time, CAST(length(text) AS INTEGER) AS text_length,
               CAST(len(string_split(text, ' ')) AS INTEGER) AS word_count FROM documents""",
)
def post_metadata(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.post_metadata(d.table(spark, sf, "documents"), d.AS_OF)
    return out.select(
        "doc_id", timing.to_iso(F.col("processing_time")).alias("processing_time"), "text_length", "word_count"
    )


@query(
    "text_fallback",
    """SELECT id, platform, coalesce(nullif(text, ''), nullif(title, ''), nullif(description, '')) AS text
       FROM mixed_posts WHERE coalesce(nullif(text, ''), nullif(title, ''), nullif(description, '')) IS NOT NULL""",
    ("posts", "mixed_posts"),
)
def text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.text_fallback(d.mixed_posts(spark, sf)).select("id", "platform", "text")


@query("english_only", "SELECT id, lang, author_id FROM posts WHERE lang = 'en'", ("posts",))
def english_only(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.english_only(d.posts(spark, sf)).select("id", "lang", "author_id")


@query(
    "quarantine",
    """SELECT page_id, CASE WHEN page_id % 11 = 0 AND page_id % 7 <> 0 THEN 'bad' ELSE 'good' END AS part,
              CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL ELSE length(html) END AS likes
       FROM pages""",
)
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.video_counters(spark, sf).select(F.col("video_id").alias("id"), F.col("viewCount").alias("likes"))
    good, bad = cf.split_quarantine(rows, cf.unreadable(rows))
    marked = cf.conform(good).withColumn("part", F.lit("good")).unionByName(
        cf.conform(bad).withColumn("part", F.lit("bad"))
    )
    return marked.select(F.col("id").cast("bigint").alias("page_id"), "part", "likes")


@query(
    "skipped_results",
    """SELECT CASE WHEN has_sentiment THEN 'kept' ELSE 'skipped' END AS part, count(*) AS rows
       FROM messy_results GROUP BY 1""",
    ("results", "messy_results"),
)
def skipped_results(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(cleaning.has_sentiment(), "kept").otherwise("skipped")
    return d.messy_results(spark, sf).groupBy(part.alias("part")).agg(F.count("*").alias("rows"))


@query(
    "spam_flags",
    """SELECT doc_id, round(marks / words, 6) AS mark_ratio, copies AS repeats_over_limit,
              marks / words > 0.5 OR copies > 0 AS is_spam
       FROM (SELECT doc_id, greatest(len(string_split(text, ' ')), 1) AS words,
                    len(regexp_extract_all(text, 'http\\S+|www\\S+|@\\w+|#\\w+')) AS marks,
                    CASE WHEN count(*) OVER (PARTITION BY text) > 3 THEN count(*) OVER (PARTITION BY text) ELSE 0 END AS copies
             FROM documents)""",
)
def spam_flags(spark: SparkSession, sf: str) -> DataFrame:
    flagged = cleaning.spam_flags(d.texts(spark, sf), key="doc_id")
    return flagged.withColumn("mark_ratio", F.round("mark_ratio", 6))


@query(
    "pseudonymize",
    "SELECT id, sha256('pepper' || author_id) AS author_id FROM posts",
    ("posts",),
)
def pseudonymize(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.pseudonymize(d.posts(spark, sf), ["author_id"], "pepper").select("id", "author_id")


@query(
    "distinct_rows",
    f"""SELECT id, platform, {sql_iso('collected_at')} AS collected_at, likes
        FROM (SELECT DISTINCT * FROM collected_posts)""",
    ("posts", "collected_posts"),
)
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.distinct_rows(d.collected_posts(spark, sf)).select(
        "id", "platform", timing.to_iso(F.col("collected_at")).alias("collected_at"), "likes"
    )


@query(
    "dedup_posts",
    f"""SELECT id, platform, text, {sql_iso('collected_at')} AS collected_at, likes FROM (
            SELECT *, row_number() OVER (PARTITION BY platform, id ORDER BY collected_at DESC, text) AS n
            FROM collected_posts) WHERE n = 1""",
    ("posts", "collected_posts"),
)
def dedup_posts(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.dedup_posts(d.collected_posts(spark, sf)).select(
        "id", "platform", "text", timing.to_iso(F.col("collected_at")).alias("collected_at"), "likes"
    )


@query(
    "result_rows",
    f"""SELECT id AS post_id, platform, text, {sql_iso('created_at')} AS created_at,
               ['negative', 'neutral', 'positive'][doc_id % 3 + 1] AS label, '{d.AS_OF.replace(' ', 'T')}' AS processed_at,
               coalesce(nullif(author_id, ''), nullif(author, '')) AS author, coalesce(likes, 0) AS likes,
               coalesce(retweets, 0) AS retweets, coalesce(score, 0) AS score
        FROM mixed_posts""",
    ("posts", "mixed_posts"),
)
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    label = d.code_label(F.col("doc_id") % 3)
    scored = d.mixed_posts(spark, sf).withColumn("sentiment", F.struct(label.alias("label")))
    return scoring.result_rows(scored, d.AS_OF).select(
        "post_id", "platform", "text", timing.to_iso(F.col("created_at")).alias("created_at"),
        F.col("sentiment.label").alias("label"), timing.to_iso(F.col("processed_at")).alias("processed_at"),
        F.col("metadata.author_id").alias("author"), "metadata.likes", "metadata.retweets", "metadata.score",
    )


@query(
    "post_comment_counts",
    """SELECT posts.id, count(parent_id) AS comments FROM posts
       LEFT JOIN comments c ON c.parent_id = posts.id GROUP BY posts.id""",
    ("posts", "comments"),
)
def post_comment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.post_comment_counts(d.posts(spark, sf).select("id"), d.comments(spark, sf))


@query(
    "video_engagement",
    """SELECT id, coalesce(views, 0) AS views, coalesce(v.likes, 0) AS likes, coalesce(comments, 0) AS comments,
              CASE WHEN views > 0 THEN round_even((v.likes + comments) / views * 100, 2) END AS engagement
       FROM posts p LEFT JOIN video_counters v ON p.id = v.video_id""",
    ("posts", "video_counters"),
)
def video_engagement(spark: SparkSession, sf: str) -> DataFrame:
    stats = landed.video_stats(d.video_counters(spark, sf))
    return enrich.video_engagement(d.posts(spark, sf).select("id"), stats)


@query(
    "enriched_results",
    """SELECT p.platform, p.id AS post_id, r.label, p.lang, p.author_id, p.likes
       FROM scored_posts r JOIN posts p ON r.post_id = p.id AND r.platform = p.platform""",
    ("posts", "scored_posts"),
)
def enriched_results(spark: SparkSession, sf: str) -> DataFrame:
    scored = d.scored_posts(spark, sf).select(
        "platform", "post_id", F.col("sentiment.label").alias("label"), "processed_at"
    )
    return enrich.enriched_results(scored, d.posts(spark, sf)).drop("processed_at")


@query(
    "unprocessed_posts",
    """SELECT id, platform FROM posts WHERE NOT EXISTS (
           SELECT 1 FROM results r WHERE r.post_id = posts.id AND r.platform = posts.platform)""",
    ("posts", "results"),
)
def unprocessed_posts(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.unprocessed_posts(d.posts(spark, sf).select("id", "platform"), d.results(spark, sf))


@query(
    "ts_parse",
    f"""SELECT doc_id, {sql_iso('created_at')} AS from_epoch, {sql_iso('created_at')} AS from_iso FROM posts""",
    ("posts",),
)
def ts_parse(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return d.posts(spark, sf).select(
        "doc_id",
        timing.to_iso(timing.from_epoch(epoch)).alias("from_epoch"),
        timing.to_iso(timing.from_iso(timing.to_iso(F.col("created_at")))).alias("from_iso"),
    )


def _store(spark: SparkSession) -> sinks.Store:
    return sinks.Store(fresh_path(spark, "store"))


@query(
    "sink_raw_posts",
    "SELECT strftime(collected_at, '%Y-%m-%d') AS day, platform, count(*) AS rows, CAST(sum(likes) AS BIGINT) AS likes FROM posts GROUP BY 1, 2",
    ("posts",),
)
def sink_raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    for _ in range(2):  # the second write of the same batch must change nothing
        sinks.insert_raw_posts(d.posts(spark, sf), store, 0)
    stored = store.read(spark, "raw_posts").withColumn("day", timing.day_text(F.col("collected_at")))
    return stored.groupBy("day", "platform").agg(F.count("*").alias("rows"), F.sum("likes").alias("likes"))


@query(
    "sink_results",
    f"""SELECT post_id, platform, text, label, confidence, '{d.AS_OF.replace(' ', 'T')}' AS processed_at
        FROM scored_posts""",
    ("posts", "scored_posts"),
)
def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    sinks.insert_results(d.scored_posts(spark, sf), store, 0, d.AS_OF)
    return store.read(spark, "sentiment_results").select(
        "post_id", "platform", "text", "sentiment.label", "sentiment.confidence",
        timing.to_iso(F.col("processed_at")).alias("processed_at"),
    )


@query(
    "retention_keep",
    f"SELECT post_id FROM results WHERE processed_at >= TIMESTAMP '{d.AS_OF}' - INTERVAL 10 DAY",
    ("results",),
)
def retention_keep(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.retention_keep(d.results(spark, sf), "processed_at", d.AS_OF, days=10).select("post_id")


@query(
    "retention_deleted_counts",
    f"""SELECT 'raw_posts' AS table_name, count(*) AS deleted FROM posts
        WHERE collected_at < TIMESTAMP '{d.AS_OF}' - INTERVAL 10 DAY
        UNION ALL SELECT 'sentiment_results', count(*) FROM results
        WHERE processed_at < TIMESTAMP '{d.AS_OF}' - INTERVAL 10 DAY""",
    ("posts", "results"),
)
def retention_deleted_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.retention_deleted_counts(d.posts(spark, sf), d.results(spark, sf), d.AS_OF, days=10)


@query(
    "retention_applied",
    "SELECT id, platform FROM posts WHERE collected_at >= TIMESTAMP '2024-01-01 08:00:00'",
    ("posts",),
)
def retention_applied(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    sinks.insert_raw_posts(d.posts(spark, sf), store, 0)
    sinks.enforce_retention(spark, store, "raw_posts", "2024-01-31 08:00:00", days=30)
    return store.read(spark, "raw_posts").select("id", "platform")


@query(
    "layout_check",
    """SELECT label, count(*) AS rows FROM scored_posts
       WHERE platform = 'reddit' AND processed_at >= TIMESTAMP '2024-01-01' AND processed_at < TIMESTAMP '2024-01-02'
       GROUP BY label""",
    ("posts", "scored_posts"),
)
def layout_check(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    sinks.write_batch(d.scored_posts(spark, sf), store, "sentiment_results", 0)
    stored = store.read(spark, "sentiment_results")
    chosen = stored.filter((F.col("day") == "2024-01-01") & (F.col("platform") == "reddit"))
    return chosen.groupBy("sentiment.label").agg(F.count("*").alias("rows"))


@query(
    "export_results",
    "SELECT post_id, platform, label, confidence, text FROM scored_posts",
    ("posts", "scored_posts"),
)
def export_results(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export")
    flat = d.scored_posts(spark, sf).select(
        "post_id", "platform", "sentiment.label", "sentiment.confidence", "text"
    )
    sinks.export_results(flat, path, "json")
    return spark.read.schema(flat.schema).json(path)
