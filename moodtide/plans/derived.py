"""Posts, results, comments and logs derived from the given tables, in Spark and in SQL.

Every frame covers its whole source table. Times keep the type without zone that the
``events`` table has, so no conversion stands between a filter and the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import stable_hash
from ..functions.labels import code_label
from ..functions.text import JOINED_PAIRS, PLAIN_LINK, SPACES, STOPWORDS, in_unicode, words
from ..operators.sizing import each, widened
from ..session import fresh_path
from ..schemas import PROBABILITIES

AS_OF = "2024-01-31 00:00:00"
DAY_ONE = "2024-01-01 00:00:00"
KEYWORDS = ("the", "elle un", "src3")
SUBREDDITS = ("src1", "src4", "src7")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread over the cores where their file is too small to be split."""
    return widened(table(spark, sf, "documents"))


def _after_day_one(minutes: Column) -> Column:
    return F.lit(DAY_ONE).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def _platform(number: str) -> Column:
    return F.when(F.col(number) % 3 == 0, "twitter").when(F.col(number) % 3 == 1, "reddit").otherwise("youtube")


def _no_probabilities() -> Column:
    return F.lit(None).cast(PROBABILITIES).alias("probabilities")


def _sentiment(label: Column, confidence: Column) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(
        label.alias("label"),
        nothing.alias("polarity"),
        nothing.alias("subjectivity"),
        confidence.alias("confidence"),
        _no_probabilities(),
    )


def posts_from(documents: DataFrame) -> DataFrame:
    number, text_id = F.col("doc_id"), F.col("doc_id").cast("string")
    created = _after_day_one(number % 43200)
    return documents.select(
        "doc_id",
        text_id.alias("id"),
        _platform("doc_id").alias("platform"),
        F.concat(
            "text", F.lit(" #"), "source", F.lit(" #"), "lang", F.lit(" @"), "lang",
            F.lit("_user https://ex.com/"), text_id, F.lit("?a=1"),
        ).alias("text"),
        created.alias("created_at"),
        (created + F.make_dt_interval(mins=F.lit(5))).alias("collected_at"),
        F.when(number % 10 != 0, F.concat(F.lit("u"), (number % 97).cast("string"))).alias("author_id"),
        (F.col("n_chars") % 500).alias("likes"),
        (F.col("n_chars") % 50).alias("retweets"),
        (F.col("n_chars") % 7).alias("score"),
        "lang",
        "source",
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts_from(table(spark, sf, "documents"))


def long_posts(spark: SparkSession, sf: str) -> DataFrame:
    """The same posts for queries that work on their text."""
    return posts_from(texts(spark, sf))


def mixed_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts as the sources give them: link posts without text, videos with a description only."""
    base = posts(spark, sf)
    video, forum = F.col("platform") == "youtube", F.col("platform") == "reddit"
    nothing = F.lit(None).cast("string")
    return base.select(
        "doc_id",
        "id",
        "platform",
        F.when(video, nothing).when(forum & (F.col("doc_id") % 5 == 0), "").otherwise(F.col("text")).alias("text"),
        F.when(forum, F.concat(F.lit("about "), "source"))
        .when(video & (F.col("doc_id") % 2 == 0), F.concat(F.lit("video "), "source"))
        .when(video, "")
        .alias("title"),
        F.when(video, F.col("text")).alias("description"),
        "created_at",
        "collected_at",
        F.when(~forum, F.col("author_id")).alias("author_id"),
        F.when(forum, F.concat(F.lit("r"), (F.col("doc_id") % 31).cast("string"))).alias("author"),
        F.when(~forum, F.col("likes")).alias("likes"),
        F.when(~forum, F.col("retweets")).alias("retweets"),
        F.when(forum, F.col("score")).alias("score"),
        "lang",
    )


def collected_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Every post found three times: twice in the same moment and once ten minutes later."""
    found = F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("again")
    return posts(spark, sf).select("*", found).select(
        "id",
        "platform",
        "text",
        "created_at",
        (F.col("collected_at") + F.make_dt_interval(mins=F.col("again") * 10)).alias("collected_at"),
        (F.col("likes") + F.col("again")).alias("likes"),
    )


def scored_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts in the result layout, with label and confidence taken from a hash of the id."""
    h = stable_hash(F.col("doc_id"))
    return posts(spark, sf).select(
        F.col("id").alias("post_id"),
        "platform",
        "text",
        "created_at",
        _sentiment(code_label(h % 3), (h % 1000) / 1000).alias("sentiment"),
        (F.col("created_at") + F.make_dt_interval(hours=F.lit(1))).alias("processed_at"),
        F.struct("author_id", "likes", "retweets", "score").alias("metadata"),
    )


def results_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "error", "negative").when(kind.isin("view", "signup"), "neutral").otherwise("positive")
    return events.select(
        F.col("event_id").cast("string").alias("post_id"),
        "event_id",
        "user_id",
        _platform("user_id").alias("platform"),
        _sentiment(label, F.col("value") / 500).alias("sentiment"),
        F.col("ts").alias("processed_at"),
        F.array(kind, F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string"))).alias("keywords"),
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    return results_from(table(spark, sf, "events"))


def messy_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results in which some labels are missing, some unknown, and some sentiments absent."""
    label = (
        F.when(F.col("user_id") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("user_id") % 13 == 0, "mixed")
        .otherwise(F.col("sentiment.label"))
    )
    rebuilt = F.when(F.col("user_id") % 17 != 0, _sentiment(label, F.col("sentiment.confidence")))
    return results(spark, sf).withColumn("sentiment", rebuilt)


def comments(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return table(spark, sf, "conversations").select(
        F.concat(conv, F.lit("_"), turn).alias("id"),
        conv.alias("parent_id"),
        F.col("turn").alias("position"),
        "role",
        "text",
    )


def video_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters as text: some missing, some unreadable."""
    number = F.col("page_id")
    return table(spark, sf, "pages").select(
        number.cast("string").alias("video_id"),
        F.when(number % 7 == 0, F.lit(None).cast("string"))
        .when(number % 11 == 0, "n/a")
        .otherwise(F.length("html").cast("string"))
        .alias("viewCount"),
        (number * 3).cast("string").alias("likeCount"),
        F.length("url").cast("string").alias("commentCount"),
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Class codes and splits of the labelled texts, and predictions that are right most of the time."""
    number, h = F.col("doc_id"), stable_hash(F.col("doc_id"))
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    part = number % 10
    return (
        table(spark, sf, "labels")
        .withColumn("y", y)
        .select(
            "doc_id",
            "y",
            F.when(h % 10 < 7, F.col("y")).otherwise((h % 3).cast("int")).alias("yhat"),
            F.when(part < 8, "train").when(part == 8, "validation").otherwise("test").alias("split"),
            _after_day_one(number % 30 * 1440).alias("predicted_at"),
        )
    )


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with label names, class codes and splits; both sides have one row per document."""
    marked = gold(spark, sf).withColumn("label", code_label(F.col("y")))
    return texts(spark, sf).select("doc_id", "text").join(marked, "doc_id")


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("operation"),
        F.col("value").alias("duration"),
        F.col("ts").alias("timestamp"),
    )


def host_samples(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("event_id")

    def percent(factor: int) -> Column:
        return F.when(number % 50 != 0, (number * factor % 101).cast("double"))

    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        percent(7).alias("cpu_percent"),
        percent(13).alias("memory_percent"),
        percent(29).alias("disk_usage"),
    )


def errors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 4 == 0, "Timeout").when(k % 4 == 1, "RateLimit").when(k % 4 == 2, "Unauthorized").otherwise("Other")
    message = (
        F.when(k % 4 == 0, "Connection timeout")
        .when(k % 4 == 1, "429 Too Many Requests")
        .when(k % 4 == 2, "Unauthorized")
        .otherwise("weird")
    )
    return table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        "event_id",
        F.concat_ws("_", F.concat(F.lit("api"), (k % 3).cast("string")), kind).alias("error_key"),
        message.alias("message"),
        F.col("ts").alias("timestamp"),
    )


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    evaluated = kind == "purchase"
    return table(spark, sf, "events").select(
        number.alias("step"),
        F.when(kind == "view", F.col("value")).alias("loss"),
        F.when(evaluated, F.col("value") / 2).alias("eval_loss"),
        F.when(evaluated, (number * 37 % 1000) / 1000).alias("eval_accuracy"),
    )


def corpus_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Points for about a fifth of the corpus' words, taken from a hash of the word.

    Written as a table, as a lexicon would be, so that its readers know its size. The test names the count, so that a
    word is hashed once, after the fold, and not each time it is said.
    """
    said = each(texts(spark, sf), words(F.col("text")), name="token").groupBy("token").agg(F.count("*").alias("n"))
    h = stable_hash(F.col("token"))
    path = fresh_path(spark, "lexicon")
    said.filter(F.when(F.col("n") > 0, h % 5 == 0)).select(
        "token",
        (h % 201 - 100).cast("int").alias("polarity_points"),
        (h % 101).cast("int").alias("subjectivity_points"),
    ).write.parquet(path)
    return spark.read.parquet(path)


_PLATFORM = "CASE {0} % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'youtube' END"
_LABEL_OF = "CASE {0} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END"


def sql_hash(value: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({value} AS VARCHAR)), 1, 8) AS BIGINT)"


def sql_clean(text: str) -> str:
    """The cleaning recipe, pass by pass, over the patterns of ``functions.text``."""
    out = f"lower(coalesce({text}, ''))"
    for pattern in (PLAIN_LINK, r"@\w+|#\w+"):
        out = f"regexp_replace({out}, '{in_unicode(pattern)}', '', 'g')"
    out = f"regexp_replace({out}, '[^a-zA-Z{SPACES}]', '', 'g')"
    return f"trim(regexp_replace({out}, '[{SPACES}]+', ' ', 'g'))"


def sql_words(text: str) -> str:
    return f"[w for w in string_split({sql_clean(text)}, ' ') if w <> '']"


def sql_tokens(text: str) -> str:
    stop = ", ".join("'" + word.replace("'", "''") + "'" for word in STOPWORDS)
    spaced = rf"regexp_replace({sql_clean(text)}, '{JOINED_PAIRS}', '\1\3\5\7 \2\4\6\8', 'g')"
    return f"[w for w in string_split({spaced}, ' ') if w <> '' AND w NOT IN ({stop})]"


def sql_phrase(text: str) -> str:
    return rf"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def sql_iso(stamp: str) -> str:
    return f"strftime({stamp}, '%Y-%m-%dT%H:%M:%S')"


VIEWS = {
    "posts": f"""
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_PLATFORM.format('doc_id')} AS platform,
               text || ' #' || source || ' #' || lang || ' @' || lang || '_user https://ex.com/' || doc_id || '?a=1' AS text,
               TIMESTAMP '{DAY_ONE}' + to_minutes(CAST(doc_id % 43200 AS INTEGER)) AS created_at,
               TIMESTAMP '{DAY_ONE}' + to_minutes(CAST(doc_id % 43200 + 5 AS INTEGER)) AS collected_at,
               CASE WHEN doc_id % 10 <> 0 THEN 'u' || (doc_id % 97) END AS author_id,
               n_chars % 500 AS likes, n_chars % 50 AS retweets, n_chars % 7 AS score, lang, source
        FROM documents""",
    "mixed_posts": """
        SELECT doc_id, id, platform,
               CASE WHEN platform = 'youtube' THEN NULL WHEN platform = 'reddit' AND doc_id % 5 = 0 THEN '' ELSE text END AS text,
               CASE WHEN platform = 'reddit' THEN 'about ' || source
                    WHEN platform = 'youtube' AND doc_id % 2 = 0 THEN 'video ' || source
                    WHEN platform = 'youtube' THEN '' END AS title,
               CASE WHEN platform = 'youtube' THEN text END AS description,
               created_at, collected_at,
               CASE WHEN platform <> 'reddit' THEN author_id END AS author_id,
               CASE WHEN platform = 'reddit' THEN 'r' || (doc_id % 31) END AS author,
               CASE WHEN platform <> 'reddit' THEN likes END AS likes,
               CASE WHEN platform <> 'reddit' THEN retweets END AS retweets,
               CASE WHEN platform = 'reddit' THEN score END AS score,
               lang
        FROM posts""",
    "collected_posts": """
        SELECT id, platform, text, created_at, collected_at + to_minutes(CAST(again * 10 AS INTEGER)) AS collected_at,
               likes + again AS likes
        FROM posts, (VALUES (0), (0), (1)) AS found(again)""",
    "scored_posts": f"""
        SELECT id AS post_id, platform, text, created_at,
               {_LABEL_OF.format(sql_hash('doc_id') + ' % 3')} AS label,
               ({sql_hash('doc_id')} % 1000) / 1000 AS confidence,
               created_at + INTERVAL 1 HOUR AS processed_at, author_id, likes, retweets, score
        FROM posts""",
    "results": f"""
        SELECT CAST(event_id AS VARCHAR) AS post_id, event_id, user_id, event_type, {_PLATFORM.format('user_id')} AS platform,
               CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('view', 'signup') THEN 'neutral'
                    ELSE 'positive' END AS label,
               value / 500 AS confidence, ts AS processed_at, 'k' || (user_id % 5) AS keyword
        FROM events""",
    "messy_results": """
        SELECT post_id, platform, processed_at, confidence, user_id % 17 <> 0 AS has_sentiment,
               CASE WHEN user_id % 17 = 0 OR user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 'mixed' ELSE label END AS label
        FROM results""",
    "comments": """
        SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS parent_id, turn AS position, role, text
        FROM conversations""",
    "video_counters": """
        SELECT CAST(page_id AS VARCHAR) AS video_id,
               CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 0 ELSE length(html) END AS views,
               page_id * 3 AS likes, length(url) AS comments
        FROM pages""",
    "gold": f"""
        SELECT doc_id, y, CASE WHEN h % 10 < 7 THEN y ELSE CAST(h % 3 AS INTEGER) END AS yhat,
               CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
               TIMESTAMP '{DAY_ONE}' + to_days(CAST(doc_id % 30 AS INTEGER)) AS predicted_at,
               {_LABEL_OF.format('y')} AS label
        FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS y,
                     {sql_hash('doc_id')} AS h FROM labels)""",
    "labelled_texts": "SELECT g.*, d.text FROM gold g JOIN documents d USING (doc_id)",
    "timings": "SELECT event_id, event_type AS operation, value AS duration, ts AS timestamp FROM events",
    "host_samples": """
        SELECT event_id, ts AS timestamp,
               CASE WHEN event_id % 50 <> 0 THEN CAST(event_id * 7 % 101 AS DOUBLE) END AS cpu_percent,
               CASE WHEN event_id % 50 <> 0 THEN CAST(event_id * 13 % 101 AS DOUBLE) END AS memory_percent,
               CASE WHEN event_id % 50 <> 0 THEN CAST(event_id * 29 % 101 AS DOUBLE) END AS disk_usage
        FROM events""",
    "errors": """
        SELECT event_id, 'api' || (k % 3) || '_' || ['Timeout', 'RateLimit', 'Unauthorized', 'Other'][k % 4 + 1] AS error_key,
               ['Connection timeout', '429 Too Many Requests', 'Unauthorized', 'weird'][k % 4 + 1] AS message,
               ts AS timestamp
        FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
              FROM events WHERE event_type = 'error')""",
    "training_log": """
        SELECT event_id AS step, CASE WHEN event_type = 'view' THEN value END AS loss,
               CASE WHEN event_type = 'purchase' THEN value / 2 END AS eval_loss,
               CASE WHEN event_type = 'purchase' THEN (event_id * 37 % 1000) / 1000 END AS eval_accuracy
        FROM events""",
    "said": f"""
        SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS position
        FROM (SELECT doc_id, {sql_words('text')} AS words FROM documents)""",
    "lexicon": f"""
        SELECT token, h % 201 - 100 AS polarity_points, h % 101 AS subjectivity_points
        FROM (SELECT token, {sql_hash('token')} AS h FROM (SELECT DISTINCT token FROM said)) WHERE h % 5 = 0""",
    "terms": f"""
        SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) AS term
        FROM (SELECT doc_id, [w for w in {sql_tokens('text')} if length(w) > 1] AS t FROM documents)""",
    "counts": "SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term",
    "vocab": """
        SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_tf, count(*) AS df FROM counts
        GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 5000""",
}
