"""Queries over text: cleaning, tokens, lexicon scores, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as lb, text as tx
from ..operators import features, scoring
from ..operators.sizing import small_table
from ..session import kept_table
from . import derived as d
from .derived import sql_clean, sql_tokens
from .registry import query

_SCORED = "said JOIN lexicon USING (token)"


@query("clean_text", f"SELECT id, {sql_clean('text')} AS clean FROM posts", ("posts",))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return d.long_posts(spark, sf).select("id", tx.clean_text(F.col("text")).alias("clean"))


@query(
    "clean_text_social",
    rf"""SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(text), '{tx.in_unicode(tx.SOCIAL_LINK_OR_MENTION)}', '[URL]', 'g'),
               '{tx.in_unicode(tx.HASHTAG)}', '\1', 'g'), '{tx.in_unicode(r"^\s+|\s+$")}', '', 'g') AS clean FROM posts""",
    ("posts",),
)
def clean_text_social(spark: SparkSession, sf: str) -> DataFrame:
    return d.long_posts(spark, sf).select("id", tx.clean_text_social(F.col("text")).alias("clean"))


@query(
    "preprocess_tweet",
    rf"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
               '{tx.TWEET_LINK}', '[URL]', 'g'), '{tx.TWEET_WWW}', '[URL]', 'g'),
               '{tx.TWEET_MENTION}', '[USER]', 'g'), '{tx.TWEET_TAG}', '\1', 'g'), '{tx.in_unicode(r"\s+")}', ' ', 'g')) AS clean FROM posts""",
    ("posts",),
)
def preprocess_tweet(spark: SparkSession, sf: str) -> DataFrame:
    return d.long_posts(spark, sf).select("id", tx.preprocess_tweet(F.col("text")).alias("clean"))


@query(
    "tokenize",
    f"""SELECT id, len({sql_tokens('text')}) AS n_tokens, list_aggregate({sql_tokens('text')}, 'string_agg', '|') AS tokens
        FROM posts""",
    ("posts",),
)
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    cut = d.long_posts(spark, sf).select("id", tx.tokens(F.col("text")).alias("cut"))
    joined = F.when(F.size("cut") > 0, F.array_join("cut", "|"))
    return cut.select("id", F.size("cut").cast("bigint").alias("n_tokens"), joined.alias("tokens"))


@query(
    "preprocess",
    f"SELECT id, coalesce(list_aggregate({sql_tokens('text')}, 'string_agg', ' '), '') AS clean FROM posts",
    ("posts",),
)
def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return d.long_posts(spark, sf).select("id", tx.preprocess(F.col("text")).alias("clean"))


@query(
    "remove_stopwords",
    f"""SELECT token, count(*) AS n FROM said WHERE NOT list_contains([{", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS)}], token)
        GROUP BY token""",
    ("said",),
)
def remove_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    stop = small_table(spark, [(word,) for word in tx.STOPWORDS], ["token"])
    said = features.exploded_tokens(d.texts(spark, sf), "doc_id")
    return features.remove_stopwords(said, stop).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "lemmatize",
    """SELECT lemma, count(*) AS n FROM (
           SELECT CASE WHEN length(token) > 3 AND token LIKE '%s' THEN substr(token, 1, length(token) - 1)
                       ELSE token END AS lemma FROM said) GROUP BY lemma""",
    ("said",),
)
def lemmatize(spark: SparkSession, sf: str) -> DataFrame:
    """Words are counted before their lemmas are looked up: one row per word is joined, and texts are cut once."""
    counted = features.exploded_tokens(d.texts(spark, sf), "doc_id").groupBy("token").agg(F.count("*").alias("n"))
    said = kept_table(counted, "words")
    plural = said.filter((F.length("token") > 3) & F.col("token").endswith("s"))
    lemmas = plural.select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return features.lemmatize(said, lemmas).groupBy("lemma").agg(F.sum("n").alias("n"))


@query(
    "polarity_label",
    """SELECT event_id, p AS polarity, CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
              abs(p) AS confidence FROM (SELECT event_id, (event_id % 201 - 100) / 100 AS p FROM events)""",
)
def polarity_label(spark: SparkSession, sf: str) -> DataFrame:
    polarity = d.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 201 - 100) / 100).alias("polarity"))
    return polarity.withColumns(
        {
            "label": lb.polarity_label(F.col("polarity")),
            "confidence": lb.polarity_confidence(F.col("polarity")),
        }
    )


@query(
    "label_codes",
    """SELECT post_id, CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS code,
              CASE WHEN label <> 'mixed' THEN label END AS back FROM messy_results""",
    ("results", "messy_results"),
)
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = d.messy_results(spark, sf).select("post_id", lb.label_code(F.upper("sentiment.label")).alias("code"))
    return coded.withColumn("back", lb.code_label(F.col("code")))


@query(
    "argmax_label",
    """SELECT event_id, CAST(list_position([a, b, c], greatest(a, b, c)) - 1 AS INTEGER) AS code, greatest(a, b, c) AS confidence
       FROM (SELECT event_id, (event_id * 7 % 11) / 10 AS a, (event_id * 5 % 13) / 10 AS b, (event_id * 3 % 12) / 10 AS c
             FROM events)""",
)
def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("event_id")
    scores = F.array(*[(number * factor % modulus) / 10 for factor, modulus in ((7, 11), (5, 13), (3, 12))])
    return d.table(spark, sf, "events").select(
        "event_id", lb.argmax(scores).alias("code"), F.array_max(scores).alias("confidence")
    )


@query(
    "probability_struct",
    """SELECT event_id, (event_id % 3) / 10 AS negative, (event_id % 5) / 10 AS neutral, (event_id % 7) / 10 AS positive
       FROM events""",
)
def probability_struct(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("event_id")
    scores = F.array(*[(number % modulus) / 10 for modulus in (3, 5, 7)])
    named = d.table(spark, sf, "events").select("event_id", lb.probability_struct(scores).alias("p"))
    return named.select("event_id", "p.*")


@query(
    "lexicon_polarity",
    f"""SELECT doc_id, CAST(sum(polarity_points) AS DOUBLE) AS polarity_points,
               CAST(sum(subjectivity_points) AS DOUBLE) AS subjectivity_points, count(*) AS hits
        FROM {_SCORED} GROUP BY doc_id""",
    ("said", "lexicon"),
)
def lexicon_polarity(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.lexicon_polarity(d.texts(spark, sf), d.corpus_lexicon(spark, sf), ["doc_id"])


_SENTIMENT_SQL = f"""SELECT doc_id, polarity, subjectivity, abs(polarity) AS confidence,
        CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS label
        FROM (SELECT documents.doc_id, coalesce(CAST(p AS DOUBLE) / hits / 100, 0.0) AS polarity,
                     coalesce(CAST(s AS DOUBLE) / hits / 100, 0.0) AS subjectivity
              FROM documents LEFT JOIN (SELECT doc_id, sum(polarity_points) AS p, sum(subjectivity_points) AS s,
                                               count(*) AS hits FROM {_SCORED} GROUP BY doc_id) USING (doc_id))"""


@query("lexicon_sentiment", _SENTIMENT_SQL, ("said", "lexicon"))
def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    documents = d.texts(spark, sf).select("doc_id", "text")
    scored = scoring.lexicon_sentiment(documents, d.corpus_lexicon(spark, sf), ["doc_id"], unique=True)
    return scored.select(
        "doc_id", "sentiment.label", "sentiment.polarity", "sentiment.subjectivity", "sentiment.confidence"
    )


@query(
    "score_posts",
    f"""SELECT post_id, platform, text, s.label, s.polarity, author_id, likes, retweets, score
        FROM scored_posts JOIN ({_SENTIMENT_SQL}) s ON post_id = CAST(s.doc_id AS VARCHAR)""",
    ("said", "lexicon", "posts", "scored_posts"),
)
def score_posts(spark: SparkSession, sf: str) -> DataFrame:
    scorer = scoring.lexicon_scorer(d.corpus_lexicon(spark, sf))
    return scoring.score_posts(d.long_posts(spark, sf), scorer, d.AS_OF).select(
        "post_id", "platform", "text", "sentiment.label", "sentiment.polarity", "metadata.*"
    )


@query(
    "score_with_callable",
    """SELECT id, CASE WHEN n % 3 = 0 THEN 'negative' WHEN n % 3 = 1 THEN 'neutral' ELSE 'positive' END AS label,
              (n % 100) / 100 AS confidence FROM (SELECT id, length(text) AS n FROM posts)""",
    ("posts",),
)
def score_with_callable(spark: SparkSession, sf: str) -> DataFrame:
    def by_length(texts):
        import pandas as pd

        n = texts.str.len()
        names = {0: "negative", 1: "neutral", 2: "positive"}
        return pd.DataFrame({"label": (n % 3).map(names), "confidence": n % 100 / 100}, index=texts.index)

    scored = scoring.callable_scorer(by_length, ["id"])(d.long_posts(spark, sf))
    return scored.select("id", "sentiment.label", "sentiment.confidence")


@query("batched_map", "SELECT doc_id, upper(lang) || '/' || source AS tag FROM documents")
def batched_map(spark: SparkSession, sf: str) -> DataFrame:
    def tag(batch):
        return batch.assign(tag=batch["lang"].str.upper() + "/" + batch["source"])[["doc_id", "tag"]]

    rows = d.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return scoring.map_batches(rows, tag, "doc_id bigint, tag string")


@query(
    "error_capture",
    """SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS payload,
              CASE WHEN event_type = 'error' THEN 'ValueError: refused ' || user_id END AS error FROM events""",
)
def error_capture(spark: SparkSession, sf: str) -> DataFrame:
    def shout(row: dict) -> str:
        if row["event_type"] == "error":
            raise ValueError(f"refused {row['user_id']}")
        return row["event_type"].upper()

    rows = d.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return scoring.capture_errors(rows, shout, "event_id")


@query("ngrams", "SELECT term, count(*) AS n FROM terms GROUP BY term", ("terms",))
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    said = features.ngrams(d.texts(spark, sf), "doc_id")
    return said.groupBy("term").agg(F.count("*").alias("n"))


@query("vocabulary", "SELECT term, corpus_tf, df FROM vocab", ("terms", "counts", "vocab"))
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return features.vocabulary(features.vocabulary_counts(d.texts(spark, sf), "doc_id"))


@query(
    "tfidf",
    """SELECT doc_id, term, tf, df, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM (
           SELECT doc_id, term, tf, df, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS w
           FROM counts JOIN vocab USING (term))""",
    ("terms", "counts", "vocab"),
)
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return features.tfidf(d.texts(spark, sf), "doc_id")


@query(
    "training_frame",
    f"SELECT doc_id, coalesce(list_aggregate({sql_tokens('text')}, 'string_agg', ' '), '') AS clean, y FROM labelled_texts",
    ("gold", "labelled_texts"),
)
def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    named = d.labelled_texts(spark, sf).select("doc_id", "text", "label")
    return features.training_frame(named).select("doc_id", "clean", "y")


@query(
    "pad_sequences",
    """SELECT doc_id, list_aggregate(list_concat(ids, [0 for i in range(longest - len(ids))]), 'string_agg', ',') AS input_ids,
              list_aggregate(list_concat([1 for i in ids], [0 for i in range(longest - len(ids))]), 'string_agg', ',') AS attention_mask
       FROM (SELECT *, max(len(ids)) OVER (PARTITION BY source) AS longest FROM (
           SELECT doc_id, source, [length(w) for w in list_slice(string_split(text, ' '), 1, 128)] AS ids FROM documents))""",
)
def pad_sequences(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda word: F.length(word))
    rows = d.texts(spark, sf).select("doc_id", "source", ids.alias("input_ids"))
    padded = features.pad_sequences(rows, batch=["source"])
    as_text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "attention_mask")]
    return padded.select("doc_id", *as_text)
