"""Lexicon scoring and the scorer protocol: posts in, posts with a ``sentiment`` struct out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import settings
from ..functions import text as tx
from ..functions.labels import polarity_confidence, polarity_label
from ..schemas import SENTIMENT
from .sizing import NULL_PARTS, SAMPLED, each, is_small, salted_lookup, small_table, spread

Scorer = Callable[[DataFrame], DataFrame]

# A short list of plain opinion words with hundredths of polarity and subjectivity. It is a
# starting point; callers pass their own table of the same three columns.
STARTER_LEXICON = (
    ("amazing", 60, 90), ("awesome", 90, 90), ("awful", -90, 90), ("bad", -65, 65), ("beautiful", 80, 90),
    ("best", 90, 40), ("boring", -60, 80), ("broken", -40, 40), ("disappointed", -65, 70),
    ("disappointing", -60, 70), ("excellent", 90, 90), ("fantastic", 70, 80), ("good", 65, 60),
    ("great", 75, 70), ("happy", 75, 85), ("hate", -75, 85), ("helpful", 45, 40), ("horrible", -90, 90),
    ("love", 60, 65), ("nice", 55, 85), ("perfect", 90, 90), ("poor", -45, 60), ("sad", -50, 85),
    ("slow", -30, 40), ("terrible", -90, 90), ("useful", 35, 20), ("useless", -50, 50), ("worst", -90, 90),
    ("wonderful", 90, 90), ("wrong", -50, 70),
)
#: Bytes of text that a scorer's Python function is given at once, about.
TEXT_BYTES = 1 << 20
#: Most words whose entries are sent to the rows where a lexicon is too large for that, and the longest of them.
SENT_WORDS = 1 << 16
SENT_LENGTH = 64
NEGATORS = ("not", "no", "never", "cannot")


def starter_lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, STARTER_LEXICON, ["token", "polarity_points", "subjectivity_points"])


def _scored_words(posts: DataFrame, keys: Sequence[str], negators: Sequence[str]) -> DataFrame:
    """One row per word with the factor its polarity is taken by: -0.5 right after a negator, else 1."""
    if not negators:
        return each(posts, tx.words(F.col("text")), *keys, name="token").withColumn("factor", F.lit(1.0))
    said = posts.select(*keys, tx.words(F.col("text")).alias("said"))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("said")), F.lit(1), F.size("said"))
    pairs = F.zip_with("said", before, lambda word, last: F.struct(word.alias("token"), last.alias("last")))
    paired = each(said, pairs, *keys, name="pair")
    factor = F.when(F.col("pair.last").isin(*negators), -0.5).otherwise(1.0)
    return paired.select(*keys, "pair.token", factor.alias("factor"))


def _points(lexicon: DataFrame) -> DataFrame:
    """One row per word of a lexicon: the sums of its entries and their number."""
    return lexicon.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.sum("polarity_points").alias("p"), F.sum("subjectivity_points").alias("s"), F.count("*").alias("n")
    )


def _frequent_words(posts: DataFrame) -> DataFrame:
    """The words said most often in a sample of the posts; the sample only chooses how words travel."""
    seen = posts.sample(min(1.0, SAMPLED / max(settings.HOT_KEY_ROWS, 1)), seed=7)
    counted = each(seen, tx.words(F.col("text")), name="token").groupBy("token").count()
    short = counted.filter(F.length("token") <= SENT_LENGTH)
    return short.orderBy(F.col("count").desc(), "token").limit(SENT_WORDS).select("token")


def _polarity_by_frequency(posts: DataFrame, lexicon: DataFrame, keys: Sequence[str], negators: Sequence[str]) -> DataFrame:
    """The sums of ``lexicon_polarity`` with a lexicon of any size, in one pass over the texts.

    Entries of the most frequent words are sent to the rows, as is the fact that such a word has none. So each task
    adds up nearly all words of its posts; only the rare others travel, once per post, to meet their entries.
    """
    points = _points(lexicon)
    sent = _frequent_words(posts).join(points, "token", "left").withColumn("sent", F.lit(True))
    met = _scored_words(posts, keys, negators).join(F.broadcast(sent), "token", "left")
    rare = F.when(F.col("sent").isNull(), F.col("token")).alias("_rare")
    folded = met.filter(F.col("sent").isNull() | F.col("n").isNotNull()).groupBy(*keys, rare).agg(
        F.sum(F.col("factor") * F.col("p")).alias("p_sum"),
        F.sum("s").alias("s_sum"),
        F.sum("n").alias("n_sum"),
        F.sum("factor").alias("factors"),
        F.count("*").alias("times"),
    )
    own = F.concat(F.lit(" "), spread(keys, NULL_PARTS).cast("string"))  # no word, so it meets no entry
    found = folded.withColumn("token", F.coalesce("_rare", own)).join(points, "token", "left")

    def either(travelled: Column, stayed: str) -> Column:
        return F.when(F.col("_rare").isNotNull(), travelled).otherwise(F.col(stayed))

    summed = found.groupBy(*keys).agg(
        F.sum(either(F.col("factors") * F.col("p"), "p_sum")).alias("polarity_points"),
        F.sum(either(F.col("times") * F.col("s"), "s_sum")).cast("double").alias("subjectivity_points"),
        F.sum(either(F.col("times") * F.col("n"), "n_sum")).alias("hits"),
    )
    return summed.filter(F.col("hits").isNotNull())


def lexicon_polarity(posts: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("platform", "id"),
                     negators: Sequence[str] = ()) -> DataFrame:
    """Sums of the lexicon points of each post's words and the number of words found.

    A lexicon within the lookup bounds is sent to the rows. Of a larger one the entries of frequent words are sent, and
    rare words travel. Posts without any known word have no row.
    """
    if not is_small(lexicon):
        return _polarity_by_frequency(posts, lexicon, keys, negators)
    known = _scored_words(posts, keys, negators).join(F.broadcast(lexicon), ["token"])
    return known.groupBy(*keys).agg(
        F.sum(F.col("factor") * F.col("polarity_points")).alias("polarity_points"),
        F.sum("subjectivity_points").cast("double").alias("subjectivity_points"),
        F.count("*").alias("hits"),
    )


def _lexicon_struct() -> Column:
    polarity = F.coalesce(F.col("polarity_points") / F.col("hits") / 100, F.lit(0.0))
    subjectivity = F.coalesce(F.col("subjectivity_points") / F.col("hits") / 100, F.lit(0.0))
    return F.struct(
        polarity_label(polarity).alias("label"),
        polarity.alias("polarity"),
        subjectivity.alias("subjectivity"),
        polarity_confidence(polarity).alias("confidence"),
        F.lit(None).cast(SENTIMENT["probabilities"].dataType).alias("probabilities"),
    ).alias("sentiment")


def lexicon_sentiment(posts: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("platform", "id"),
                      negators: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """The sentiment struct beside every post, zero polarity where no word is known.

    Every row is scored by its own text alone, whatever its keys. A lexicon within the lookup bounds is sent to the
    rows, which are not moved. With a larger one, rare words and sums travel: the text's MD5 then identifies a text,
    and copies of it, which share their mean, are spread over tasks; with ``unique`` the caller vouches that no text is
    held very many times, which saves looking for such. Both ways give the same rows; ``keys`` are kept for callers
    that name them.
    """
    if is_small(lexicon):
        return _scored_in_place(posts, lexicon, negators)
    marked = posts.withColumn("_said", F.unhex(F.md5("text")))
    points = lexicon_polarity(marked, lexicon, ["_said"], negators)
    joined = marked.join(points, "_said", "left") if unique else salted_lookup(marked, points, ["_said"], spread_on=list(posts.columns))
    return joined.withColumn("sentiment", _lexicon_struct()).select(*posts.columns, "sentiment")


def _scored_in_place(posts: DataFrame, lexicon: DataFrame, negators: Sequence[str]) -> DataFrame:
    """The sums of each row from its own words; entries that a lexicon repeats count as often.

    All words of a batch are looked up at once and summed by row.
    """
    folded = lexicon.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.sum(F.coalesce("polarity_points", F.lit(0)).cast("double")).alias("p"),
        F.sum(F.coalesce("subjectivity_points", F.lit(0)).cast("double")).alias("s"),
        F.count("*").cast("double").alias("n"),
    )
    sent = posts.sparkSession.sparkContext.broadcast(folded.toArrow().combine_chunks())
    denied = pa.array(list(negators), pa.string())

    @F.arrow_udf("struct<polarity_points:double,subjectivity_points:double,hits:bigint>")
    def summed(said: pa.Array) -> pa.Array:
        entries = sent.value
        words, row = pc.list_flatten(said), pc.list_parent_indices(said).to_numpy()
        at = pc.index_in(words, value_set=entries["token"].combine_chunks())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at, row_of = at.filter(pa.array(known)).to_numpy(), row[known]
        factor = np.ones(len(row_of))
        if len(denied):
            after = np.zeros(len(words), bool)
            after[1:] = pc.is_in(words, value_set=denied).to_numpy(zero_copy_only=False)[:-1] & (row[1:] == row[:-1])
            factor[after[known]] = -0.5
        p, s, n = (entries[c].to_numpy()[at] for c in "psn")
        hits = np.bincount(row_of, n, len(said))
        none = pa.array(hits == 0)
        columns = [np.bincount(row_of, p * factor, len(said)), np.bincount(row_of, s, len(said)), hits.astype(np.int64)]
        masked = [pc.if_else(none, pa.nulls(len(said), column.type), column) for column in map(pa.array, columns)]
        return pa.StructArray.from_arrays(masked, ["polarity_points", "subjectivity_points", "hits"])

    counted = posts.withColumn("_sums", summed(tx.words(F.col("text"))))
    sums = {c: F.col(f"_sums.{c}") for c in ("polarity_points", "subjectivity_points", "hits")}
    return counted.withColumns(sums).withColumn("sentiment", _lexicon_struct()).select(*posts.columns, "sentiment")


def lexicon_scorer(lexicon: DataFrame, negators: Sequence[str] = (), unique: bool = False) -> Scorer:
    return lambda posts: lexicon_sentiment(posts, lexicon, negators=negators, unique=unique)


def callable_scorer(score: Callable[[pd.Series], pd.DataFrame], keep: Sequence[str]) -> Scorer:
    """A scorer from a Python function of a batch of texts to ``label`` and ``confidence`` columns.

    Batches go through Arrow; only the text crosses to Python, so no other value can change. The function gets the
    texts of a batch in parts of about ``TEXT_BYTES``, so that its memory does not follow the length of the texts.
    """

    def rated(texts: pa.Array) -> pa.Array:
        rows = score(texts.to_pandas())
        columns = [pa.array(rows[c], t, from_pandas=True) for c, t in (("label", pa.string()), ("confidence", pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["label", "confidence"])

    @F.arrow_udf("struct<label:string,confidence:double>")
    def rate(texts: pa.Array) -> pa.Array:
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(upto // TEXT_BYTES)) + 1
        bounds = [0, *cuts.tolist(), len(texts)]
        return pa.concat_arrays([rated(texts.slice(i, j - i)) for i, j in zip(bounds, bounds[1:])])

    def scorer(posts: DataFrame) -> DataFrame:
        columns = list(dict.fromkeys([*keep, "text"]))
        scored = posts.select(*columns).withColumn("_rated", rate("text"))
        sentiment = F.struct(
            F.col("_rated.label").alias("label"),
            F.lit(None).cast("double").alias("polarity"),
            F.lit(None).cast("double").alias("subjectivity"),
            F.col("_rated.confidence").alias("confidence"),
            F.lit(None).cast(SENTIMENT["probabilities"].dataType).alias("probabilities"),
        )
        return scored.select(*columns, sentiment.alias("sentiment"))

    return scorer


def with_fallback(primary: Scorer, fallback: Scorer) -> Scorer:
    """The primary score where it gives a label; only the other posts go to the fallback."""

    def scorer(posts: DataFrame) -> DataFrame:
        first = primary(posts)
        labelled = F.col("sentiment.label").isNotNull()
        return first.filter(labelled).unionByName(fallback(first.filter(~labelled).drop("sentiment")))

    return scorer


def result_rows(scored: DataFrame, as_of: str | None = None) -> DataFrame:
    """Scored posts in the result layout, with one processing stamp and zeroed counters."""
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    present = set(scored.columns)

    def of(name: str, kind: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast(kind)

    counters = [F.coalesce(of(c, "bigint"), F.lit(0)).cast("bigint").alias(c) for c in ("likes", "retweets", "score")]
    author = tx.first_filled(of("author_id", "string"), of("author", "string"))
    return scored.select(
        F.col("id").alias("post_id"),
        "platform",
        "text",
        "created_at",
        "sentiment",
        stamp.alias("processed_at"),
        F.struct(author.alias("author_id"), *counters).alias("metadata"),
    )


def score_posts(posts: DataFrame, scorer: Scorer, as_of: str | None = None) -> DataFrame:
    """All posts scored and brought into the result layout."""
    return result_rows(scorer(posts), as_of)


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function over Arrow batches, for what column expressions cannot say.

    Integers come as pandas' nullable ones, so that a null does not turn the column into floats.
    """
    target = to_arrow_schema(T.StructType.fromDDL(schema))
    kinds = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pandas(function(batch.to_pandas(types_mapper=kinds.get)), target, preserve_index=False)

    return df.mapInArrow(run, schema)


def capture_errors(df: DataFrame, function: Callable[[dict], str], key: str,
                   whole: Callable[[list[dict]], list[str]] | None = None) -> DataFrame:
    """A Python function over rows whose failures become records instead of ending the job.

    Gives ``ok``, ``payload`` and ``error`` beside the key, one row for every input row. Values reach the function
    exactly, nulls as None. ``whole``, if given, does the same for a list of rows at once; it is asked first, and rows
    are tried one by one only in a batch where it fails.
    """
    kind = df.schema[key].dataType.simpleString()

    def tried(rows: list[dict]) -> list[tuple[bool, str | None, str | None]]:
        if whole is not None:
            try:
                return [(True, payload, None) for payload in whole(rows)]
            except Exception:  # some row of the batch fails; which one shows below
                pass
        return [attempt(row) for row in rows]

    def attempt(row: dict) -> tuple[bool, str | None, str | None]:
        try:
            return True, function(row), None
        except Exception as problem:
            return False, None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcome = tried(batch.to_pylist())
            columns = [pa.array([row[i] for row in outcome], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "ok", "payload", "error"])

    return df.mapInArrow(run, f"`{key}` {kind}, ok boolean, payload string, error string")
