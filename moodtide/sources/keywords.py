"""Tracked keywords: matching by expression for a short list, by join for a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import phrase_text
from ..operators.scan import as_of
from ..operators.sizing import each, lookup_join, small_table
from ..session import fresh_path


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords found in the text as whole words or phrases, in list order.

    Unlike a filter function over the list, this form prepares the text once for all keywords.
    """
    spoken = phrase_text(text)
    hits = [F.when(F.contains(spoken, phrase_text(F.lit(word))), F.lit(word)).otherwise("") for word in keywords]
    return F.array_remove(F.array(*hits), "")


def keyword_table(spark: SparkSession, keywords: Sequence[str]) -> DataFrame:
    return small_table(spark, [(word,) for word in keywords], ["keyword"])


#: Phrases of up to this many words are matched whole, longer ones are found by a run of as many.
RUN = 3


def _runs(words: str, length: int) -> Column:
    """All runs of ``length`` words of an array column, each joined by spaces."""
    count = F.greatest(F.size(words) - length + 1, F.lit(0))
    shifted = [F.slice(words, F.lit(k + 1), count) for k in range(length)]
    joined = F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat_ws(" ", a, b)) if length > 1 else shifted[0]
    return F.zip_with(joined, shifted[2], lambda ab, c: F.concat_ws(" ", ab, c)) if length > 2 else joined


def _indexed(phrases: DataFrame) -> DataFrame:
    """run, _phrase, _back, _length: each phrase under the rarest of its runs, the one that fewest phrases share (ties: the longest).

    Runs are counted beside the MD5 of their phrase; the phrase itself is not moved with them. ``_back`` is the run's
    place in the phrase.
    """
    cut = phrases.select("_phrase", F.split("phrase", " ").alias("_words"))
    runs = each(cut, F.array_distinct(_runs("_words", RUN)), "_phrase", name="run")
    shared = runs.groupBy("run").agg(F.count("*").alias("times"))
    best = F.min(F.struct("times", (-F.length("run")).alias("back"), "run")).alias("best")
    chosen = runs.join(shared, "run").groupBy("_phrase").agg(best).select("_phrase", "best.run")
    back = F.array_position(_runs("_words", RUN), F.col("run")).cast("int").alias("_back")
    return cut.join(chosen, "_phrase").select("run", "_phrase", back, F.size("_words").alias("_length"))


def _said(may: Column) -> Column:
    """Whether ``_spoken`` says the phrase around some place of its run: the same words by their MD5."""
    lead, length = F.split_part(may["run"], F.lit(" "), F.lit(1)), may["_length"]
    starts = F.sequence(F.lit(1), F.greatest(F.size("_spoken") - length + 1, F.lit(1)))

    def here(start: Column) -> Column:
        phrase = F.array_join(F.slice("_spoken", start, length), " ")
        return (F.get("_spoken", start + may["_back"] - 2) == lead) & (F.unhex(F.md5(phrase)) == may["_phrase"])

    return (F.size("_spoken") >= length) & F.exists(starts, here)


def match_keyword_table(posts: DataFrame, keywords: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, keyword)`` for every tracked phrase in a post.

    Phrases are matched by equality on their words, so the number of keywords does not multiply the posts. Up to
    ``RUN`` words a phrase is met whole. A longer one is indexed by its rarest run: where a text holds that run, the
    words around it are compared with the phrase by their MD5. Phrases are not moved with their runs, nor with the texts
    they are looked for in. The plan is the same for phrases of any length. Texts are told
    apart by their MD5, so keys may be null or repeat.
    """
    tracked = keywords.select("keyword", F.trim(phrase_text(F.col("keyword"))).alias("phrase")).distinct().filter("phrase <> ''")
    words = F.least(F.size(F.split("phrase", " ")), F.lit(RUN + 1))
    lengths = set(tracked.agg(F.collect_set(words).alias("lengths")).first()["lengths"])
    out = posts.select(key, F.lit(None).cast("string").alias("keyword")).filter(F.lit(False))
    if not lengths:
        return out
    spoken = posts.select(key, text, F.split(F.trim(phrase_text(F.col(text))), " ").alias("_spoken"))
    short = sorted(lengths - {RUN + 1})
    if short:
        phrases = each(spoken, F.array_distinct(F.concat(*[_runs("_spoken", n) for n in short])), key, name="phrase")
        out = lookup_join(phrases, tracked.filter(words <= RUN), ["phrase"]).select(key, "keyword")
    if RUN + 1 not in lengths:
        return out
    long = tracked.filter(words > RUN).withColumn("_phrase", F.unhex(F.md5("phrase")))
    phrases = _written(long.select("_phrase", "phrase").distinct(), "phrases")
    index = _written(_indexed(phrases), "phrase-index")
    node = F.unhex(F.md5(text)).alias("_node")
    held = each(spoken, F.array_distinct(_runs("_spoken", RUN)), node, name="run")
    may = F.collect_set(F.struct("run", "_phrase", "_back", "_length")).alias("_may")
    candidates = _written(lookup_join(held, index, ["run"]).groupBy("_node").agg(may), "phrase-candidates")
    texts = lookup_join(posts.select(key, text, node), candidates, ["_node"])
    heard = texts.select(key, "_may", F.split(F.trim(phrase_text(F.col(text))), " ").alias("_spoken"))
    found = F.array_distinct(F.transform(F.filter("_may", _said), lambda m: m["_phrase"]))
    said = _written(each(heard, found, key, name="_phrase"), "phrases-said")
    return out.unionByName(lookup_join(said, long.select("_phrase", "keyword"), ["_phrase"]).select(key, "keyword"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table, read again, so that what uses it more than once does not make it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keywords_as_of(
    posts: DataFrame, versions: DataFrame, keys: Sequence[str] = ("platform",), time: str = "created_at", tie_break: Sequence[str] = ("id",)
) -> DataFrame:
    """Posts with ``keywords``, the tracked list that was valid at their time, and ``matched``, those of it that they hold.

    ``versions`` has the keys, ``valid_from`` and ``keywords``. A list counts until the next one begins; before the first
    there is none and nothing matches.
    """
    listed = as_of(posts, versions, list(keys), time, "valid_from", "keywords", tie_break)
    spoken = listed.withColumn("_spoken", phrase_text(F.col("text")))
    held = F.filter("keywords", lambda word: F.contains(F.col("_spoken"), phrase_text(word)))
    return spoken.withColumn("matched", F.coalesce(held, F.array().cast("array<string>"))).drop("_spoken")
