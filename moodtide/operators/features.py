"""Tokens, n-grams, vocabulary, TF-IDF and fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.labels import label_code
from ..session import kept_table
from ..settings import MAX_SEQUENCE_LENGTH, VOCABULARY_SIZE
from .sizing import each, lookup_join

#: Words that may share the last place among the most frequent ones before all pairs are counted, by the vocabulary's size.
TIED_WORDS = 4


def exploded_tokens(posts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, position, token)`` of every word of the cleaned text."""
    said = posts.select(key, tx.words(F.col(text)).alias("said"))
    return said.select(key, F.posexplode_outer("said").alias("position", "token")).filter(F.col("token").isNotNull())


def remove_stopwords(said: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Token rows whose token is not in the stop-word table."""
    return lookup_join(said, stopwords, ["token"], "left_anti")


def lemmatize(said: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Token rows with the token's lemma, or the token itself where the table has none."""
    return lookup_join(said, lemmas, ["token"], "left").withColumn("lemma", F.coalesce("lemma", "token"))


def terms(unigrams: Column) -> Column:
    """Single words followed by pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(unigrams, F.lit(1), F.greatest(F.size(unigrams) - 1, F.lit(0))),
        F.slice(unigrams, F.lit(2), F.greatest(F.size(unigrams) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.concat(unigrams, pairs)


def model_words(text: Column) -> Column:
    """Preprocessed tokens of at least two letters, as the vectoriser takes them."""
    return tx.tokens(text, min_length=2)


def ngrams(posts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, term)`` for every single word and pair of words."""
    said = posts.select(key, model_words(F.col(text)).alias("said"))
    return each(said, terms(F.col("said")), key, name="term")


def frequent_terms(said: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The terms said most often over all texts."""
    counted = said.groupBy("term").agg(F.count("*").alias("corpus_tf"))
    return counted.orderBy(F.col("corpus_tf").desc(), F.col("term").asc()).limit(size)


def _pairs(cut: DataFrame) -> DataFrame:
    """Words next to each other, as columns ``a`` and ``b``."""
    most = F.greatest(F.size("said") - 1, F.lit(0))
    beside = F.arrays_zip(F.slice("said", F.lit(1), most).alias("a"), F.slice("said", F.lit(2), most).alias("b"))
    return each(cut, beside, name="pair").select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))


def _places(said: pa.Array, listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of a batch of texts: their place in the list, -1 for none, and their text."""
    at = pc.index_in(pc.list_flatten(said), value_set=listed).fill_null(-1)
    return at.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(said).to_numpy()


def _beside(at: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of listed words next to each other, as first place times ``size`` plus second, and their text."""
    both = (text[1:] == text[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
    return at[:-1][both] * size + at[1:][both], text[1:][both]


def _pair_counts(cut: DataFrame, listed: list[str]) -> DataFrame:
    """How often two words of the list stand next to each other, folded by batch before it is shuffled."""
    spark, size = cut.sparkSession, len(listed)
    sent = spark.sparkContext.broadcast(pa.array(listed, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_beside(*_places(batch["said"], sent.value), size)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return cut.select("said").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("corpus_tf"))


def _numbered(spark: SparkSession, values: list[str], number: str, name: str) -> DataFrame:
    """The values with their place in the list."""
    return spark.createDataFrame(pa.table({number: pa.array(range(len(values)), pa.int64()), name: pa.array(values, pa.string())}))


def frequent_terms_of(cut: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """What ``frequent_terms`` gives for the terms of texts cut to words (``said``).

    A pair is said no more often than either of its words. So where there are ``size`` words, only pairs of words said
    as often as the last of them can be among the terms, and only those are counted, by the places of their words in a
    list that is sent. If very many words share that number, as in a short corpus, all pairs are. ``cut`` should be a
    table: it is read twice.
    """
    spark = cut.sparkSession
    words = kept_table(each(cut, F.col("said"), name="term").groupBy("term").agg(F.count("*").alias("corpus_tf")), "words")
    first = words.orderBy(F.col("corpus_tf").desc(), F.col("term").asc()).limit(size)
    last = first.agg(F.count("*").alias("n"), F.min("corpus_tf").alias("least")).first()
    least = last.least if last.n == size else 0
    most = TIED_WORDS * size
    often = sorted(row.term for row in words.filter(F.col("corpus_tf") >= least).select("term").limit(most + 1).collect()) if least else []
    if 0 < len(often) <= most:
        found = _pair_counts(cut, often).filter(F.col("corpus_tf") >= least)
        said = found.withColumns({"_a": F.expr(f"pair div {len(often)}"), "_b": F.col("pair") % len(often)})
        for side in ("a", "b"):
            said = said.join(F.broadcast(_numbered(spark, often, f"_{side}", side)), f"_{side}")
    else:
        said = _pairs(cut).groupBy("a", "b").agg(F.count("*").alias("corpus_tf")).filter(F.col("corpus_tf") >= least)
    both = words.unionByName(said.select(F.concat_ws(" ", "a", "b").alias("term"), "corpus_tf"))
    return both.orderBy(F.col("corpus_tf").desc(), F.col("term").asc()).limit(size)


def _found(cut: DataFrame, listed: list[str], key: str) -> DataFrame:
    """One row per key: ``found``, the listed terms of its texts as their places in the list and their occurrences.

    All words of a batch are looked up at once and counted by text. Where no key repeats, that is all; otherwise the
    counts of a key's texts are added up, spread over keys and terms.
    """
    parts = [term.split(" ") for term in listed]
    words, size = sorted({word for term in parts for word in term}), max(len(listed), 1)
    place = {word: i for i, word in enumerate(words)}
    single = np.full(len(words) + 1, -1)  # the last stands for a word that is not listed
    pairs = []
    for i, term in enumerate(parts):
        if len(term) == 1:
            single[place[term[0]]] = i
        else:
            pairs.append((place[term[0]] * len(words) + place[term[1]], i))
    pairs = np.array([*sorted(pairs), (2**63 - 1, -1)])
    sent = cut.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), single, pairs[:, 0], pairs[:, 1]))

    @F.arrow_udf("array<struct<code:bigint,tf:bigint>>")
    def counted(said: pa.Array) -> pa.Array:
        words, single, pairs, term = sent.value
        at, text = _places(said, words)
        beside, text_of = _beside(at, text, len(words))
        slot = np.searchsorted(pairs, beside)
        alone, joined = single[at], np.where(pairs[slot] == beside, term[slot], -1)
        terms_, texts = np.concatenate([alone, joined]), np.concatenate([text, text_of])
        held, tf = np.unique((texts * size + terms_)[terms_ >= 0], return_counts=True)
        of, code = np.divmod(held, size)
        ends = np.searchsorted(of, np.arange(len(said) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(code), pa.array(tf)], ["code", "tf"]))

    found = cut.select(key, counted("said").alias("found"))
    if cut.groupBy(key).count().filter("count > 1").isEmpty():
        return found
    added = _entries(found, key).groupBy(key, "code").agg(F.sum("tf").alias("tf"))
    return added.groupBy(key).agg(F.collect_list(F.struct("code", "tf")).alias("found"))  # no more entries than terms


def _entries(found: DataFrame, *kept: str) -> DataFrame:
    """One row per key and term."""
    return each(found, F.col("found"), *kept, name="_entry").select(*kept, F.col("_entry.code").alias("code"), F.col("_entry.tf").alias("tf"))


def _vocabulary_of(posts: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, list[str]]:
    """The terms of every text as places in the list of the corpus' most frequent terms, and that list.

    Texts are tokenised once, into a written table that all counts read. Terms are first counted without their texts,
    which folds well inside each task. The driver holds the vocabulary, at most ``size`` terms, and sends it to the texts.
    """
    cut = kept_table(posts.select(key, model_words(F.col(text)).alias("said")), "tokens")
    listed = sorted(row.term for row in kept_table(frequent_terms_of(cut, size).select("term"), "terms").collect())
    return _found(cut, listed, key), listed


def vocabulary_counts(posts: DataFrame, key: str = "id", text: str = "text", size: int = VOCABULARY_SIZE) -> DataFrame:
    """Occurrences in each text of the corpus' most frequent terms; nothing but the terms' own counts is shuffled."""
    found, listed = _vocabulary_of(posts, key, text, size)
    named = F.broadcast(_numbered(posts.sparkSession, listed, "code", "term"))
    return _entries(found, key).join(named, "code").select(key, "term", "tf")


def vocabulary(counts: DataFrame) -> DataFrame:
    """Each vocabulary term with its occurrences and the number of texts it occurs in."""
    return counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.count("*").alias("df"))


def tfidf(posts: DataFrame, key: str = "id", text: str = "text", size: int = VOCABULARY_SIZE,
          digits: int = 6) -> DataFrame:
    """Smoothed, length-normalised TF-IDF weights of the vocabulary terms in every text.

    The terms of a text stay in one row until they are weighed, so its length is known without a shuffle. The counts
    are a written table: document frequencies and weights read it.
    """
    spark = posts.sparkSession
    found, listed = _vocabulary_of(posts, key, text, size)
    counts = kept_table(found, "counts")
    texts = posts.select(F.count("*").alias("n")).scalar()
    idf = F.log((texts + 1) / (F.col("df") + 1)) + 1
    known = _entries(counts).groupBy("code").agg(F.count("*").alias("df")).join(_numbered(spark, listed, "code", "term"), "code")
    known = kept_table(known.withColumn("idf", idf), "frequencies")
    by_code = np.zeros(len(listed))
    for row in known.select("code", "idf").collect():  # at most ``size`` rows
        by_code[row.code] = row.idf
    sent = spark.sparkContext.broadcast(by_code)

    @F.arrow_udf("double")
    def length(entries: pa.Array) -> pa.Array:
        flat, text = pc.list_flatten(entries), pc.list_parent_indices(entries).to_numpy()
        weight = flat.field("tf").to_numpy() * sent.value[flat.field("code").to_numpy()]
        return pa.array(np.sqrt(np.bincount(text, weight * weight, len(entries))))

    normed = counts.withColumn("_norm", length("found"))
    weighted = _entries(normed, key, "_norm").join(F.broadcast(known), "code")
    share = F.bround(F.col("tf") * F.col("idf") / F.col("_norm"), digits)
    return weighted.select(key, "term", "tf", "df", share.alias("tfidf"))


def training_frame(labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Preprocessed text and class code; an unknown label fails the job."""
    code = label_code(F.col(label))
    checked = F.coalesce(
        code,
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int"),
    )
    return labelled.withColumn("clean", tx.preprocess(F.col(text))).withColumn("y", checked)


def pad_sequences(sequences: DataFrame, ids: str = "input_ids", pad: int = 0,
                  max_length: int = MAX_SEQUENCE_LENGTH, batch: Sequence[str] = ()) -> DataFrame:
    """Sequences cut to ``max_length``, padded to the longest of their batch, with an attention mask.

    The longest length is one number per batch, folded before it is joined back, so a batch
    that holds most rows is never gathered. Rows without a batch are one batch. Without a batch column it is one number for all rows.
    """
    cut = sequences.withColumn(ids, F.slice(ids, 1, max_length))
    if batch:
        of = {c: f"_of_{i}" for i, c in enumerate(batch)}
        longest = cut.groupBy(*(F.col(c).alias(n) for c, n in of.items())).agg(F.max(F.size(ids)).alias("_longest"))
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in of.items()]
        cut = cut.join(longest, reduce(and_, same), "left").drop(*of.values())
    else:
        cut = cut.withColumn("_longest", cut.select(F.max(F.size(ids))).scalar())
    missing = F.col("_longest") - F.size(ids)
    kept = F.array_repeat(F.lit(1), F.size(ids))
    return (
        cut.withColumn("attention_mask", F.concat(kept, F.array_repeat(F.lit(0), missing)))
        .withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), missing)))
        .drop("_longest")
    )
