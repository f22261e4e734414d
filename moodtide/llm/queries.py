"""The registered queries of this package and the SQL that states what they must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    audit,
    lattice,
    licenses,
    mixing,
    ordermin,
    pieces,
    pivots,
    rules,
    separators,
    spellings,
    substrings,
    surrogates,
    toxicity,
)
from .common import table
from .sql import SQL  # noqa: F401  (for the driver contract)


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.as_files(table(spark, sf_dir, "documents"))
    return licenses.scanned(files).drop("text")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decided(rules.ledger(table(spark, sf_dir, "documents")))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.classed(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest(pivots.quantised(table(spark, sf_dir, "embeddings")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.grouped(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.removed(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_lattice_score": op1_lattice_score,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_surrogates": op4_surrogates,
    "op5_quality_ledger": op5_quality_ledger,
    "quality_ablations": quality_ablations,
    "op6_order_minhash": op6_order_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_pivot_search": op10_pivot_search,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}

