"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations work on the bits."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, plain_text, words_of

#: Counted as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits; each says when a document fails. Append only: bits are stored.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbol_heavy": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "digit_heavy": lambda: 10 * F.col("n_digits") > 3 * F.col("word_chars"),
}
BASE = ("few_words", "repeated_windows")

#: Versioned policies: the rules that reject. A stored ledger serves every version.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": tuple(RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(rule) for rule in rules)


def measured(docs: DataFrame) -> DataFrame:
    """The measurements of every whole text, within its row: nothing is shuffled.

    A null text has no words and no lines. Windows are compared by a 64-bit hash of their three words.
    A word is repeated if one of its three-word windows is found twice or more; only texts with such
    windows are sorted (n log n in their length).
    """
    text = docs.select(F.col("doc_id"), plain_text().alias("_text"))
    chars = F.length("_text")
    without = lambda marks: F.length(F.translate("_text", marks, ""))
    counted = text.select(
        "doc_id",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0).alias("_lines"),
        without(BLANKS).cast("long").alias("word_chars"),
        (chars - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (chars - without("0123456789")).cast("long").alias("n_digits"),
    )
    keys = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    keyed = counted.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "word_chars",
        "n_symbols",
        "n_digits",
        keys.alias("_keys"),
    )
    placed = keyed.withColumn(
        "_placed",
        F.when(
            F.size(F.array_distinct("_keys")) < F.size("_keys"),
            F.sort_array(F.transform("_keys", lambda key, i: F.struct(key.alias("key"), i.alias("at")))),
        ),
    )
    same = lambda x, i: F.coalesce(x["key"] == F.get("_placed", i)["key"], F.lit(False))  # noqa: E731  (false beyond the ends)
    twice = F.filter("_placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return placed.withColumn(
        "n_repeat_words", F.when(F.col("_placed").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")
    ).drop("_keys", "_placed")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document row: its measurements and ``fail_bits``, with the bit of each failed rule set.

    Columns of the input other than ``doc_id`` and ``text`` are not read. Repeated rows give repeated rows,
    an empty table an empty ledger; an empty text fails ``few_words``.
    """
    bits = F.lit(0).cast("long")
    for rule, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("fail_bits", bits)


def decided(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``; no text is read."""
    failed = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return entries.withColumn("base_failed", failed(BASE)).withColumn(
        "kept", ~failed(BASE) & ~failed(POLICIES[policy])
    )


def ablations(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: documents the rule fails, those it alone rejects, and how many the policy keeps with and without it.

    The ledger is folded to one row per bit pattern first (2^rules at most).
    """
    patterns = entries.groupBy("fail_bits").count()
    cases = F.array(
        *(
            F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"),
                     F.lit(bit(rule)).cast("long").alias("bit"))
            for version, rules in policies.items()
            for rule in rules
        )
    )
    each = patterns.select("fail_bits", "count", F.explode(cases).alias("c")).select("fail_bits", "count", "c.*")
    both = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(both == F.col("bit")).alias("n_only"),
        total(both == 0).alias("n_kept"),
        total(both.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
