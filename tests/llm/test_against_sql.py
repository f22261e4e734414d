"""The queries that SQL can express, against DuckDB; the hard rows of the ledger by hand."""

import duckdb
import pytest

from moodtide.llm import queries, rules

from ..oracle import compare, connect
from .rows import HARD, frame


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.SQL[name], sf) is None


def test_ledger_of_hard_rows_is_that_of_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    frame(spark, HARD).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    run = lambda spark, _: rules.decided(rules.ledger(spark.read.parquet(path)))
    assert compare(spark, con, run, queries.SQL["op5_quality_ledger"], path) is None


def test_repeated_windows_and_lines_by_hand(spark):
    row = rules.measured(frame(spark, [(1, "a b c a b c x", "en", "s"), (2, "l\n\n l\nl\nl", "en", "s")])).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].n_repeat_words) == (7, 6)
    assert (row[1].n_lines, row[1].n_dup_lines) == (4, 2)


def test_ablations_say_what_dropping_a_rule_would_keep(spark):
    entries = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "fail_bits long")
    got = {(r.policy, r.rule): r for r in rules.ablations(entries, {"p": ("few_words", "repeated_windows")}).collect()}
    few = got["p", "few_words"]
    assert (few.n_failed, few.n_only, few.n_kept, few.n_kept_without) == (2, 1, 2, 3)


def test_empty_table(spark):
    assert rules.decided(rules.ledger(frame(spark, []))).count() == 0
