"""Every registered query against its SQL twin, and the shape of every plan."""

import pytest

from moodtide.plans import registry

from .oracle import compare, connect

SQL = registry.all_sql()
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream", "sink", "model", "train_lr"))))
def test_no_pairing_of_all_rows(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["trends"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_groups_are_cut_before_the_shuffle(spark, sf):
    plan = QUERIES["top_posts_per_label"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_words_are_counted_before_their_lemmas_are_looked_up(spark, sf):
    read = [path.rsplit("/", 2)[1:] for path in QUERIES["lemmatize"](spark, sf).inputFiles()]
    assert read and not [path for path in read if "documents.parquet" in path]
