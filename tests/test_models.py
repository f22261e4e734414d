import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moodtide.operators import evaluation as ev, features, scoring, training


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad, flat = "great lovely happy", "awful terrible sad", "table window chair"
    rows = [(i, f"{(bad, flat, good)[i % 3]} word{i % 7}", i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id int, text string, y int")


@pytest.fixture(scope="module")
def model(labelled):
    return training.train_model(training.train_test_split(labelled, "doc_id").filter("split = 'train'"))


def test_the_model_learns_and_its_probabilities_are_sound(model, labelled):
    test = training.train_test_split(labelled, "doc_id").filter("split = 'test'")
    assert training.holdout_metrics(model, test).first().accuracy == 1.0
    row = training.predict(model, labelled).first()
    p = row.sentiment.probabilities
    assert abs(p.negative + p.neutral + p.positive - 1) < 1e-9 and row.sentiment.confidence == max(p)


def test_features_may_come_from_all_rows(labelled):
    train = labelled.filter("doc_id < 30")
    fitted = training.train_model(train, features_from=labelled.withColumn("text", F.concat("text", F.lit(" onlyhere"))))
    assert "onlyhere" in fitted.stages[0].vocabulary


def test_saved_model_predicts_the_same(spark, model, labelled, tmp_path):
    path = str(tmp_path / "model")
    training.save_model(model, path)
    again = training.predict(training.load_model(path), labelled).orderBy("doc_id").collect()
    assert again == training.predict(model, labelled).orderBy("doc_id").collect()
    assert training.stored_bytes(spark, path) > 0


def test_unknown_label_is_refused(spark):
    rows = spark.createDataFrame([("t", "joyful")], "text string, label string")
    with pytest.raises(PySparkException, match="unknown label"):
        features.training_frame(rows).collect()


def test_tfidf_of_a_small_corpus_by_hand(spark):
    posts = spark.createDataFrame([("1", "apple banana apple"), ("2", "banana cherry")], "id string, text string")
    got = {(r.id, r.term): r.tfidf for r in features.tfidf(posts).collect()}
    import math

    both, own = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    weights = {"apple": 2 * own, "banana": both, "apple banana": own, "banana apple": own}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    assert {t: v for (i, t), v in got.items() if i == "1"} == {t: round(w / norm, 6) for t, w in weights.items()}


def test_sequences_are_cut_padded_and_masked(spark):
    rows = spark.createDataFrame([(1, list(range(1, 201))), (2, []), (3, [5] * 5), (4, [6] * 128)], "n int, input_ids array<int>")
    got = {r.n: r for r in features.pad_sequences(rows).collect()}
    assert {len(r.input_ids) for r in got.values()} == {128} and got[1].input_ids[-1] == 128
    assert sum(got[3].attention_mask) == 5 and sum(got[2].attention_mask) == 0 and got[3].input_ids[5:] == [0] * 123


def posts(spark, values):
    return spark.createDataFrame([(str(i), "x", v) for i, v in enumerate(values)], "id string, platform string, text string")


def test_lexicon_scores_by_hand(spark):
    lexicon = spark.createDataFrame([("good", 60, 40), ("bad", -70, 60)], "token string, polarity_points int, subjectivity_points int")
    frame = posts(spark, ["good good bad", "nothing known", "not good", None])
    plain = {r.id: r.sentiment for r in scoring.lexicon_sentiment(frame, lexicon).collect()}
    assert abs(plain["0"].polarity - 50 / 3 / 100) < 1e-12 and plain["0"].label == "positive"
    assert [plain[i].polarity for i in "123"] == [0.0, 0.6, 0.0] and plain["1"].label == "neutral"
    turned = {r.id: r.sentiment for r in scoring.lexicon_sentiment(frame, lexicon, negators=scoring.NEGATORS).collect()}
    assert turned["2"].polarity == -0.3 and turned["0"].polarity == plain["0"].polarity


def test_copies_of_a_post_keep_their_score(spark):
    lexicon = scoring.starter_lexicon(spark)
    frame = posts(spark, ["great but slow"])
    many = frame.union(frame).union(frame)
    scores = {r.sentiment.polarity for r in scoring.lexicon_sentiment(many, lexicon).collect()}
    assert scoring.lexicon_sentiment(many, lexicon).count() == 3
    assert scores == {scoring.lexicon_sentiment(frame, lexicon, unique=True).first().sentiment.polarity}


def test_fallback_scores_what_the_first_scorer_cannot(spark):
    def only_short(texts):
        short = texts.str.len() < 12
        return pd.DataFrame({"label": short.map({True: "neutral", False: None}), "confidence": 0.5}, index=texts.index)

    primary = scoring.callable_scorer(only_short, ["id", "platform"])
    scorer = scoring.with_fallback(primary, scoring.lexicon_scorer(scoring.starter_lexicon(spark)))
    got = {r.id: r.sentiment.label for r in scorer(posts(spark, ["great", "great great great"])).collect()}
    assert got == {"0": "neutral", "1": "positive"}


def test_errors_become_records(spark):
    frame = spark.createDataFrame([(1, "2"), (2, "x")], "k int, v string")
    got = {r.k: (r.ok, r.payload, r.error is None) for r in scoring.capture_errors(frame, lambda row: str(int(row["v"])), "k").collect()}
    assert got == {1: (True, "2", True), 2: (False, None, False)}


def test_class_never_predicted_scores_zero(spark):
    predicted = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "y int, yhat int")
    report = {r.label: r for r in ev.classification_report(predicted).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0.0, 0.0, 0.0, 1)
    assert ev.confusion_matrix(predicted).agg(F.sum("count")).first()[0] == 3
    assert ev.classification_metrics(predicted).first().accuracy == 0.666667


def test_metrics_agree_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rows = [(i % 3, (i * i) % 3) for i in range(50)]
    predicted = spark.createDataFrame(rows, "y int, yhat int")
    ours = ev.classification_metrics(predicted).first()
    doubles = predicted.select(F.col("y").cast("double").alias("label"), F.col("yhat").cast("double").alias("prediction"))
    for ours_name, name in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert abs(ours[ours_name] - MulticlassClassificationEvaluator(metricName=name).evaluate(doubles)) < 1e-6


def test_best_step_is_the_earliest_of_the_best(spark):
    log = spark.createDataFrame(
        [(1, 0.9, None, None), (2, None, 0.5, 0.7), (3, 0.4, None, None), (4, None, 0.3, 0.8), (5, None, 0.2, 0.8)],
        "step bigint, loss double, eval_loss double, eval_accuracy double",
    )
    assert tuple(ev.train_history(log).first()) == (2, 3, 0.4, 4, 0.8)


def test_a_callable_gets_long_texts_in_parts(spark):
    def by_part(texts):
        import pandas as pd

        held = float(texts.str.len().sum())
        return pd.DataFrame({"label": texts.str[:4], "confidence": held}, index=texts.index)

    rows = [(n, None if n == 7 else f"{n:04d}" + "x" * 100_000) for n in range(60)]
    posts = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    scored = scoring.callable_scorer(by_part, ["id"])(posts).select("id", "sentiment.*").collect()
    assert {r.id: r.label for r in scored} == {n: None if n == 7 else f"{n:04d}" for n in range(60)}
    assert max(r.confidence for r in scored) < 2 * scoring.TEXT_BYTES


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 40])
def test_frequent_terms_are_those_of_a_full_count(spark, size, monkeypatch):
    """With ties at the last place, with fewer words than places, with and without leaving pairs out."""
    texts = ["aa bb aa bb cc", "aa bb dd aa bb", "cc dd zz", "yy", "", "aa bb"]
    cut = spark.createDataFrame([(text.split(),) for text in texts], "said array<string>")
    counted = features.each(cut, features.terms(F.col("said")), name="term")
    want = [tuple(row) for row in features.frequent_terms(counted, size).collect()]
    for tied in (0, 1, 100):
        monkeypatch.setattr(features, "TIED_WORDS", tied)
        assert [tuple(row) for row in features.frequent_terms_of(cut, size).collect()] == want


def test_pairs_with_a_rare_word_are_never_put_together(spark, monkeypatch):
    rows = [(str(i), f"common words {chr(97 + i) * 3} common words") for i in range(20)]
    posts = spark.createDataFrame(rows, "id string, text string")
    seen, kept_table = {}, features.kept_table
    monkeypatch.setattr(features, "kept_table", lambda df, name: seen.setdefault(name, df) and kept_table(df, name))
    got = {(r.id, r.term, r.tf) for r in features.vocabulary_counts(posts, size=3).collect()}
    assert got == {(i, term, 2) for i, _ in rows for term in ("common", "common words", "words")}
    assert set(seen) == {"tokens", "words", "terms"}


def test_a_text_is_cut_to_words_once_before_it_is_classified(model, labelled):
    plan = training.predict(model, labelled)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_two_models_are_compared_row_by_row(model, labelled):
    twice = labelled.union(labelled)
    turned = training.train_model(labelled.withColumn("y", 2 - F.col("y")))
    assert tuple(training.changed_predictions(model, model, twice).first()) == (240, 0)
    assert training.changed_predictions(model, turned, twice).first().differing > 150
    plan = training.changed_predictions(model, model, labelled)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("split(") == 1


def test_terms_of_a_text_are_weighed_without_a_shuffle_of_texts(spark):
    posts = spark.createDataFrame([(str(i), f"common words {chr(97 + i) * 3} common words") for i in range(20)], "id string, text string")
    assert "Exchange hashpartitioning(id" not in features.tfidf(posts, size=3)._jdf.queryExecution().executedPlan().toString()


def test_texts_that_share_an_id_are_weighed_as_one(spark):
    """An id that repeats, one that is null and repeats, a text without terms, and an empty corpus."""
    rows = [("1", "apple banana"), ("1", "apple"), (None, "banana"), (None, "banana cherry"), ("2", "a"), ("3", None)]
    posts = spark.createDataFrame(rows, "id string, text string")
    counts = {(r.id, r.term, r.tf) for r in features.vocabulary_counts(posts).collect()}
    assert counts == {("1", "apple", 2), ("1", "banana", 1), ("1", "apple banana", 1),
                      (None, "banana", 2), (None, "cherry", 1), (None, "banana cherry", 1)}
    got = features.tfidf(posts).collect()
    assert {(r.id, r.term, r.tf) for r in got} == counts and {r.df for r in got if r.term == "banana"} == {2}
    for own in ("1", None):
        assert abs(sum(r.tfidf ** 2 for r in got if r.id == own) - 1) < 1e-5
    assert features.tfidf(posts.filter("false")).count() == 0
