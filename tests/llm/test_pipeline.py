"""The pipeline: what each stage keeps and changes, over the smallest tables and hard rows."""

import corpus_pipeline
from moodtide.llm import mixing, ordermin, pieces, surrogates, toxicity
from moodtide.llm.common import table

from .rows import HARD, frame
from .test_ordermin import plain_classes


def test_stages_over_the_documents(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fitted(docs, table(spark, sf, "labels"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).filter("predicted = 1").collect()}
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-stage")
        outs.append(docs)
    clean, single, private, mixed, encoded = outs
    assert {r.doc_id for r in clean.collect()} == before.keys() - bad
    classes = plain_classes([(i, before[i].text) for i in before.keys() - bad])
    assert {r.doc_id for r in single.collect()} == set(classes.values())
    for r in private.collect():
        assert r.n_chars == len(r.text) and r.lang == before[r.doc_id].lang
        assert (r.text == before[r.doc_id].text) == (not list(surrogates.entities(before[r.doc_id].text)))
    copies = {r.doc_id: r.copies for r in mixing.mixed(private).collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {i: c for i, c in copies.items() if c}
    coder = pieces.coder(pieces.default_model())
    rows = encoded.collect()
    assert len(rows) == mixed.count()
    assert all(list(coder.encode([r.text])[0]) == r.ids and r.n_tokens == len(r.ids) for r in rows)
    assert all(o.columns == table(spark, sf, "documents").columns for o in outs[:-1])
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_hard_rows_and_empty_tables(spark, tmp_path):
    for name, rows in (("hard", HARD), ("none", [])):
        folder = tmp_path / name
        docs = frame(spark, rows, ("node", "size")).selectExpr("*", "length(text) AS n_chars")
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 0), (2, 0), (6, 0), (8, 0), (7, 1)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert set(docs.columns) <= set(out.columns)
        assert (out.count() == 0) == (not rows)
    assert ordermin.THRESHOLD == 0.8
