"""Rows that the corpus stages once left out or let through."""

from tablewright.llm import quality


def test_absent_labels_do_not_crowd_out_others(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    docs = spark.range(800).selectExpr(
        "id as doc_id", "if(id % 2 = 0, 'The lake was calm, and we rowed home slowly.', 'BUY!!! $$$ 111 @@@ ###') as text"
    )
    labels = docs.selectExpr("doc_id", "if(doc_id >= 720, cast(1 - doc_id % 2 as int), null) as quality")
    usable = {r.label_id for r in quality.usable_labels(labels, rows=40).collect()}
    assert len(usable) == 40 and min(usable) >= 720
    assert {r.doc_id for r in quality.labelled_only(docs, labels, "doc_id").collect()} <= set(range(720, 800))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == set(range(0, 800, 2))
    none = labels.selectExpr("doc_id", "cast(null as int) as quality")
    assert quality.keep_good(docs, none).count() == 800
