import os

import pytest

import corpus_pipeline
from tablewright.llm import quality, secret_scan
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SMALL).write.parquet(f"{folder}/{i}")
        found.append(spark.read.parquet(f"{folder}/{i}"))
    return found


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_rejects_what_is_predicted_bad(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(stages[0], labels).where("predicted = 1").collect()}
    assert {d for d, _ in texts(stages[1])} == good and len(good) < stages[0].count()


def test_copies_go(stages):
    before = texts(stages[1])
    kept = {k for k, _, _ in brute.exact(before).values()}
    assert texts(stages[2]) == [x for x in before if x[0] in kept]


def test_near_copies_go(stages):
    before = texts(stages[2])
    kept = {c for _, c in brute.near(before).values()}
    assert texts(stages[3]) == [x for x in before if x[0] in kept]


def test_secrets_are_masked_and_all_documents_stay(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert [d for d, _ in before] == [d for d, _ in after]
    for (_, old), (_, new) in zip(before, after):
        assert new == secret_scan.mask(old)
        assert not secret_scan.confirmed_spans(new)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing_takes_every_document(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {d for d, _ in texts(stages[4])}
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 3


def test_run_and_empty_table(spark, stages):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() == stages[5].count()
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
