from tablewright.llm import exact_dedup, near_dedup


def test_repeated_ids_and_texts_leave_one_row(spark):
    rows = [(1, "q"), (1, "q"), (1, "q "), (1, "other"), (2, "q"), (None, "zz"), (None, "zz"), (None, "yy"), (4, "yy"), (5, None), (5, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n int")
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    found = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert found == sorted([(1, "q "), (1, "other"), (None, "zz"), (4, "yy"), (5, "")], key=str)


def words(start, n=60):
    return " ".join(f"w{start + i}" for i in range(n))


#: Near copies (one word more or less), ids that stand for several texts, and rows without ids.
NEAR = [
    (1, words(0)),
    (2, words(0, 59)),
    (2, words(500)),
    (9, words(500, 61)),
    (None, words(1000)),
    (None, words(1000, 61)),
    (None, words(2000)),
    (7, words(2000, 61)),
    (5, None),
    (None, ""),
]


def near_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in NEAR], "doc_id long, text string, kept_id string, kept_key int")
    return docs.withColumn("content", docs["kept_id"])


def test_near_groups_are_keyed_by_content(spark):
    found = near_dedup.near_groups(near_rows(spark)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)
    alone = [r for r in got if r[2] is None and r[1]]
    assert sorted(r[3] for r in alone) == [False, True] and len(alone) == 2
    rest = [r for r in got if r not in alone]
    assert rest == sorted(
        [(1, 56, 1, True), (2, 55, 1, False), (2, 56, 2, True), (9, 57, 2, False)]
        + [(None, 56, 7, False), (7, 57, 7, True), (5, 0, 5, True), (None, 0, None, True)],
        key=str,
    )


def test_near_stage_keeps_one_text_of_each_component(spark):
    docs = near_rows(spark)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(1, words(0)), (2, words(500)), (7, words(2000, 61)), (5, None), (None, "")} <= set(found)
    assert len(found) == 6 and len({t for d, t in found if d is None}) == 2


def test_stages_without_ids_and_with_clashing_columns(spark):
    docs = near_rows(spark).withColumnRenamed("kept_key", "kept_sha256").withColumn("kept_rows", near_dedup.F.lit(3))
    assert exact_dedup.keep_one_of_each(docs).count() == len(NEAR) - 1  # NULL and "" are one text
    through = exact_dedup.keep_one_of_each(near_dedup.keep_one_of_each(docs.union(docs)))
    assert through.columns == docs.columns
    assert through.count() == 5
