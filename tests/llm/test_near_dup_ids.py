"""Near duplicates among rows whose doc_id is null or repeated."""

import corpus_pipeline
from tidegauge.llm import near_dups

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))
NEAR_A, NEAR_B = A + " more", B + " more"
ROWS = [(None, A), (3, A), (4, A), (5, NEAR_A), (7, B), (7, C), (8, NEAR_B), (9, C + " more"), (None, "clean text without an id"), (None, NEAR_B), (None, None), (11, "x y"), (11, "x y"), (12, "")]


def frame(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_links_of_null_and_repeated_ids(spark):
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_dups.near_duplicates(frame(spark)).collect()), key=str)
    want = [(None, 3, 59, False), (3, 3, 59, True), (4, 3, 59, False), (5, 3, 60, False), (7, 7, 59, True), (7, 7, 59, True), (8, 7, 60, False), (9, 7, 60, False), (None, None, 4, True), (None, 7, 60, False), (None, None, 0, True), (11, 11, 1, True), (11, 11, 1, True), (12, 12, 0, True)]
    assert got == sorted(want, key=str)


def test_pipeline_keeps_one_row_of_each(spark):
    rows = corpus_pipeline.near_copies(spark, frame(spark), "").collect()
    want = [(3, A), (7, B), (7, C), (None, "clean text without an id"), (None, None), (11, "x y"), (12, "")]
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
