"""Near-copies among rows whose ids are null or repeated."""

import corpus_pipeline
from contourlake.llm import jaccard

LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG + " more"
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))
ROWS = [(None, LONG), (None, NEAR), (None, OTHER), (7, THIRD), (7, THIRD), (7, LONG), (3, NEAR), (None, THIRD), (None, None), (None, "")]


def test_links_of_rows_without_ids(docs):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs(ROWS)).collect()), key=str)
    want = [(None, 3, 3)] * 2 + [(7, 3, 3), (3, 3, 3), (None, None, 0)] + [(7, 7, 2)] * 2 + [(None, 7, 2)] + [(None, None, 0)] * 2
    assert got == sorted(want, key=str)
    none = jaccard.near_duplicates(docs([(None, LONG), (None, NEAR), (None, OTHER)])).collect()
    assert sorted(r.n_links for r in none) == [0, 1, 1] and {r.class_id for r in none} == {None}


def test_stage_keeps_one_row_a_class(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs(ROWS), "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, OTHER), (7, THIRD), (3, NEAR), (None, None), (None, "")], key=str)
