"""The pipeline's stages on empty tables and on rows with nulls, repeats, empty and very long texts."""

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_on_an_empty_table(spark, plain, name, stage):
    out = stage(spark, plain.limit(0), SF)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == list(P.COLUMNS)


def test_stages_on_odd_rows(spark, plain):
    long = plain.orderBy("doc_id").first().text
    odd = [(None, None, None, None, None), (None, long, None, "s", 3), (5, "", "en", None, 0), (5, "", "en", None, 0), (6, " \n ", "xx", "s", None), (7, "1234 5678 !!", "en", "s", 1), (8, (long + " ") * 200, "en", "s", 1), (8, (long + " ") * 200, "en", "s", 1)]
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, SF), name)
        assert docs.columns == list(P.COLUMNS) and docs.count() <= before
        before = docs.count()
    assert docs.filter("doc_id = 8").count() <= 1 and before > 50
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
