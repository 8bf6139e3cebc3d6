"""The pipeline's stages over a small table, each on what its predecessor kept."""

import re

import corpus_pipeline
from contourlake.llm import langid
from contourlake.llm.common import materialize, table
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = after
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "quality_classifier":
            assert all(quality[d] == 0 for d in set(before) - set(after) if d in quality) and all(quality.get(d, 1) == 1 for d in after)
        elif name == "near_duplicates":
            classes = brute_classes([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d in before if classes[d][0] == d}
        elif name == "pii":
            assert set(after) == set(before) and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert langid.UNKNOWN == "und"
