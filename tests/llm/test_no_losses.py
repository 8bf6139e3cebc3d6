"""Rows, links and results that must not get lost: large components, letterless texts, wide numbers, repeated queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.llm import components, langid, topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def best(rows, k=20):
    """Brute force in Python's integers."""
    whole = [(i, [int(x) * 64 if abs(x) >= 2**46 else int(np.floor(64 * x)) for x in v]) for i, v in rows]
    out = set()
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("size", [1.0, 1e6, 2e15])
def test_large_components_take_part(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows[7] = (7, [size, 0.0, -size])
    rows[20] = (20, [0.5, -2.0, 0.25])
    got = {tuple(r) for r in topk.top_k(vectors(spark, [(*r, "x") for r in rows]), F.col("vec_id") % 20 == 0).collect()}
    assert got == best(rows)


def test_wide_products_are_exact_or_refused(spark):
    rows = [(0, [1e9, 1e9, 3.0]), (1, [1e9, -1e9, 2.0]), (2, [-1e9, 1e9, 1.5]), (3, [0.5, 0.25, 1e300])]
    queries = F.col("vec_id") == 0
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(vectors(spark, [(*r, "x") for r in rows]), queries).collect()
    got = {(r.vec_id, r.score) for r in topk.top_k(vectors(spark, [(*r, "x") for r in rows[:3]]), queries).collect()}
    assert got == {(1, 192 * 128), (2, 192 * 96)}


def test_repeated_queries_and_empty_tables(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (None, [5.0, 5.0]), *((i, [i / 4, -i / 8]) for i in range(1, 20))]
    got = topk.top_k(vectors(spark, [(*r, "x") for r in rows]), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((20, k) for k in range(1, 6) for _ in range(2))
    assert {r.vec_id for r in got} == {15, 16, 17, 18, 19, 1, 2, 3, 4, 5}
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "late"])
def test_components_settle(spark, shape):
    n = 3000
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "late": [(i, n - i) for i in range(n // 2)] + [(i, i + 1) for i in range(0, n, 2)]}[shape]
    root = list(range(n + 2))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_signs_without_a_letter_have_no_language(spark, docs):
    rows = [(i, f"the house and street of water {i} " * 5, "en") for i in range(30)] + [(100 + i, f"das haus und die strasse {i} " * 5, "de") for i in range(30)]
    model = langid.train_language_id(docs(rows), F.lit(True))
    odd = ["½²", "Ⅷ", "①", "12_3 -", "́", None, ""]
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predict_language(docs(list(enumerate(odd))), model).collect()}
    assert set(got.values()) == {("und", 0.0, True)}
    assert langid.subword_buckets(["aé", "½", "x1y"], 64)[1].tolist() == [4 + 3 + 2 + 1, 0, 10]


def test_rare_languages_are_learnt(docs):
    names = [chr(97 + i // 20) + chr(97 + i % 20) for i in range(230)]
    rows = [(i, f"{n}{n} {n}x{n} " * 4, n) for i, n in enumerate(names)]
    assert langid.train_language_id(docs(rows), F.lit(True), epochs=1).languages == sorted(names)
