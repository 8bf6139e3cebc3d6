"""The silhouette on plain distances against brute force, its bounds and odd rows."""

from __future__ import annotations

import math
import random

import pytest

from contourlake.operators import cluster as C


def _brute(rows, points):
    out = []
    for c, x in points:
        others = {}
        for d, y in rows:
            others.setdefault(d, []).append(math.dist(x, y))
        own, n = sum(others[c]), len(others[c])
        other = min(sum(v) / len(v) for d, v in others.items() if d != c)
        a = own / max(n - 1, 1)
        out.append(0.0 if n == 1 or max(a, other) == 0 else (other - a) / max(a, other))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    found = [(c, [rng.gauss(4 * (c == "b"), 1), rng.gauss(3 * (c == "c"), 1), 1.0]) for c in "abc" for _ in range({"a": 300, "b": 40, "c": 7}[c])]
    return [*found, ("alone", [9.0, 9.0, 9.0]), *found[:20]]


def test_all_rows_equal_brute_force(spark, rows):
    d = spark.createDataFrame([*rows, ("a", None), (None, [1.0, 2.0, 3.0]), ("a", [1.0, None, 2.0]), ("b", [float("nan"), 1.0, 1.0])], "cluster string, features array<double>").repartition(5)
    want = _brute(rows, rows)
    one = C.silhouette_euclidean(d).first()
    mean = sum(want) / len(want)
    error = math.sqrt(sum((s - mean) ** 2 for s in want) / (len(want) - 1) / len(want))
    assert one.n_points == len(rows) and one.silhouette == pytest.approx(mean, abs=1e-9) and one.std_error == pytest.approx(error, abs=1e-9)


def test_given_points_are_compared_with_all_rows(spark, rows):
    d = spark.createDataFrame(rows, "cluster string, features array<double>")
    points = spark.createDataFrame(rows[::30], d.schema)
    want = _brute(rows, rows[::30])
    one = C.silhouette_euclidean(d, points).first()
    assert one.n_points == len(want) and one.silhouette == pytest.approx(sum(want) / len(want), abs=1e-9)


def test_a_sample_lies_near_the_whole_and_repeats(spark, rows):
    d = spark.createDataFrame(rows, "cluster string, features array<double>")
    whole, part = C.silhouette_euclidean(d).first(), C.silhouette_euclidean(d.repartition(3), sample=120).first()
    assert part.n_points == 120 and abs(part.silhouette - whole.silhouette) < 4 * part.std_error
    assert part.silhouette == pytest.approx(C.silhouette_euclidean(d, sample=120).first().silhouette, abs=1e-12)


def test_one_cluster_and_no_rows_have_no_silhouette(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0]), (1, [2.0, 1.0])], "cluster int, features array<double>")
    assert tuple(C.silhouette_euclidean(one).first()) == (None, 2, None)
    assert tuple(C.silhouette_euclidean(one.limit(0)).first()) == (None, 0, None)


def test_too_many_points_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_POINTS", 1)
    d = spark.createDataFrame([(1, [0.0]), (2, [2.0])], "cluster int, features array<double>")
    with pytest.raises(ValueError):
        C.silhouette_euclidean(d, d)
