"""Runs side by side equal lone runs; forms of mixtures, hierarchies and costs equal plain Python."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions.scalars import erfc, normal_mass
from contourlake.operators import cluster as C
from contourlake.operators import lloyd as L


def vectors(spark, points):
    return spark.createDataFrame([(str(i), [float(v) for v in p]) for i, p in enumerate(points)], "token string, features array<double>").repartition(3)


def groups(rng, centres, n=60, sd=1.0):
    return np.concatenate([rng.normal(c, sd, (n, len(c))) for c in centres])


def lone_run(x, centres, rounds=50):
    """Lloyd's algorithm in plain numpy."""
    spread = ((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
        cost = sum(((x[at == j] - x[at == j].mean(axis=0)) ** 2).sum() for j in range(len(centres)) if (at == j).any())
        moved = ((new - centres) ** 2).sum(axis=1).max()
        centres = new
        if moved <= L.SETTLED * spread:
            break
    return centres, cost


def test_every_run_equals_a_lone_run_from_the_same_centres(spark):
    x = groups(np.random.default_rng(1), [(0, 0, 5), (9, 1, 0), (0, 12, 3)])
    points = L.read_points(vectors(spark, x))
    first = {(b, k): L.first_centres(points, b, k, 4) for b in range(3) for k in (2, 3, 5)}
    centres, cost = L.lloyd(points, first)
    rows = points.rows.toPandas()
    raw = np.array(rows["features"].tolist())
    for (b, k), starts in first.items():
        own = points.table(rows["key"].to_numpy(), raw, b)
        for s, start in enumerate(starts):
            c, total = lone_run(own, start)
            assert centres[b, k][s] == pytest.approx(c, abs=1e-8) and cost[b, k][s] == pytest.approx(total, rel=1e-8)


def test_reference_points_fill_the_box_of_the_axes_and_stay_the_same(spark):
    x = np.random.default_rng(2).normal(0, 1, (500, 2)) @ np.array([[5.0, 5.0], [-0.5, 0.5]])
    points = L.read_points(vectors(spark, x))
    keys = points.rows.toPandas()["key"].to_numpy()
    a, b = points.table(keys, x, 1), points.table(keys, x, 2)
    assert (points.table(keys[:7], x[:7], 1) == a[:7]).all() and abs(np.corrcoef(a[:, 0], b[:, 0])[0, 1]) < 0.2
    turned = a @ points.axes
    assert (turned >= points.low).all() and (turned <= points.high).all()
    assert turned.mean(axis=0) == pytest.approx((points.low + points.high) / 2, abs=0.1 * (points.high - points.low).max())
    assert abs(np.corrcoef(a.T)[0, 1]) > 0.9  # the box is turned with the points


def test_choice_of_k_on_three_groups(spark):
    x = groups(np.random.default_rng(3), [(0, 0), (20, 0), (0, 20)])
    feat = vectors(spark, x).withColumn("contour", F.col("features"))
    d = C.choose_k(feat, range(2, 6), starts=10, gap_references=6)
    assert d.columns == ["k", "wss", "silhouette", "gap", "gap_se", "mdl", "bic"]
    s = C.suggestions(d).first()
    assert (s.k_silhouette, s.k_gap, s.k_gmm, s.k_auto) == (3, 3, 3, 3)
    three = C.kmeans(feat, 3)
    row = d.filter("k = 3").first()
    assert row.wss == pytest.approx(C.within_cost(three).first()[0]) and row.silhouette == pytest.approx(C.silhouette(three).first()[0])
    assert row.mdl == pytest.approx(C.description_length(three).first()["mdl"])
    assert all(r.gap_se > 0 for r in d.collect())


def test_registered_choice_of_k_finishes_and_has_every_k(spark):
    import __spark_entry__

    began = time.time()
    rows = __spark_entry__.queries()["m10_choose_k"](spark, "/root/testdata/sf0.001").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(2, 9)) and all(r.gap is not None and r.gap_se > 0 and r.mdl is not None for r in rows)
    assert all(a.wss >= b.wss for a, b in zip(rows, rows[1:])) and time.time() - began < 120
    solutions = __spark_entry__.queries()["m14_compare_solutions"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.k, r.cluster) for r in solutions} == {(k, c) for k in range(2, 9) for c in range(1, k + 1)}


def test_points_that_take_no_part_and_too_few_points(spark):
    d = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [9.0, 9.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), ("a", [0.0, 0.0])], "token string, features array<double>")
    got = {r.token: r.cluster for r in C.kmeans(d, 2).collect()}
    assert got["d"] is None and got["e"] is None and got["f"] is None and got["a"] == got["b"] != got["c"]
    with pytest.raises(ValueError, match="4 clusters of 3"):
        C.kmeans(d, 4)
    with pytest.raises(ValueError, match="no points"):
        C.kmeans(d.filter("token = 'd'"), 2)


# ---- mixtures


def plain_mixture(x, m, form, rounds):
    """Expectation-maximisation in plain numpy from a given mixture."""
    n, p = x.shape
    w, mean, var = m.weight, m.mean, m.var
    for _ in range(rounds):
        logs = np.array([np.log(w[j]) - 0.5 * (np.log(2 * np.pi * var[j]) + (x - mean[j]) ** 2 / var[j]).sum(axis=1) for j in range(len(w))]).T
        likelihood = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - likelihood[:, None])
        size = r.sum(axis=0)
        w, mean = size / n, (r.T @ x) / size[:, None]
        scatter = np.array([(r[:, j, None] * (x - mean[j]) ** 2).sum(axis=0) for j in range(len(w))])
        var = {"EII": np.full_like(scatter, scatter.sum() / (n * p)), "VII": np.repeat(scatter.sum(axis=1)[:, None] / (size[:, None] * p), p, axis=1), "EEI": np.repeat(scatter.sum(axis=0)[None] / n, len(w), axis=0), "VVI": scatter / size[:, None]}[form]
    return w, mean, var, likelihood.sum()


@pytest.mark.parametrize("form", L.FORMS)
def test_mixtures_side_by_side_equal_plain_ones(spark, form):
    x = groups(np.random.default_rng(4), [(0, 0), (4, 1), (1, 5)])
    points = L.read_points(vectors(spark, x))
    centres, _ = L.best_runs(points, [3], starts=5)
    start = L.mixtures(points, centres, iterations=0)[3, form]
    got = L.mixtures(points, centres, iterations=12, tolerance=0)[3, form]
    w, mean, var, _ = plain_mixture(x - points.mean, start, form, 12)
    assert got.weight == pytest.approx(w) and got.mean == pytest.approx(mean) and got.var == pytest.approx(var)
    likelihood = plain_mixture(x - points.mean, got, form, 1)[3]
    assert got.bic == pytest.approx(2 * likelihood - (2 + 6 + {"EII": 1, "VII": 3, "EEI": 2, "VVI": 6}[form]) * math.log(len(x)))


@pytest.mark.parametrize("form,scales", [("EII", ((1, 1), (1, 1))), ("VII", ((0.4, 0.4), (2, 2))), ("EEI", ((0.4, 3), (0.4, 3))), ("VVI", ((0.4, 3), (3, 0.4)))])
def test_planted_forms_are_chosen(spark, form, scales):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (300, 2)) for c, s in zip(((0, 0), (14, 14)), scales)])
    feat = vectors(spark, x)
    best = C.mixture_table(feat, [2], starts=3).orderBy(F.desc("bic")).first()
    assert best.form == form
    found = C.gaussian_mixture(feat, 2, starts=3)
    sides = {(int(r.token) < 300, r.cluster) for r in found.collect()}
    assert len(sides) == 2 and found.agg(F.max("uncertainty")).first()[0] < 0.2


def test_collapsed_mixtures_have_no_bic(spark):
    feat = vectors(spark, [(0.0, 0.0)] * 20 + [(5.0, float(i)) for i in range(20)])
    rows = {r.form: r.bic for r in C.mixture_table(feat, [2], starts=2).collect()}
    assert rows["VVI"] is None and rows["VII"] is None and rows["EII"] is not None


# ---- hierarchies


def plain_merges(x, k, method):
    parts = [[i] for i in range(len(x))]
    cost = lambda a, b: ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b)) if method == "ward" else np.mean([((x[i] - x[j]) ** 2).sum() for i in a for j in b])
    while len(parts) > k:
        _, i, j = min((cost(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("method", ["ward", "average"])
def test_chains_find_the_merges_of_a_full_search(method):
    x = np.random.default_rng(6).normal(0, 1, (45, 3))
    merges = L.merge_order(np.ones(45), x, np.zeros(45), method)
    for k in (2, 3, 7, 20):
        got = L.cut_merges(45, merges, k)
        assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == plain_merges(x, k, method)


def test_two_thousand_centres_merge_in_seconds():
    x = np.random.default_rng(7).normal(0, 1, (2000, 5))
    began = time.time()
    assert len(set(L.cut_merges(2000, L.merge_order(np.ones(2000), x, np.zeros(2000), "ward"), 4).tolist())) == 4
    assert time.time() - began < 20


# ---- normal mass


def test_erfc_is_python_s(spark):
    xs = [0.0, 1e-9, 0.2, 0.46875, 0.469, 0.5, 1.0, 2.5, 3.99, 4.0, 4.01, 5.5, 8.0, 20.0, 26.0]
    d = spark.createDataFrame([(s * x,) for x in xs for s in (1.0, -1.0)], "x double")
    for r in d.select("x", erfc(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-12, abs=0)
    m = d.select(normal_mass(F.lit(0.2), F.lit(1.1), F.lit(0.4), F.lit(0.7)).alias("m")).first().m
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    assert m == pytest.approx(phi(1.0) - phi(-0.2 / 0.7), rel=1e-13)


def test_description_length_runs_no_python(spark):
    d = vectors(spark, [(0.0, 1.0), (2.0, 3.0), (4.0, 4.5), (9.0, 9.0)]).withColumn("contour", F.col("features")).withColumn("cluster", (F.col("token").cast("int") / 2).cast("int"))
    out = C.description_length(d)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    x, c = np.array([(0.0, 1.0), (2.0, 3.0), (4.0, 4.5), (9.0, 9.0)]), np.array([0, 0, 1, 1])
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    nats = lambda v, m, s: -math.log(max(phi((math.floor(v) + 1 - m) / s) - phi((math.floor(v) - m) / s), np.finfo(float).tiny))
    residual = sum(nats(x[i, j], x[c == c[i], j].mean(), x[c == c[i], j].std(ddof=1)) for i in range(4) for j in range(2))
    model = sum(nats(x[c == g, j].mean(), x[:, j].mean(), x[:, j].std(ddof=1)) for g in (0, 1) for j in range(2))
    r = out.first()
    assert (r.residual, r.model, r.partition) == pytest.approx((residual, model, 4 * math.log(4) - 2 * 2 * math.log(2)))
