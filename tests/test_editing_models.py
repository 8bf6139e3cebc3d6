"""Curation, corrections, clustering and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import cluster as C
from contourlake.operators import correct as E
from contourlake.operators import curate as U
from contourlake.operators import models as M


def test_decisions(spark, frames):
    data = frames([("t1", 0.0, 1.0, "S", "T1"), ("t1", 0.1, 1.0, "S", "T1"), ("t2", 0.0, 1.0, "S", "T1"), ("t3", 0.0, 1.0, "S", "T4")])
    d = spark.createDataFrame([("t1", "lit", False, None), ("t3", None, True, "noisy")], "token string, label string, excluded boolean, note string")
    got = U.apply_decisions(data, d)
    assert {(r.token, r.tone, r.tone_relabelled, r.excluded, r.note) for r in got.collect()} == {("t1", "T1", "lit", False, None), ("t2", "T1", "T1", False, None), ("t3", "T4", "T4", True, "noisy")}
    assert U.publish(got).filter("tone = 'lit' and tone_original = 'T1'").count() == 2
    assert {r.token for r in U.resume(got).collect()} == {"t1", "t3"}


def test_later_edits_see_earlier_ones(spark, frames):
    data = frames([("a", i * 0.1, 100.0 + i) for i in range(6)] + [("b", 0.0, 50.0)])
    edits = spark.createDataFrame([(1, "a", [2, 3], "double", 0.0), (2, "a", [3], "halve", 0.0), (3, "a", [5], "delete", 0.0), (4, "a", [1], "set", -1.0), (5, "a", [5], "interpolate_linear", 2.0)], "seq int, token string, frame_indices array<int>, action string, value double")
    got = [r.f0 for r in E.replay(data, edits).filter("token = 'a'").orderBy("time").collect()]
    assert got == pytest.approx([100, 202, 102, 103, 104, 105])


def test_interpolations():
    t = np.arange(7.0)
    f = t**3 - 2 * t + 40
    chosen = t == 3
    spoiled = np.where(chosen, 500.0, f)
    assert E.interpolated(t, spoiled, chosen, "interpolate_spline", 6)[3] == pytest.approx(f[3])
    assert E.interpolated(t, np.where(chosen, 1.0, t**2 + 5), chosen, "interpolate_parabola", 4)[3] == pytest.approx(14)
    assert np.isnan(E.interpolated(t[:1], f[:1], np.array([True]), "interpolate_linear", 2)[0])


def shapes(frames, per=15, noise=0.08, seed=2):
    rng = np.random.default_rng(seed)
    x = np.linspace(0, 1, 12)
    rows = []
    for tone, f in (("rise", x * 2 - 1), ("fall", 1 - x * 2), ("level", x * 0)):
        for i in range(per):
            rows += [(f"{tone}{i}", float(a), float(b), "S", tone) for a, b in zip(x, f + rng.normal(0, noise, 12))]
    return frames(rows)


@pytest.mark.parametrize("method", ["kmeans", "hierarchical", "mixture"])
def test_three_shapes_are_recovered(frames, method):
    feat = C.features(C.token_contours(shapes(frames), n_points=12))
    found = {"kmeans": lambda: C.kmeans(feat, 3), "hierarchical": lambda: C.hierarchical(feat, 3), "mixture": lambda: C.gaussian_mixture(feat, 3)}[method]()
    assert C.adjusted_rand(C.contingency(found)).first().ari > 0.9


def test_silhouette_prefers_three(frames):
    d = C.choose_k(C.features(C.token_contours(shapes(frames, per=8), n_points=12)), range(2, 5), starts=2)
    assert C.suggestions(d).first().k_silhouette == 3
    wss = [r.wss for r in d.orderBy("k").collect()]
    assert wss[0] >= wss[1] >= wss[2]


def test_legendre_features_are_least_squares(frames):
    feat = C.token_contours(shapes(frames, per=3), n_points=12)
    got = C.features(feat, "legendre", degree=3).orderBy("token").select("contour", "features").collect()
    raw = np.array([np.polynomial.legendre.legfit(np.linspace(-1, 1, 12), r.contour, 3) for r in got])
    assert np.array([r.features for r in got]) == pytest.approx(raw / raw.std(axis=0, ddof=1))


def test_labels_against_themselves(spark):
    t = spark.createDataFrame([(i % 3, str(i % 3)) for i in range(30)], "cluster int, tone string")
    assert C.adjusted_rand(C.contingency(t)).first().ari == pytest.approx(1)


def test_growth_curve_recovers_effects(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(12):
        off = rng.normal(0, 3)
        for tone, slope in (("A", 10.0), ("B", -5.0)):
            for k in range(4):
                for t in np.linspace(0, 1, 9):
                    rows.append((f"{s}{tone}{k}", float(t), float(100 + slope * t + off + rng.normal(0, 0.5)), f"S{s}", tone, f"I{k}"))
    d = spark.createDataFrame(rows, "token string, time01 double, f0 double, speaker string, tone string, item string")
    m = M.fit_growth_curve(d, degree=1, random=("speaker",), rounds=30)
    p = {(r.tone, round(r.time, 3)): r.f0_predicted for r in M.predict_growth_curve(spark, m, 2).collect()}
    assert p["A", 1.0] - p["A", 0.0] == pytest.approx(10, abs=0.5) and p["B", 1.0] - p["B", 0.0] == pytest.approx(-5, abs=0.5)
    assert m.variances["residual"] == pytest.approx(0.25, abs=0.1) and 2 < m.variances["speaker_0"] / len(rows) * len(rows) < 30
    assert len(M.contrasts(spark, m).collect()) == 2


def test_smooth_and_whitening(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        e = 0.0
        for t in np.linspace(0, 1, 20):
            e = 0.6 * e + rng.normal(0, 1)
            rows.append((f"t{k}", float(t), float(100 + 5 * np.sin(2 * np.pi * t) + e), "S", "T"))
    d = spark.createDataFrame(rows, "token string, time01 double, f0 double, speaker string, tone string")
    m = M.fit_smooth(d)
    p = M.predict_smooth(spark, m, 21).orderBy("time").collect()
    assert max(abs(r.f0_predicted - 100 - 5 * np.sin(2 * np.pi * r.time)) for r in p) < 1.5 and all(r.se > 0 for r in p)
    scored = M.score_smooth(d, m)
    lag1 = lambda rho: M.residual_acf(scored, "residual", time="time01", rho=rho, max_lag=1).filter("lag = 1").first().acf
    rho = lag1(0.0)
    assert rho > 0.2 and abs(lag1(rho)) < 0.15
    assert M.fit_smooth(d, use_ar1=True).rho == pytest.approx(rho, abs=0.05)
    assert M.residual_histogram(scored).agg(F.sum("count")).first()[0] == len(rows)
