"""Random curves, covariances, durations: planted effects are recovered, and solutions equal dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import mixed as X
from contourlake.operators import models as M

SCHEMA = "token string, time01 double, f0 double, speaker string, tone string, item string, dur double"
TIMES = np.linspace(0, 1, 9)


def splines(x, k):
    return np.array([M.spline_values(float(v), k) for v in np.atleast_1d(x)])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def make(rng, *, speakers=12, tones=("A", "B"), items=5, per=1, curve=lambda s, t, x: 0.0, item=lambda i: 0.0, duration=lambda d: 0.0, noise=0.3):
    rows = []
    for s in range(speakers):
        for n, tone in enumerate(tones):
            for i in range(items):
                for r in range(per):
                    d = float(rng.uniform(0.1, 0.5))
                    for x in TIMES:
                        mean = 10 * np.sin(np.pi * x) if n == 0 else -6 * x
                        y = 100 + mean + curve(s, n, x) + item(i) + duration(d) + rng.normal(0, noise)
                        rows.append((f"{s}{tone}{i}{r}", float(x), float(y), f"S{s}", tone, f"I{i}", d))
    return rows


def test_splines_at_a_place_equal_the_columns(spark):
    xs = [0.0, 0.1, 0.37, 0.5, 0.999, 1.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select(F.array(*M.spline_basis(F.col("x"), 7)).alias("b"))
    assert np.array([r.b for r in d.collect()]) == pytest.approx(splines(xs, 7))


# ---- growth curves


def test_planted_covariance_of_intercepts_and_slopes(spark):
    rng = np.random.default_rng(1)
    true = np.array([[9.0, -0.6 * 3 * 5], [-0.6 * 3 * 5, 25.0]])
    u = rng.multivariate_normal([0, 0], true, 250)
    v = rng.normal(0, 2, 30)
    rows = []
    for s in range(250):
        for n, tone in enumerate("AB"):
            for i in rng.choice(30, 2, replace=False):
                for x in np.linspace(0, 1, 7):
                    rows.append((f"{s}{tone}{i}", float(x), float(100 + n * 10 * x + u[s, 0] + u[s, 1] * (x - 0.5) + v[i] + rng.normal(0, 0.5)), f"S{s}", tone, f"I{i}", 0.0))
    m = M.fit_growth_curve(frame(spark, rows), degree=1, random={"speaker": "slopes", "item": "intercept"})
    c = m.covariances["speaker"]
    assert c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]) * np.sign(m.basis[1, 1]) == pytest.approx(-0.6, abs=0.1)
    assert c[0, 0] == pytest.approx(9, rel=0.3) and m.variances["residual"] == pytest.approx(0.25, rel=0.1)
    assert m.covariances["item"].shape == (1, 1) and m.covariances["item"][0, 0] == pytest.approx(v.var(), rel=0.4)
    p = {(r.tone, r.time): r.f0_predicted for r in M.predict_growth_curve(spark, m, 2).collect()}
    assert p["B", 1.0] - p["A", 1.0] == pytest.approx(10, abs=0.3)


def dense(d, k, degree_or_splines, parts, noise):
    """Mixed-model equations with all random effects in one matrix: solution, and the REML likelihood of given variances."""
    y = d["f0"].to_numpy()
    x, z, g = parts
    w = np.hstack([x, z])
    m = w.T @ w / noise
    m[x.shape[1] :, x.shape[1] :] += np.linalg.inv(g)
    solution = np.linalg.solve(m, w.T @ y / noise)
    cov = noise * np.eye(len(y)) + z @ g @ z.T
    inverse = np.linalg.inv(cov)
    left = x.T @ inverse @ x
    residual = y - x @ np.linalg.solve(left, x.T @ inverse @ y)
    reml = -0.5 * (np.linalg.slogdet(cov)[1] + np.linalg.slogdet(left)[1] + residual @ inverse @ residual)
    return solution, reml


def test_growth_curve_equals_a_dense_solution_at_the_highest_likelihood(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(0, 2, 10), rng.normal(0, 3, 10)
    rows = make(rng, speakers=10, items=4, curve=lambda s, n, x: u[0][s] + u[1][s] * x, item=lambda i: (-1.0, 0.5, 2.0, -0.5)[i], noise=1.0)
    m = M.fit_growth_curve(frame(spark, rows), degree=1, random={"speaker": "slopes", "item": "intercept"}, rounds=200)
    d = frame(spark, rows).toPandas()
    b = np.stack([np.ones(len(d)), m.basis[1, 0] + m.basis[1, 1] * d["time01"].to_numpy()], axis=1)
    one = lambda c: (d[c].to_numpy()[:, None] == sorted(d[c].unique())).astype(float)
    fixed = (one("tone")[:, :, None] * b[:, None]).reshape(len(d), -1)
    z = np.hstack([(one("speaker")[:, :, None] * b[:, None]).reshape(len(d), -1), one("item")])

    def reml(scale_speaker=1.0, scale_item=1.0, scale_noise=1.0, turn=0.0):
        c = m.covariances["speaker"] * scale_speaker + turn * np.array([[0, 1], [1, 0]]) * np.sqrt(np.prod(np.diag(m.covariances["speaker"])))
        g = np.zeros((z.shape[1],) * 2)
        for s in range(10):
            g[2 * s : 2 * s + 2, 2 * s : 2 * s + 2] = c
        g[20:, 20:] = np.eye(4) * m.covariances["item"][0, 0] * scale_item
        return dense(d, 2, 1, (fixed, z, g), m.variances["residual"] * scale_noise)

    solution, best = reml()
    assert m.effects.ravel() == pytest.approx(solution[:4], rel=1e-5, abs=1e-5)
    for changed in ({"scale_speaker": 1.2}, {"scale_speaker": 0.8}, {"scale_item": 1.4}, {"scale_item": 0.7}, {"scale_noise": 1.1}, {"scale_noise": 0.9}, {"turn": 0.05}, {"turn": -0.05}):
        assert reml(**changed)[1] < best + 1e-6


def test_growth_curve_of_one_factor_and_of_none(spark):
    rows = make(np.random.default_rng(3), speakers=6, items=3, item=lambda i: 2.0 * i)
    d = frame(spark, [*rows, ("x", 0.5, None, "S1", "A", "I1", 0.1), ("x", 0.5, 3.0, "S1", "A", None, 0.1)])
    one = M.fit_growth_curve(d, random=("item",), rounds=8)
    none = M.fit_growth_curve(d.filter("item is not null"), random=())
    assert set(one.covariances) == {"item"} and one.covariances["item"].shape == (3, 3) and not none.covariances
    assert one.effects == pytest.approx(none.effects, abs=0.3)  # balanced, so random items leave the means alone
    with pytest.raises(ValueError, match="unknown random"):
        M.fit_growth_curve(d, random={"speaker": "curves"})


# ---- smooths


def curve_of(form, s, n, x):
    """Planted random curves, smooth and different by speaker (and tone)."""
    shared = 2.5 * np.sin(2 * np.pi * x + s) + ((s * 7) % 5 - 2)
    own = 2.0 * np.cos(2 * np.pi * x + 2 * s + 3 * n)
    return {"speaker": shared, "speaker_tone": own, "speaker_by_tone": own, "ref_diff": shared + (own if n else 0)}[form]


@pytest.mark.parametrize("form,kind", [("speaker", "separate"), ("speaker_tone", "separate"), ("speaker_by_tone", "separate"), ("ref_diff", "difference"), ("ref_diff", "separate")])
def test_planted_random_curves_come_back(spark, form, kind):
    items = (-1.5, 0.0, 1.0, 2.0, -1.5)
    rows = make(np.random.default_rng(4), curve=lambda s, n, x: curve_of(form, s, n, x), item=lambda i: items[i])
    d = frame(spark, rows)
    m = M.fit_smooth(d, item="item", k=8, random_smooth=form, smooth_type=kind, rounds=15)
    found = {(r.speaker, r.tone): np.array(r.curve) for r in m.random.collect()}
    assert len(found) == 24
    b = splines(TIMES, 8)
    centred = lambda v: v - np.mean(v, axis=0)
    for n, tone in enumerate("AB"):
        true = np.array([[curve_of(form, s, n, x) for x in TIMES] for s in range(12)])
        got = np.array([b @ found[f"S{s}", tone] for s in range(12)])
        assert centred(got) == pytest.approx(centred(true), abs=0.8)
    assert np.array([m.items[f"I{i}"] for i in range(5)]) == pytest.approx(np.array(items), abs=0.2)
    p = M.predict_smooth(spark, m, 9).orderBy("tone", "time").collect()
    shape = np.array([10 * np.sin(np.pi * x) for x in TIMES] + [-6 * x for x in TIMES]) + 100
    shape += np.concatenate([np.mean([[curve_of(form, s, n, x) for x in TIMES] for s in range(12)], axis=0) for n in range(2)])
    assert np.array([r.f0_predicted for r in p]) == pytest.approx(shape, abs=1.0) and all(0 < r.se < 3 for r in p)
    scored = M.score_smooth(d, m, item="item")
    assert scored.columns == [*d.columns, "fitted", "residual"] and scored.agg(F.stddev("residual")).first()[0] < 0.45


@pytest.mark.parametrize("form,kind", [("speaker", "separate"), ("speaker_by_tone", "separate"), ("ref_diff", "difference"), ("none", "difference")])
def test_smooths_equal_a_dense_solution_at_the_highest_likelihood(spark, form, kind):
    rng = np.random.default_rng(5)
    k = 6
    rows = make(rng, speakers=6, items=3, curve=lambda s, n, x: (1 - 0.5 * s) + np.sin(2 * np.pi * x + s + n), item=lambda i: i - 1.0, duration=lambda t: 8 * (t - 0.3) ** 2, noise=0.5)
    d = frame(spark, rows)
    m = M.fit_smooth(d, item="item", duration="dur", k=k, random_smooth=form, smooth_type=kind, rounds=150)
    t = d.toPandas()
    b, y = splines(t["time01"], k), t["f0"].to_numpy()
    u = (t["dur"].to_numpy() - m.duration_range[0]) / (m.duration_range[1] - m.duration_range[0])
    e = splines(u, k)
    centre = np.linalg.svd(e.mean(axis=0)[None])[2][1:].T
    one = lambda c: (t[c].to_numpy()[:, None] == sorted(t[c].unique())).astype(float)
    per = lambda a: (a[:, :, None] * b[:, None]).reshape(len(t), -1)
    tone, speaker = one("tone"), one("speaker")
    if kind == "separate":
        blocks, names = [b * tone[:, :1], b * tone[:, 1:]], ["A", "B"]
    else:
        blocks, names = [b, b * tone[:, 1:]], ["A", "B - A"]
    d2, d1 = M._difference(k, 2), M._difference(k, 1)
    level = np.full((k, k), 1 / k)
    precisions = [d2 * m.penalties[n] / m.noise for n in names] + [centre.T @ d2 @ centre * m.penalties["duration"] / m.noise]
    random, own = [], []
    curves = lambda name: d1 / m.variances[f"{name}_0"] + level / m.variances[f"{name}_1"]
    if form == "none":
        random.append(speaker)
        own.append(np.eye(6) / m.variances["speaker"])
    if form in ("speaker", "ref_diff"):
        random.append(per(speaker))
        own.append(np.kron(np.eye(6), curves("speaker")))
    if form in ("speaker_by_tone", "ref_diff"):
        for n, x in enumerate("AB"):
            if form == "speaker_by_tone" or n:
                random.append(per(speaker * tone[:, n : n + 1]))
                own.append(np.kron(np.eye(6), curves(f"speaker_{x}")))
    w = np.hstack([*blocks, e @ centre, *random, one("item")])
    q = np.zeros((w.shape[1],) * 2)
    at = 0
    for p in [*precisions, *own, np.eye(3) / m.variances["item"]]:
        q[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    inverse = np.linalg.inv(w.T @ w / m.noise + q)
    c = inverse @ w.T @ y / m.noise
    effects = np.array([c[:k], c[k : 2 * k] + (c[:k] if kind == "difference" else 0)])
    assert splines(TIMES, k) @ m.effects.T == pytest.approx(splines(TIMES, k) @ effects.T, rel=1e-4, abs=2e-3)
    got = {(r.speaker, r.tone): np.array(r.curve) for r in m.random.collect()}
    z = w[:, 3 * k - 1 : -3] @ c[3 * k - 1 : -3]
    mine = np.array([b[i] @ got[s, n] for i, (s, n) in enumerate(zip(t["speaker"], t["tone"]))])
    assert mine == pytest.approx(z, abs=5e-3)
    # at the fixed point every variance equals its squares and posterior traces over the rank
    noise = (np.sum((y - w @ c) ** 2) + np.trace(w.T @ w @ inverse)) / len(y)
    assert noise == pytest.approx(m.noise, rel=2e-2)
    for n, start in zip(names, (0, k)):
        s = slice(start, start + k)
        variance = (c[s] @ d2 @ c[s] + np.sum(d2 * inverse[s, s])) / (k - 2)
        assert variance == pytest.approx(m.noise / m.penalties[n], rel=5e-2, abs=1e-4)


def test_duration_effect_and_prediction_at_its_mean(spark):
    rng = np.random.default_rng(6)
    effect = lambda t: 30 * (t - 0.3) ** 2 + 8 * t
    rows = make(rng, speakers=8, items=6, duration=effect)
    d = frame(spark, rows)
    m = M.fit_smooth(d, duration="dur", item="item", rounds=12)
    u = np.linspace(0.12, 0.48, 15)
    got = splines((u - m.duration_range[0]) / (m.duration_range[1] - m.duration_range[0]), 10) @ m.duration
    assert got - got.mean() == pytest.approx(effect(u) - effect(u).mean(), abs=0.15)
    durations = np.array([r[6] for r in rows])
    assert m.mean_duration == pytest.approx(durations.mean())
    out = {r.tone: r.f0_predicted for r in M.predict_smooth(spark, m, 1).collect()}
    at_mean = {r.tone: r for r in M.predict_smooth(spark, m, 1, at_mean_duration=True).collect()}
    moved = effect(durations.mean()) - effect(durations).mean()
    for t in "AB":
        assert at_mean[t].f0_predicted - out[t] == pytest.approx(moved, abs=0.1) and at_mean[t].se > 0
    scored = M.score_smooth(d, m, item="item", duration="dur")
    assert scored.agg(F.stddev("residual")).first()[0] < 0.35
    with pytest.raises(ValueError, match="durations must differ"):
        M.fit_smooth(d.withColumn("dur", F.lit(0.2)), duration="dur")
    with pytest.raises(ValueError, match="no duration"):
        M.predict_smooth(spark, M.fit_smooth(d, random_intercepts=False, rounds=1), at_mean_duration=True)


def test_smooths_of_different_roughness_keep_different_penalties(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        for x in np.linspace(0, 1, 25):
            for tone, y in (("A", 4 * x), ("B", 4 * np.sin(5 * np.pi * x))):
                rows.append((f"{tone}{i}", float(x), float(100 + y + rng.normal(0, 1)), "S", tone, "I", 0.1))
    m = M.fit_smooth(frame(spark, rows), k=14, random_intercepts=False)
    assert m.penalties["A"] > 50 * m.penalties["B"]
    p = {(r.tone, r.time): r.f0_predicted for r in M.predict_smooth(spark, m, 21).collect()}
    assert all(abs(v - 100 - (4 * x if t == "A" else 4 * np.sin(5 * np.pi * x))) < 0.5 for (t, x), v in p.items())


def test_lone_item_intercepts(spark):
    rows = make(np.random.default_rng(8), speakers=4, items=5, item=lambda i: float(i))
    m = M.fit_smooth(frame(spark, rows), item="item", random_intercepts=False, rounds=12)
    found = {r.item: r.curve[0] for r in m.random.filter("tone = 'A'").collect()}
    assert np.array([found[f"I{i}"] for i in range(5)]) == pytest.approx(np.arange(5) - 2.0, abs=0.2)
    assert M.score_smooth(frame(spark, rows), m, item="item").agg(F.stddev("residual")).first()[0] < 0.35


def test_a_hundred_thousand_speakers_without_a_dense_matrix(spark):
    """The core stays as large as the tones' curves; every speaker is a block of its own."""
    n = 100_000
    u = F.sin(F.col("s") * 12.9898) * 3
    d = spark.range(n * 6).select((F.col("id") % n).alias("s"), ((F.col("id") / n).cast("int") / 5.0).alias("time01"))
    d = d.select(F.col("s").cast("string").alias("speaker"), F.lit("T").alias("tone"), F.col("s").cast("string").alias("token"), "time01", (100 + 5 * F.col("time01") + u + 0.3 * F.sin(F.col("s") * 78.233 + F.col("time01") * 37)).alias("f0"))
    m = M.fit_smooth(d, k=5, random_smooth="speaker", rounds=2)
    assert m.effects.shape == (1, 5) and m.random.count() == n
    close = m.random.select((F.get("curve", F.lit(2)) - F.sin(F.col("speaker").cast("int") * 12.9898) * 3).alias("e")).agg(F.stddev("e")).first()[0]
    assert close < 0.5


def test_too_many_unknowns_in_the_core_are_refused(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_CORE", 24)
    rows = make(np.random.default_rng(9), speakers=9, items=8)
    with pytest.raises(ValueError, match="at most 24"):
        M.fit_smooth(frame(spark, rows), item="item", k=10)
