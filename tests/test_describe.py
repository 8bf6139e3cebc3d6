"""Normalisation, time, contours, resampling, numerals, scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import scalars as X
from contourlake.operators import chao as C
from contourlake.operators import contours as K
from contourlake.operators import normalise as N
from contourlake.operators import resample as RS


def test_simple_and_weighted_means(frames):
    rows = [("a", i * 1.0, v, "S", "T1") for i, v in enumerate([100.0, 110.0, 120.0, 130.0])] + [("b", i * 1.0, v, "S", "T2") for i, v in enumerate([200.0, 210.0])]
    mean = lambda m: N.speaker_statistics(frames(rows), mean_method=m).first().speaker_mean
    assert mean("simple") == pytest.approx(145) and mean("weighted") == pytest.approx(160)
    z = N.normalise_f0(frames(rows), method="zscore").select("f0", "f0_norm").collect()
    f = np.array([r.f0 for r in z])
    assert [r.f0_norm for r in z] == pytest.approx(list((f - f.mean()) / f.std(ddof=1)))
    st = N.normalise_f0(frames(rows)).filter("f0 = 100").first()
    assert st.f0_norm == pytest.approx(12 * math.log2(100 / 145))


def test_time_scaling(frames):
    data = frames([("a", 0.1, 1.0), ("a", 0.2, 1.0), ("a", 0.3, 1.0), ("b", 5.0, 1.0), ("b", 7.0, 1.0), ("c", 2.0, 1.0), (None, 1.0, 1.0), (None, 3.0, 1.0)])
    got = {(r.token, r.time): r.time01 for r in N.resolve_time(data, time_normalised="no").collect()}
    assert [got[k] for k in (("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 5.0), ("b", 7.0), ("c", 2.0), (None, 3.0))] == pytest.approx([0, 0.5, 1, 0, 1, 0.5, 1])
    whole = {(r.token, r.time): r.token_t01 for r in N.normalise_time_token(data).collect()}
    assert whole["c", 2.0] is None and whole[None, 3.0] is None
    with pytest.raises(Exception):
        N.resolve_time(data, time_normalised="yes").collect()


def test_normalised_time_is_recognised(frames):
    rows = [(t, i / 4 * (0.95 if t == "d" else 1), 1.0) for t in "abcd" for i in range(5)]
    assert N.time_is_normalised(frames(rows)).first()[0]
    assert not N.time_is_normalised(frames([(t, x * 300, f) for t, x, f in rows])).first()[0]


def test_segment_time(spark):
    d = spark.createDataFrame([(0.05, 0.0, 0.2, 1), (0.10, 0.0, 0.2, 1), (0.40, 0.2, 0.6, 2)], "time double, p_start double, p_end double, p_i int")
    r = N.normalise_time_segment(d, segment="p").orderBy("time").collect()
    assert [x.p_t01 for x in r] == pytest.approx([0.25, 0.5, 0.5]) and [x.p_tseq for x in r] == pytest.approx([0.25, 0.5, 1.5])


def resampled(frames, times, values, n, **k):
    r = RS.resample_equal(frames([("t", t, v) for t, v in zip(times, values)]).drop("intensity"), n=n, **k).orderBy("point").collect()
    return [x.f0 for x in r], r


def test_resampling_rules(frames):
    t = [round(0.1 + 0.05 * i, 2) for i in range(11)]
    f, rows = resampled(frames, t, [100.0 + 10 * i for i in range(11)], 21)
    assert f == pytest.approx([100 + 5 * i for i in range(21)]) and [r.time_prop for r in rows] == pytest.approx([i / 20 for i in range(21)])
    f, _ = resampled(frames, t, [100.0, 105.0, None, None, 120.0, 125.0, 130.0, None, 140.0, 145.0, 150.0], 21)
    assert [f[i - 1] for i in (2, 3, 10, 16)] == pytest.approx([102.5, 105, 122.5, 140]) and f[3] is f[4] is f[5] is None
    assert resampled(frames, [0.0, 0.1, 0.2], [100.0, 200.0, None], 4)[0][:3] == pytest.approx([100, 500 / 3, 200])
    assert resampled(frames, [0.0, 0.1, 0.2], [100.0, 200.0, None], 4, method="nearest")[0] == [100.0, 200.0, 200.0, None]
    one = resampled(frames, [0.3], [99.0], 7)[1]
    assert len(one) == 1 and one[0].time_prop == 0.5 and one[0].point == 1


def test_resampling_even_steps_lose_one_point_only(frames):
    step = 0.00625
    t = [0.0125 + i * step for i in range(36)]
    f, _ = resampled(frames, t, [None if i == 1 else 100.0 + i for i in range(36)], 36)
    assert sum(v is None for v in f) == 1


def test_resampling_carries_constant_columns(frames):
    d = frames([("a", 0.0, 1.0), ("a", 0.1, 2.0)]).withColumn("note", F.col("time").cast("string"))
    assert set(RS.resample_equal(d, n=3).columns) == {"token", "point", "time", "time_prop", "f0", "intensity", "speaker", "tone"}


def test_polynomials(frames):
    rows = [("a", i / 4, 100 + 50 * i / 4) for i in range(5)] + [("one", 0.3, 120.0), ("few", 0.0, 1.0), ("few", 0.5, None), ("few", 1.0, None)]
    got = {r.token: r for r in K.fit_polynomial(frames(rows), degree=2, time_normalised="no").collect()}
    assert (got["a"].c0, got["a"].c1, got["a"].c2) == pytest.approx((125, 25, 0), abs=1e-9)
    assert got["one"].c0 == 120 and got["one"].c1 is None and got["few"].c0 is None
    rng = np.random.default_rng(1)
    t, y = np.linspace(0, 1, 12), rng.normal(size=12)
    c = K.fit_polynomial(frames([("x", float(a), float(b)) for a, b in zip(t, y)]), degree=3, time_normalised="no").first()
    want = np.polynomial.legendre.legfit(2 * t - 1, y, 3)
    assert [c.c0, c.c1, c.c2, c.c3] == pytest.approx(list(want))


def test_mean_contour_detects_normalised_time(frames):
    rows = [(t, x, 100.0, "S", "T") for t in "abc" for x in (0.0, 0.5, 1.0)] + [("d", x, 200.0, "S", "T") for x in (0.0, 0.25, 0.5)]
    last = lambda how: K.mean_contour(frames(rows), n_bins=3, time_normalised=how).filter("time = 1").first().f0_predicted
    assert last("auto") == pytest.approx(100) and last("no") == pytest.approx(125)


def test_numerals(spark):
    rows = [("flat", 0.0, 200.0), ("flat", 1.0, 200.0), ("rise", 0.0, 100.0), ("rise", 1.0, 200.0)] + [("dip", t, v) for t, v in ((0.0, 200.0), (0.5, 100.0), (1.0, 200.0))]
    got = {r.tone: r for r in C.contour_to_chao(spark.createDataFrame(rows, "tone string, time double, f0_predicted double")).collect()}
    assert (got["flat"].refline, got["flat"].shape) == ("55", "high level") and (got["rise"].refline, got["rise"].shape) == ("15", "rising")
    assert got["dip"].n_digits == 3 and got["dip"].shape == "dipping" and got["dip"].robust is None


def test_shapes_and_labels(spark):
    shapes = {"55": "high level", "33": "mid level", "11": "low level", "35": "rising", "51": "falling", "214": "dipping", "353": "peaking", "5": "level"}
    d = spark.createDataFrame([(k,) for k in shapes], "d string").select("d", X.classify_contour("d").alias("s"))
    assert {r.d: r.s for r in d.collect()} == shapes
    vowels, others = ["a", "aː", "ɤ", "ǎ", "ǎ", "ja", "aw", "n̩", "ŋ̍", "a˥˩", "a1"], ["j", "n", "t", "", None, "tʰ", "an", "sil"]
    d = spark.createDataFrame([(v,) for v in vowels + others], "x string").select(X.is_vowel_label("x").alias("v"))
    assert [r.v for r in d.collect()] == [True] * len(vowels) + [False] * len(others)
    keys = spark.createDataFrame([("  Ab.WAV",), ("a.b.wav",), (".wav",), ("x",)], "x string").select(X.token_key("x").alias("k"))
    assert [r.k for r in keys.collect()] == ["ab", "a.b", ".wav", "x"]
