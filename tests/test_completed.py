"""Rules of the completed operators on small tables."""

import pytest
from pyspark.sql import functions as F

from contourlake.operators import chao, contours, correct, curate, summaries, views


def test_robust_scale_of_zero_and_negative_values(spark, frames):
    raw = frames([(f"{t}{k}", i / 4, f + 5 * k + 3 * i, "S", t) for t, f in (("a", 200.0), ("b", 100.0)) for k in range(3) for i in range(5)])
    c = spark.createDataFrame([("x", t, f) for t, f in ((0.0, 0.0), (0.5, -5.0), (1.0, 150.0))], "tone string, time double, f0_predicted double")
    got = {r.f: r.chao_rob for r in chao.scaled_contours(c, raw).collect()}
    assert got[0.0] == 0.0 and got[-5.0] is None and 0 < got[150.0] < 5


def test_one_valley_has_no_robust_range(spark, frames):
    raw = frames([("a1", 0.0, 200.0, "S", "a"), ("a2", 0.0, 220.0, "S", "a"), ("b1", 0.0, 100.0, "S", "b")])
    r = chao.robust_range(raw).first()
    assert r.sigma_min is None and r.lower is None and r.upper is not None


def test_rank_deficient_polynomials_lose_only_the_aliased_terms(frames):
    rows = [("t", x, y) for x, y in ((0.0, 100.0), (0.0, 110.0), (1.0, 200.0), (1.0, 190.0))] + [("u", i / 4, 100.0 + 8 * i) for i in range(5)] + [("far", 0.0, 3.0), ("far", 1.0, 5.0)]
    got = {r.token: r for r in contours.fit_polynomial(frames(rows), degree=3, time_normalised="yes").collect()}
    assert (got["t"].c0, got["t"].c1, got["t"].c2, got["t"].c3) == (pytest.approx(150), pytest.approx(45), None, None)
    assert (got["u"].c0, got["u"].c1, got["u"].c2, got["u"].c3) == (pytest.approx(116), pytest.approx(16), pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))
    assert got["far"].c0 is None
    three = {r.token: r for r in contours.fit_polynomial(frames([("t", x, x * 10) for x in (0.0, 0.5, 0.5, 1.0)]), degree=3, time_normalised="yes").collect()}["t"]
    assert three.c2 is not None and three.c3 is None


def test_compare_with_equal_and_missing_times(spark):
    a = spark.createDataFrame([("t", 0.1, 1.0, "x"), ("t", 0.1, 2.0, "y"), ("t", None, 3.0, "z"), (None, 0.5, 4.0, "w")], "token string, time double, f0 double, mark string")
    b = a.withColumn("f0", F.when(F.col("mark").isin("y", "z"), F.col("f0") * 2).otherwise(F.col("f0")))
    got = {r.mark: (r.f0_corrected, r.edited) for r in correct.compare(a, b, a.select("token").limit(0)).collect()}
    assert got == {"x": (1.0, False), "y": (4.0, True), "z": (6.0, True), "w": (4.0, False)}


def test_edits_with_null_values_and_repeats(spark, frames):
    f = frames([("t", i / 10, 100.0 + i) for i in range(4)])
    edits = spark.createDataFrame([(2, "t", [1, 1], "halve", None), (1, "t", [1], "set", 50.0), (3, "t", [2], "set", None), (4, "t", [3], "pick", None)], "seq int, token string, frame_indices array<int>, action string, value double")
    assert [r.f0 for r in correct.scale_frames(f, edits.filter("action <> 'pick'")).orderBy("time").collect()] == [25.0, 101.0, 102.0, 103.0]
    assert [r.f0 for r in correct.replay(f, edits).orderBy("time").collect()] == [25.0, 101.0, None, 103.0]


def test_candidates(spark):
    f = spark.createDataFrame([("t", i, 100.0) for i in range(1, 6)] + [(None, 1, 7.0)], "token string, frame int, f0 double")
    one = [(100.03, 0.5), (200.0, 0.4), (0.0, 0.1)]
    c = spark.createDataFrame([("t", i, one) for i in range(1, 6)], "token string, frame int, candidates array<struct<frequency:double,strength:double>>")
    picks = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("t", 3, 3), ("t", 4, 9)], "token string, frame int, choice int")
    assert {(r.token, r.frame): r.f0 for r in correct.pick_candidates(f, c, picks).collect()} == {("t", 1): 100.0, ("t", 2): 200.0, ("t", 3): None, ("t", 4): 100.0, ("t", 5): 100.0, (None, 1): 7.0}


def test_log_keeps_its_own_discard_row(spark):
    schema = "token string, action string, details string"
    log = spark.createDataFrame([("a", "Discard token", "own"), ("b", "Halve", "x")], schema)
    more = spark.createDataFrame([("a", "Discard token", "again"), ("c", "Discard token", "two"), ("c", "Discard token", "one"), ("d", "Discard token", "gone")], schema)
    now = spark.createDataFrame([("a",), ("c",)], "token string")
    assert sorted(tuple(r) for r in correct.reconcile_log(log, more, now).collect()) == [("a", "Discard token", "own"), ("b", "Halve", "x"), ("c", "Discard token", "one")]


def test_decisions_stay_whole(spark, frames):
    d = spark.createDataFrame([("t", "B", False, None), ("t", "A", None, "z"), ("t", None, True, "a")], "token string, label string, excluded boolean, note string")
    r = curate.apply_decisions(frames([("t", 0.0, 1.0), ("u", 0.0, 1.0)]), d).orderBy("token").collect()
    assert [(x.tone_relabelled, x.excluded, x.note) for x in r] == [("A", False, "z"), ("T", False, None)]
    state = curate.curation_state(frames([("t", 0.0, 1.0)]), d.withColumn("token", F.lit("gone"))).collect()
    assert [(x.speaker, x.action) for x in state] == [(None, "relabel")]


def test_breakdown_of_an_empty_table(spark):
    t = spark.createDataFrame([], "speaker string, tone string, dropped boolean")
    assert summaries.discard_breakdown(t, tone=None).filter("total > 0").count() == 0


def test_fixed_rounds_by_the_exact_value(spark):
    from contourlake.functions.scalars import fixed

    values = [6.25, 6.35, 0.15, 0.25, 0.35, 2.675, -0.04, -6.25, 1e9 + 0.05, 0.0, 12.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: f"{v:.1f}" for v in values}


def test_views(spark, frames):
    f = frames([("a.wav", 0.123456, 100.0, "S", "x"), ("b", 0.2, None, "R", "y")])
    loaded = views.load_projection(f.withColumn("f0", F.lit("NA")), spark.createDataFrame([("A",)], "basename string"))
    assert [tuple(r) for r in loaded.collect()] == [("a.wav", 0.123456, None, None)]
    assert views.view(f, ["time", "token"]).first().time == 0.12
    assert views.pick_tokens(f, speakers=[]).count() == 0 and views.pick_tokens(f, tones=["x"], edited=spark.createDataFrame([("A",)], "token string")).count() == 1
    with pytest.raises(ValueError):
        views.export_region(f, "interval")
    assert views.table_summary(f).filter("column = 'f0'").first().n_missing == 1
