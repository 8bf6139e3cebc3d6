"""Inspection and regions on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from contourlake.operators import inspect as I
from contourlake.operators import region as R
from contourlake.operators import summaries as S


def token(values, name="t", step=0.01):
    return [(name, round(i * step, 6), v) for i, v in enumerate(values)]


def jumps(frames, values, **k):
    return [r.flagged_jump for r in I.flag_pitch_jumps(frames(token(values)), **k).orderBy("time").collect()]


def test_one_octave_spike_is_flagged(frames):
    assert jumps(frames, [150.0, 150.0, 150 * 2**0.5, 150.0, 150.0], carryover=0) == [False, False, True, False, False]
    assert not any(jumps(frames, [150 * 2 ** (i / 12) for i in range(5)]))


@pytest.mark.parametrize("values", [[400.0, 200.0, 200.0, 202.0, 198.0, 201.0], [201.0, 198.0, 202.0, 200.0, 200.0, 400.0], [200.0, 202.0, 400.0, 198.0, 201.0, 200.0]])
def test_the_side_far_from_the_median_is_flagged(frames, values):
    assert [v for v, hit in zip(values, jumps(frames, values)) if hit] == [400.0]


def walk(st, primary, mult=1.5):
    """The carry rule frame by frame."""
    carried = [False] * len(st)
    for i in [i for i, p in enumerate(primary) if p]:
        for d in (1, -1):
            j = i + d
            while 0 <= j < len(st) and st[j] is not None and not primary[j]:
                band = (I.RISE if st[j - d] > st[j] else I.FALL) * mult
                if abs(st[j] - st[i]) > band:
                    break
                carried[j] = True
                j += d
    return carried


def test_carryover_equals_walking_outward(frames):
    rnd = random.Random(3)
    rows = {f"t{k}": [rnd.choice([None, 0.0, 150.0, 152.0, 155.0, 300.0, 305.0, 310.0]) for _ in range(12)] for k in range(60)}
    data = frames([r for k, v in rows.items() for r in token(v, k)])
    off = {(r.token, r.time): r.flagged_jump for r in I.flag_pitch_jumps(data, carryover=0).collect()}
    on = {(r.token, r.time): r.flagged_jump for r in I.flag_pitch_jumps(data).collect()}
    import math

    for k, v in rows.items():
        keys = [(k, round(i * 0.01, 6)) for i in range(len(v))]
        st = [12 * math.log2(x) if x else None for x in v]
        primary = [off[x] for x in keys]
        assert [on[x] for x in keys] == [p or c for p, c in zip(primary, walk(st, primary))]


def test_zero_is_not_a_low_extreme(frames):
    r = I.token_statistics(frames(token([0.0, 150.0, 0.0, 160.0]))).first()
    assert (r.f0_token_min, r.f0_token_max) == (150.0, 160.0)


def test_level_outliers_need_enough_tokens(frames):
    values = [145.0, 148.0, 150.0, 152.0, 155.0, 250.0]
    data = frames([(f"t{i}", j * 0.01, v) for i, v in enumerate(values) for j in range(3)])
    t = I.flag_level_outliers(I.token_statistics(data)).orderBy("level_st").collect()
    assert [r.flag_level_high for r in t] == [False] * 5 + [True]
    few = I.flag_level_outliers(I.token_statistics(data.filter("token < 't4'")))
    assert few.filter("level_modz is not null").count() == 0


def test_low_intensity(frames):
    rows = [("t", i * 0.01, f, "S", "T", d) for i, (f, d) in enumerate(zip([120.0, 122.0, 121.0, 119.0, 118.0], [45.0, 62.0, 64.0, 63.0, 46.0]))]
    assert [r[0] for r in I.flag_low_intensity(frames(rows)).orderBy("time").select("flag_low_intensity").collect()] == [True, False, False, False, True]
    rows = [("t", i * 0.01, f, "S", "T", d) for i, (f, d) in enumerate(zip([0.0, 122.0, None, 119.0, 118.0], [20.0, 62.0, 64.0, None, 40.0]))]
    assert [r[0] for r in I.flag_low_intensity(frames(rows)).orderBy("time").select("flag_low_intensity").collect()] == [False, False, False, False, True]


def test_unvoiced_token_has_null_flags(frames):
    r = I.inspect_f0(frames(token([None, 0.0, None]) + token([100.0, 101.0], "u"))).filter("token = 't'").first()
    assert r.flagged_token is None and r.flag_notes is None and r.f0 is None


def test_trim_keeps_inner_gaps_and_drops_strays(frames):
    values = [None, None, 120.0, None, None, None, 0.0, None, None, None, 150.0, 151.0, None, 152.0, 150.0, 149.0, None]
    data = frames(token(values) + token([None, 0.0], "none"))
    got = [round(r.time, 2) for r in R.trim_to_voiced(data).orderBy("time").collect()]
    assert got == [0.10, 0.11, 0.12, 0.13, 0.14, 0.15]
    assert R.trim_to_voiced(data, min_run=1).agg(F.min("time")).first()[0] == pytest.approx(0.02)


def test_gap_flags(frames):
    data = frames(token([1.0, 2.0, 3.0, 4.0, 5.0], "clean") + token([1.0, None, 0.0, 4.0, 5.0], "gap") + token([None, 2.0, 3.0, 4.0, None], "edge") + token([None] * 5, "none"))
    got = {r.token: (r.n_missing, r.has_gap) for r in R.flag_f0_gaps(data).collect()}
    assert got == {"clean": (0, False), "gap": (2, True), "edge": (2, False), "none": (5, False)}


def test_intervals_attach_by_start(spark, frames):
    iv = spark.createDataFrame([("a", "Seg", 0.0, 0.1, ""), ("a", "Seg", 0.1, 0.3, "S1"), ("a", "Seg", 0.3, 0.6, "S2"), ("a", "Seg", 0.6, 0.8, "")], "token string, tier string, t1 double, t2 double, label string")
    times = [0.2, 0.45, 0.05, 0.7, -0.1, 0.9]
    got = {r.time: (r.seg, r.seg_i) for r in R.attach_intervals(frames([("A.wav", t, 1.0) for t in times]), iv, ["Seg"]).collect()}
    assert [got[t] for t in times] == [("S1", 1), ("S2", 2), ("", None), ("", None), (None, None), (None, None)]
    assert R.tier_names(["Rime 1", "rime-1", "--"]) == ["rime_1", "rime_1_1", "tier"]


def test_empty_tables(frames):
    empty = frames([])
    assert I.inspect_f0(empty).count() == 0 and R.trim_to_voiced(empty).count() == 0 and R.flag_f0_gaps(empty).count() == 0


def test_breakdown_margins(spark):
    t = spark.createDataFrame([("A", "1", True), ("A", "1", True), ("A", None, False), ("B", "1", False)], "speaker string, tone string, dropped boolean")
    got = {(r.speaker, r.tone): (r.cell, r.grade) for r in S.discard_breakdown(t).collect()}
    assert got["A", "1"] == ("2/2 (100.0%)", "whole group gone") and got["Total", "Total"] == ("2/4 (50.0%)", "half or more") and got["A", S.NO_METADATA] == ("0/1 (0.0%)", "")
