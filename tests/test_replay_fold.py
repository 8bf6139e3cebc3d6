"""Edits folded over arrays equal the plain loops, and run no Python unless a spline is asked for."""

import math
import random

import numpy as np
import pytest

from contourlake.operators import correct as E

SIMPLE = ("halve", "double", "delete", "set", "pick", "smooth_mean", "smooth_median", "interpolate_linear", "interpolate_parabola", "unknown")
EDITS = "seq int, token string, frame_indices array<int>, action string, value double"


def test_folded_edits_equal_loops(spark, frames):
    rng = random.Random(4)
    rows, edits, expected = [], [], {}
    for n in range(120):
        size = rng.randint(1, 14)
        t = np.cumsum([rng.uniform(0.01, 0.2) for _ in range(size)])
        f = np.array([rng.choice([math.nan, 0.0, *(rng.uniform(80, 300) for _ in range(6))]) for _ in range(size)])
        own = []
        for seq in range(rng.randint(0, 4)):
            indices = [rng.randint(-1, size + 2) for _ in range(rng.randint(0, 5))]
            own.append((indices, rng.choice(SIMPLE), rng.choice([None, math.nan, 0.0, -1.0, 2.0, 3.0, 5.0, 6.0, 150.0])))
            edits.append((seq, f"t{n}", *own[-1]))
        rows += [(f"t{n}", float(a), None if math.isnan(b) and rng.random() < 0.7 else float(b)) for a, b in zip(t, f)]
        expected[f"t{n}"] = E.edited(t, f, own)
    d = frames(rows)
    out = E.replay(d, spark.createDataFrame(edits, EDITS))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got: dict = {}
    for r in out.orderBy("token", "time").collect():
        got.setdefault(r.token, []).append(math.nan if r.f0 is None else r.f0)
    assert out.columns == d.columns and set(got) == set(expected)
    for n, values in expected.items():
        assert got[n] == pytest.approx(list(values), rel=1e-9, nan_ok=True), n


def test_splines_go_beside_the_others(spark, frames):
    t = np.arange(8) / 10
    f = np.array([100.0, 120, 90, 140, 130, 150, 110, 105])
    d = frames([(n, float(a), float(b)) for n in ("s", "l", "none") for a, b in zip(t, f)])
    edits = spark.createDataFrame([(1, "s", [4], "interpolate_spline", -1.0), (2, "s", [1], "halve", None), (1, "l", [4], "interpolate_linear", 2.0)], EDITS)
    got = {n: [r.f0 for r in E.replay(d, edits).filter(f"token = '{n}'").orderBy("time").collect()] for n in ("s", "l", "none")}
    assert got["none"] == list(f) and got["l"][3] == pytest.approx(110.0)
    assert got["s"] == pytest.approx(list(E.edited(t, f, [([4], "interpolate_spline", -1.0), ([1], "halve", None)])))
