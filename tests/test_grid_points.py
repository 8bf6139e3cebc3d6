"""Resampling against a plain search per point, on uneven, even, repeated, endless and missing times."""

import math
import random

import pytest

from contourlake.operators import cluster as C
from contourlake.operators import resample as RS


def expected(rows, n, method):
    """(point, f0, intensity) of one token's (time, f0, intensity) rows."""
    kept = []
    timed = [r for r in rows if r[0] is not None and math.isfinite(r[0])]
    for t, f, i in sorted(timed, key=lambda r: (r[0], (r[1] or 0) > 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        if not kept or kept[-1][0] != t:
            kept.append((t, f if f is not None and f > 0 else None, i))
    loud = [(t, i) for t, _, i in kept if i is not None]
    out = []
    for p in range(n):
        x = kept[-1][0] if p == n - 1 else kept[0][0] + p * ((kept[-1][0] - kept[0][0]) / (n - 1))
        k = min(max(sum(t <= x for t, _, _ in kept) - 1, 0), len(kept) - 2)
        (t1, f1, i1), (t2, f2, i2) = kept[k], kept[k + 1]
        phase = (x - t1) / (t2 - t1)
        near, far, weight = (f1, f2, phase) if phase < 0.5 else (f2, f1, 1 - phase)
        value = near if near is None or far is None or method == "nearest" else near + weight * (far - near)
        level = i1 if phase < 0.5 else i2
        if method == "linear":
            before, after = [v for v in loud if v[0] <= x], [v for v in loud if v[0] > x]
            level = None if not loud else after[0][1] if not before else before[-1][1] if not after else before[-1][1] + (x - before[-1][0]) / (after[0][0] - before[-1][0]) * (after[0][1] - before[-1][1])
        out.append((p + 1, value, level))
    return out


@pytest.mark.parametrize("method", ["linear", "nearest"])
@pytest.mark.parametrize("n", [2, 21, 64])
def test_points_equal_a_search(frames, method, n):
    draw = random.Random(n)
    tokens = {}
    for name, size in (("few", 3), ("many", 300), ("some", 40)):
        some = [(draw.choice([round(draw.uniform(0, 9), 1), draw.uniform(0, 9)]), draw.choice([None, 0.0, draw.uniform(80, 300), draw.uniform(80, 300)]), draw.choice([None, draw.uniform(30, 80)])) for _ in range(size)]
        tokens[name] = [*some, (0.013, 100.0, None), (9.7, 120.0, 50.0), (None, 90.0, 1.0), (math.inf, 90.0, 1.0), (math.nan, 90.0, 1.0)]
    d = frames([(k, t, f, "S", "T", i) for k, rows in tokens.items() for t, f, i in rows])
    got = {}
    for r in RS.resample_equal(d, n=n, method=method).collect():
        got.setdefault(r["token"], []).append((r["point"], r["f0"], r["intensity"]))
    assert set(got) == set(tokens)
    for name, rows in tokens.items():
        want = expected(rows, n, method)
        assert [p for p, _, _ in sorted(got[name])] == list(range(1, n + 1))
        for a, b in zip(sorted(got[name]), want):
            assert a == pytest.approx(b, abs=1e-9)


def test_constant_columns_count_null_as_a_value(spark):
    d = spark.createDataFrame([("a", 0.1, "x", None, None), ("a", 0.2, "x", None, "v"), ("b", 0.1, "y", None, "v")], "token string, time double, same string, none string, mixed string")
    assert RS.token_constant_columns(d, ["same", "none", "mixed"]) == ["same", "none"]
    assert RS.token_constant_columns(d.limit(0), ["same"]) == ["same"]


def test_contours_of_uneven_tokens(frames):
    draw = random.Random(5)
    rows = [(0.0, 100.0), (3.0, 130.0), *((draw.uniform(0, 3), draw.uniform(90, 200)) for _ in range(150))]
    d = frames([("t", t, f) for t, f in rows] + [("t", math.inf, 1.0), ("t", 1.0, None), ("one", 0.5, 100.0), ("same", 0.5, 100.0), ("same", 0.5, 110.0)])
    found = C.token_contours(d, n_points=20).collect()
    assert [r["token"] for r in found] == ["t"]
    known = sorted(rows)
    for p, v in enumerate(found[0]["contour"]):
        x = 3.0 * p / 19
        k = min(sum(t <= x + 1e-12 for t, _ in known), len(known) - 1)
        (a, fa), (b, fb) = known[k - 1], known[k]
        assert v == pytest.approx(fa + (x - a) / (b - a) * (fb - fa), abs=1e-6)
