"""Polynomials of tokens whose samples lie close together, against exact fractions."""

import random
from fractions import Fraction

from contourlake.operators import contours as K


def exact(points, degree=3):
    """Legendre coefficients by elimination without rounding; x and f0 as given."""
    lo, hi = min(t for t, _ in points), max(t for t, _ in points)
    rows = []
    for t, f in points:
        x = Fraction(2 * ((t - lo) / (hi - lo)) - 1)
        rows.append(([Fraction(1), x, (3 * x * x - 1) / 2, (5 * x**3 - 3 * x) / 2][: degree + 1], Fraction(f)))
    k = degree + 1
    a = [[sum(p[i] * p[j] for p, _ in rows) for j in range(k)] + [sum(p[i] * f for p, f in rows)] for i in range(k)]
    for i in range(k):
        for r in range(k):
            if r != i:
                share = a[r][i] / a[i][i]
                a[r] = [u - share * v for u, v in zip(a[r], a[i])]
    return [float(a[i][k] / a[i][i]) for i in range(k)]


def test_samples_close_together(spark, frames):
    dice, tokens = random.Random(7), {}
    for i in range(40):
        near = 10 ** dice.uniform(-4.5, -3)
        times = [0.0, 0.3 + dice.random() * 0.3]
        times += [times[1] + near * (1 + dice.random()), 1.0] + ([0.1] if i % 2 == 0 and i % 3 == 0 else [])
        tokens[str(i)] = [(t, 100 + 60 * dice.random()) for t in times]
    data = frames([(k, t, f) for k, points in tokens.items() for t, f in points])
    got = {r["token"]: [r[f"c{i}"] for i in range(4)] for r in K.fit_polynomial(data, degree=3, time_normalised="no").collect()}
    for k, points in tokens.items():
        size = max(map(abs, exact(points)))
        assert max(abs(a - b) for a, b in zip(got[k], exact(points))) < 2e-10 * size, k
